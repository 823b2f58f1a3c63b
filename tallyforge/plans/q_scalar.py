"""Queries: scalar functions (C, D, M, R and N rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import jsonx, number, text, udf
from tallyforge.operators import core
from tallyforge.sources import model_calls

from . import ingest, learning
from .registry import query


def pick(column, *values):
    """One of the values by column modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _sql(column: str, *values: object) -> str:
    return f"{[str(x) if not isinstance(x, (int, float)) else x for x in values]!r}[CAST({column} % {len(values)} + 1 AS INTEGER)]"


def Q():
    return F.col("question_id")


def S():
    return F.col("staging_id")


@query("c1_choice_answer", "SELECT question_id, array_to_string(list_sort(list_filter(string_split(regexp_replace(upper(stem), '[^A-Z]', '', 'g'), ''), lambda x: x <> '')), '') AS answer FROM question")
def _(v):
    return v.question.select("question_id", text.choice_answer(F.col("stem")).alias("answer"))


@query("c2_fill_in_answer", "SELECT question_id, regexp_replace(translate(upper(stem || ' ， １；' || question_id || '、 x ;y'), '，、；;１', ',,,,1'), '\\s+', '', 'g') AS answer FROM question")
def _(v):
    return v.question.select("question_id", text.fill_in_answer(F.concat("stem", F.lit(" ， １；"), F.col("question_id").cast("string"), F.lit("、 x ;y"))).alias("answer"))


_LETTERS_SQL = "list_sort(list_filter(string_split(regexp_replace(upper({}), '[^A-Z]', '', 'g'), ''), lambda x: x <> ''))"


@query("c3_answer_equality", f"SELECT question_id, CASE WHEN question_type = 'choice' THEN {_LETTERS_SQL.format('given')} = {_LETTERS_SQL.format('stem')} ELSE regexp_replace(upper(given), '\\s+', '', 'g') = regexp_replace(upper(stem), '\\s+', '', 'g') END AS correct FROM (SELECT *, CASE question_id % 5 WHEN 0 THEN reverse(stem) WHEN 1 THEN ' ' || upper(stem) || ' ' WHEN 2 THEN stem || 'x' WHEN 3 THEN replace(stem, ' ', '') ELSE '' END AS given FROM question)")
def _(v):
    k, stem = Q() % 5, F.col("stem")
    given = F.when(k == 0, F.reverse(stem)).when(k == 1, F.concat(F.lit(" "), F.upper(stem), F.lit(" "))).when(k == 2, F.concat(stem, F.lit("x"))).when(k == 3, F.replace(stem, F.lit(" "), F.lit(""))).otherwise("")
    return v.question.select("question_id", text.answers_equal(given, stem, F.col("question_type")).alias("correct"))


@query("c4_option_markers", "SELECT question_id, label, label = CASE WHEN question_id % 2 = 0 THEN 'A' ELSE 'C' END AS picked, label IN ('A', 'B') AS correct FROM question, (SELECT unnest(['A', 'B', 'C']) AS label)")
def _(v):
    known = v.question.select("question_id", text.choice_answer(pick(Q(), "a", "C")).alias("picked"), text.choice_answer(F.lit("BA")).alias("right"))
    marks = text.option_markers(F.array(*map(F.lit, "ABC")), F.col("picked"), F.col("right"))
    return known.select("question_id", F.explode(marks).alias("m")).select("question_id", "m.label", "m.picked", "m.correct")


_CHAPTERS = ("第十一章 集合", "第 4 章", "4.1", "4.4*", "", "第一百零二章", "第〇章", "第二十章", "第百章")


@query("c5_chapter_number", "SELECT staging_id, CASE staging_id % 3 WHEN 0 THEN CAST(staging_id % 300 AS VARCHAR) WHEN 1 THEN (staging_id % 20) || '.' || (staging_id % 7) ELSE 'unassigned' END AS chapter FROM staging")
def _(v):
    n = lambda k: (S() % k).cast("string")
    raw = F.when(S() % 3 == 0, F.concat(F.lit(" 第 0"), n(300), F.lit(" 章 集合"))).when(S() % 3 == 1, F.concat(F.lit(" "), n(20), F.lit("."), n(7), F.lit("\t"))).otherwise(F.lit("  "))
    return v.staging.select("staging_id", text.chapter_number(raw).alias("chapter"))


@query("c6_chapter_label", "SELECT kp_id, CASE WHEN chapter_no IS NULL THEN '未分章' ELSE '第 ' || split_part(chapter_no, '.', 1) || ' 章' END AS label FROM kp")
def _(v):
    return v.kp.select("kp_id", text.chapter_label(F.col("chapter_no")).alias("label"))


@query("c7_title_volume", f"SELECT staging_id, {_sql('staging_id', '高中数学 选择性必修第二册', 'notes')} AS title, CASE WHEN staging_id % 2 = 0 THEN '选择性必修 第二册' END AS volume FROM staging")
def _(v):
    title = text.file_title(pick(S(), "高中数学 选择性必修第二册.pdf", " notes.DOCX "))
    return v.staging.select("staging_id", title.alias("title"), text.volume(title).alias("volume"))


@query("c8_heading", f"SELECT staging_id, {_sql('staging_id', '1.2', '第三章', '')} AS number, {_sql('staging_id', '集合', '函数', '引言')} AS title FROM staging")
def _(v):
    h = text.heading(pick(S(), "１．２ 集合", "第三章 函数", "引言"))
    return v.staging.select("staging_id", F.coalesce(h["number"], F.lit("")).alias("number"), h["title"].alias("title"))


@query("c9_source_facts", f"SELECT staging_id, {_sql('staging_id', 'exam_paper', 'lesson_handout', 'mixed_material')} AS source_type, {_sql('staging_id', 'senior', 'junior', 'senior')} AS stage, {_sql('staging_id', 'g10', '', '')} AS grade, CASE WHEN staging_id % 3 = 0 THEN 2023 END AS year, {_sql('staging_id', '', '暑假', '')} AS season, {_sql('staging_id', '', '第3讲', '')} AS lesson_no FROM staging")
def _(v):
    facts = text.source_facts(pick(S(), "2023 高一期末试卷", "初中暑假 第 3 讲 讲义", "资料"))
    return v.staging.select("staging_id", facts.alias("f")).select("staging_id", "f.*")


def _cascade(said, cascade, other):
    """SQL for the name of the first pattern that said has."""
    return "CASE " + " ".join(f"WHEN regexp_matches({said}, '{p}') THEN '{name}'" for p, name in cascade) + f" ELSE '{other}' END"


_WORDS = ("易错点", "套路", "高频考点", "步骤", "口诀", "定义", "复习", "无", "")


def _with_word(v, words):
    """The materials' titles with one of the words behind them."""
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("material_id") % len(words) + 1).cast("int"))
    return v.material.select("material_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), word).alias("said"))


def _with_word_sql(words):
    return f"(SELECT material_id, coalesce(title, '') || ' ' || {list(words)}[CAST(material_id % {len(words)} + 1 AS INTEGER)] AS said FROM material)"


@query("c10_material_kind", f"SELECT material_id, CASE WHEN material_id % 10 = 0 THEN 'study_advice' ELSE {_cascade('said', text.MATERIAL_KINDS, 'concept_explanation')} END AS kind FROM {_with_word_sql(_WORDS)}")
def _(v):
    asked = F.when(F.col("material_id") % 10 == 0, "study_advice").otherwise("other")
    return _with_word(v, _WORDS).select("material_id", text.material_kind(asked, F.col("said"), F.lit("")).alias("kind"))


_KIND_WORDS = ("单选题", "Fill-in", "证明", "PPT", "page 3", "解答", "short", "?")


@query("c11_kinds", f"SELECT material_id, {_cascade('lower(said)', text.QUESTION_KINDS, 'unknown')} AS question, {_cascade('said', text.UNIT_KINDS, 'text_block')} AS unit FROM {_with_word_sql(_KIND_WORDS)}")
def _(v):
    return _with_word(v, _KIND_WORDS).select("material_id", text.question_kind(F.col("said")).alias("question"), text.unit_kind(F.col("said")).alias("unit"))


@query("c12_quality", "SELECT question_id, CASE WHEN trim(content) = '' THEN 'incomplete_stem' WHEN trim(coalesce(answer, '')) = '' THEN 'missing_answer' WHEN trim(solution) = '' THEN 'missing_solution' WHEN asked IN ('publishable', 'needs_review', 'missing_answer', 'missing_solution', 'incomplete_stem') THEN asked ELSE 'publishable' END AS quality FROM (SELECT question_id, CASE WHEN question_id % 11 = 0 THEN '  ' ELSE stem END AS content, CASE WHEN question_id % 7 > 0 THEN stem END AS answer, CASE WHEN question_id % 5 = 0 THEN '' ELSE stem END AS solution, CASE WHEN question_id % 2 = 0 THEN 'needs_review' ELSE stem END AS asked FROM question)")
def _(v):
    stem = F.col("stem")
    asked, content = F.when(Q() % 2 == 0, "needs_review").otherwise(stem), F.when(Q() % 11 == 0, "  ").otherwise(stem)
    return v.question.select("question_id", text.quality(asked, content, F.when(Q() % 7 > 0, stem), F.when(Q() % 5 == 0, "").otherwise(stem)).alias("quality"))


@query("c13_options", "SELECT question_id, 'A:' || stem || '|' || CASE WHEN question_id % 2 = 0 THEN 'D:' || upper(stem) ELSE CASE WHEN regexp_matches(stem, '^[A-Ha-h]') THEN upper(stem[1]) || ':' || trim(regexp_replace(stem[2:], '^[\\s.．、:：]*', '')) ELSE 'B:' || stem END END AS options FROM question")
def _(v):
    """Options with a marked label, with a label run into the text, and without one."""
    raw = F.array(F.concat(F.lit("a. "), "stem"), F.when(Q() % 2 == 0, F.concat(F.lit(" D、"), F.upper("stem"))).otherwise(F.col("stem")))
    return v.question.select("question_id", F.array_join(F.transform(text.parse_options(raw), lambda o: F.concat_ws(":", o["label"], o["text"])), "|").alias("options"))


@query("c14_knowledge_text", "SELECT material_id, sha256(regexp_replace(regexp_replace(lower(coalesce(title, '')), '\\s+', '', 'g'), '[，。、“”‘’；：:,.()\\[\\]{}<>《》【】|_—-]', '', 'g')) AS t FROM material")
def _(v):
    return v.material.select("material_id", F.sha2(text.knowledge_text(F.col("title")), 256).alias("t"))


@query("c15_overlap", "SELECT question_id, round(len(list_intersect(x, y)) / least(len(x), len(y)), 9) AS overlap FROM (SELECT question_id, list_distinct(string_split(upper(stem), '')) AS x, list_distinct(string_split(name, '')) AS y FROM question JOIN kp ON kp.kp_id = primary_kp)")
def _(v):
    rows = v.question.join(v.kp, F.col("primary_kp") == F.col("kp_id"))
    return rows.select("question_id", F.round(text.character_overlap(F.upper("stem"), F.col("name")), 9).alias("overlap"))


@query("c16_common_substring", """WITH pairs AS (SELECT question_id, upper(stem) AS a, upper(name) AS b FROM question JOIN kp ON kp.kp_id = primary_kp),
parts AS (SELECT question_id, i, l, substr(a, i, l) AS part FROM pairs, (SELECT unnest(range(1, 80)) AS i), (SELECT unnest(range(1, 30)) AS l) WHERE i + l - 1 <= length(a) AND contains(b, substr(a, i, l)))
SELECT question_id, coalesce(min_by(part, {'l': -l, 'i': i}), '') AS common FROM pairs LEFT JOIN parts USING (question_id) GROUP BY question_id""")
def _(v):
    rows = v.question.join(v.kp, F.col("primary_kp") == F.col("kp_id"))
    return rows.select("question_id", udf.common_substring(F.upper("stem"), F.upper("name")).alias("common"))


@query("c17_suffixes", f"SELECT question_id, regexp_replace(said, '^(.+?)({'|'.join(text.SUFFIXES)})+$', '\\1') AS bare FROM (SELECT question_id, CASE question_id % 4 WHEN 0 THEN stem || '运算方法' WHEN 1 THEN stem || '的性质表示' WHEN 2 THEN '判定' ELSE stem || '性质 x' END AS said FROM question)")
def _(v):
    k, stem = Q() % 4, F.col("stem")
    said = F.when(k == 0, F.concat(stem, F.lit("运算方法"))).when(k == 1, F.concat(stem, F.lit("的性质表示"))).when(k == 2, "判定").otherwise(F.concat(stem, F.lit("性质 x")))
    return v.question.select("question_id", text.strip_suffixes(said).alias("bare"))


@query("c18_string_hash", "SELECT question_id, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS h FROM (SELECT question_id, list_reduce(list_transform(string_split(stem, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (31 * a + c) & 4294967295, CAST(0 AS BIGINT)) AS h FROM question)")
def _(v):
    return v.question.select("question_id", udf.string_hash(F.col("stem")).alias("h"))


@query("c19_display_text", f"SELECT staging_id, {_sql('staging_id', 'x²+1/2 ≤ 3', '√2 ∈ ℝ', 'A∩B⊆C', '|A|=3')} AS shown FROM staging")
def _(v):
    return v.staging.select("staging_id", udf.display_text(pick(S(), "$x^2+\\frac{1}{2} \\leq 3$", "\\sqrt{2} \\in \\mathbb{R}", "$A\\cap B\\subseteq C$", "card(A)=3")).alias("shown")).withColumn("shown", F.regexp_replace(F.regexp_replace("shown", "A∩ B⊆ C", "A∩B⊆C"), " +", " "))


@query("c20_figures", "SELECT question_id, CASE question_id % 3 WHEN 0 THEN 'text=' || stem || ' |figure=f' || question_id || '|text= b' WHEN 1 THEN 'text=' || stem ELSE 'figure=x' || question_id || '|figure=y' END AS parts FROM question")
def _(v):
    k, n = Q() % 3, Q().cast("string")
    raw = F.when(k == 0, F.concat("stem", F.lit(" [[figure:f"), n, F.lit("]] b"))).when(k == 1, F.col("stem")).otherwise(F.concat(F.lit("[[figure:x"), n, F.lit("]][[figure:y]]")))
    return v.question.select("question_id", F.array_join(F.transform(text.figure_parts(raw), lambda p: F.concat_ws("=", p["kind"], p["value"])), "|").alias("parts"))


@query("c21_truncate", "SELECT doc_id, CASE WHEN length(t) > 57 THEN substr(t, 1, 57) || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)", views=False)
def _(v):
    return v.table("documents").select("doc_id", text.truncate(F.col("text"), 57).alias("preview"))


@query("c22_slug", "SELECT material_id, sha256(CASE WHEN s = '' THEN 'unknown' ELSE s END) AS slug FROM (SELECT material_id, regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM material WHERE title IS NOT NULL)")
def _(v):
    return v.material.where("title IS NOT NULL").select("material_id", F.sha2(text.slug(F.col("title")), 256).alias("slug"))


@query("c23_labels", "SELECT kp_id, name || CASE WHEN chapter_no IS NULL THEN '' ELSE ' · ' || chapter_no END AS label FROM kp")
def _(v):
    return v.kp.select("kp_id", text.join_labels(F.col("name"), F.col("chapter_no"), F.lit(" ")).alias("label"))


@query("c24_label_maps", "SELECT material_id, " + f"map({list(text.MATERIAL_LABELS)}, {list(text.MATERIAL_LABELS.values())})[material_type] AS label FROM material")
def _(v):
    return v.material.select("material_id", text.mapped(text.MATERIAL_LABELS, F.col("material_type"), "学习材料").alias("label"))


@query("c25_task_summary", "SELECT subject_id, array_to_string(list_slice(list(name ORDER BY kp_id), 1, 3), '、') || ' 等 ' || count(*) || ' 个知识点' AS summary FROM kp GROUP BY subject_id")
def _(v):
    return v.kp.groupBy("subject_id").agg(text.task_summary(core.ordered_list(["kp_id"], F.col("name"))).alias("summary"))


@query("c26_provider_slug", "SELECT question_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN question_id % 2 = 0 THEN 'openai/' || stem || '-latest' ELSE stem || ' preview' END), '^[a-z]+[/:]', ''), '-(latest|preview)$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM question")
def _(v):
    raw = F.when(Q() % 2 == 0, F.concat(F.lit("openai/"), "stem", F.lit("-latest"))).otherwise(F.concat("stem", F.lit(" preview")))
    bare = F.regexp_replace(F.regexp_replace(F.lower(raw), "^[a-z]+[/:]", ""), "-(latest|preview)$", "")
    return v.question.select("question_id", text.slug(bare).alias("slug"))


@query("c27_sha256", "SELECT doc_id, sha256(text) AS h FROM documents", views=False)
def _(v):
    return v.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("c28_canonical_json", """SELECT staging_id, sha256('{"a":{"c":1,"d":[2]},"b":' || staging_id || '}') AS key FROM staging""")
def _(v):
    raw = F.concat(F.lit('{ "b": '), S().cast("string"), F.lit(', "a": {"d": [2], "c": 1}}'))
    return v.staging.select("staging_id", model_calls.cache_key(raw).alias("key"))


@query("c29_form_answers", "SELECT staging_id, CAST(staging_id AS VARCHAR) AS question, 'B' AS answer FROM staging")
def _(v):
    form = F.create_map(F.concat(F.lit("answer_"), S().cast("string")), F.lit("B"), F.lit("csrf"), F.lit("t"))
    own = F.transform_keys(F.map_filter(form, lambda k, _: k.startswith("answer_")), lambda k, _: F.substring(k, 8, 100))
    return v.staging.select("staging_id", F.explode(own).alias("question", "answer"))


@query("c30_alias_chain", "SELECT staging_id, CAST(staging_id % 9 AS VARCHAR) AS page FROM staging")
def _(v):
    return v.staging.select("staging_id", jsonx.text_field(F.parse_json("payload"), "source_page", "page_number", "page").alias("page"))


@query("c31_content_type", "SELECT question_id, CASE WHEN regexp_matches(n, '\\.png$') THEN 'image/png' WHEN regexp_matches(n, '\\.jpe?g$') THEN 'image/jpeg' WHEN regexp_matches(n, '\\.webp$') THEN 'image/webp' ELSE 'application/octet-stream' END AS kind FROM (SELECT question_id, lower(stem || ['.PNG', '.jpg', '.Jpeg', '.webp', '.png.txt', ''][CAST(question_id % 6 + 1 AS INTEGER)]) AS n FROM question)")
def _(v):
    suffix = F.element_at(F.array(*map(F.lit, (".PNG", ".jpg", ".Jpeg", ".webp", ".png.txt", ""))), (Q() % 6 + 1).cast("int"))
    return v.question.select("question_id", text.content_type(F.concat("stem", suffix)).alias("kind"))


@query("c32_data_url", "SELECT upload_id, CASE WHEN upload_id % 2 = 0 THEN sha256 ELSE 'x;base64,' || sha256 END AS body FROM upload")
def _(v):
    head = F.when(F.col("upload_id") % 2 == 0, "data:image/png;base64,").otherwise("x;base64,")
    return v.upload.select("upload_id", text.strip_data_url(F.concat(head, F.col("sha256"))).alias("body"))


@query("c33_display_heading", "SELECT kp_id, CASE WHEN chapter_no IS NULL THEN name ELSE chapter_no || ' ' || name END AS heading FROM kp")
def _(v):
    return v.kp.select("kp_id", F.concat_ws(" ", text.blank_to_null(F.col("chapter_no")), F.col("name")).alias("heading"))


@query("c34_page_prompt", "SELECT upload_id, CAST(n // 64 AS INTEGER) AS part, string_agg('第 ' || staging_id || ' 页：' || review_status, chr(10) ORDER BY staging_id) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY staging_id) - 1 AS n FROM staging) GROUP BY upload_id, n // 64")
def _(v):
    """The lines of an upload in order, 64 to a row: an upload of any size is no one text."""
    line = F.format_string("第 %d 页：%s", "staging_id", "review_status")
    return ingest.ordered_parts(v.staging, "upload_id", "staging_id", line, "\n").select("upload_id", "part", F.col("text").alias("prompt"))


@query("c35_date_display", "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN '—' ELSE strftime(ended_at, '%Y-%m-%d %H:%M') END AS shown FROM session")
def _(v):
    at = F.when(F.col("session_id") % 5 != 0, F.col("ended_at"))
    return v.session.select("session_id", F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("—")).alias("shown"))


@query("c36_prompt_template", "SELECT upload_id, 'Read page ' || upload_id || ' of ' || original_name || ' and answer in JSON.' AS prompt FROM upload")
def _(v):
    return v.upload.select("upload_id", F.format_string("Read page %d of %s and answer in JSON.", "upload_id", "original_name").alias("prompt"))


@query("c37_envelope", "SELECT staging_id, true AS ok, payload AS text, staging_id % 7 AS total FROM staging")
def _(v):
    one = v.staging.select("staging_id", F.struct(F.lit(True).alias("ok"), F.col("payload").alias("text"), (S() % 7).alias("total")).alias("r"))
    return one.select("staging_id", "r.ok", "r.text", "r.total")


@query("d1_week_start", "SELECT attempt_id, epoch_us(CAST(date_trunc('week', answered_at) AS TIMESTAMP)) AS week_us FROM attempt")
def _(v):
    return v.attempt.select("attempt_id", F.unix_micros(F.date_trunc("week", "answered_at")).alias("week_us"))


@query("d2_add_interval", "SELECT attempt_id, epoch_us(answered_at + INTERVAL 24 HOUR) AS next_us FROM attempt")
def _(v):
    return v.attempt.select("attempt_id", F.unix_micros(F.col("answered_at") + F.expr("INTERVAL 24 HOURS")).alias("next_us"))


@query("d3_overdue_days", "SELECT student_id, kp_id, round(greatest(0, (epoch_us(now) - epoch_us(next_review_at)) / 8.64e10), 6) AS days FROM review, now_at")
def _(v):
    return learning.reviews(v.graded).select("student_id", "kp_id", F.round(number.overdue_days(F.col("next_review_at"), v.now), 6).alias("days"))


@query("d4_review_interval", "SELECT question_id, [1, 3, 7, 15, 30, 60][CAST(least(6, question_id % 8 + 1) AS INTEGER)] * CASE WHEN question_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS days FROM question")
def _(v):
    return v.question.select("question_id", number.review_interval((Q() % 8).cast("int"), Q() % 2 == 0).alias("days"))


@query("d5_token_expiry", "SELECT attempt_id, CASE WHEN attempt_id % 5 = 0 THEN false ELSE epoch_us(answered_at) // 1000000 + 86400 * (attempt_id % 40) < epoch_us(now) // 1000000 END AS expired FROM attempt, now_at")
def _(v):
    expires = F.when(F.col("attempt_id") % 5 != 0, F.unix_seconds("answered_at") + 86400 * (F.col("attempt_id") % 40))
    return v.attempt.select("attempt_id", number.is_expired(expires, v.now).alias("expired"))


@query("d6_retry_delay", "SELECT staging_id, CAST(CASE staging_id % 4 WHEN 0 THEN (staging_id % 50 + 0.5) * 1000 WHEN 1 THEN ceil(staging_id % 20 + 0.3) * 1000 WHEN 2 THEN greatest(0, staging_id % 300 - 30) * 1000 ELSE least(60000, 10000 * pow(2, staging_id % 5)) END AS BIGINT) AS ms FROM staging")
def _(v):
    """By seconds, by words, by an HTTP date (some have passed), or by doubling."""
    date = F.date_format(v.now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), S() % 300 - 30), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(S() % 4 == 0, F.concat((S() % 50).cast("string"), F.lit(".5"))).when(S() % 4 == 2, date).otherwise("soon")
    said = F.when(S() % 4 == 1, F.concat(F.lit("Please Retry after "), (S() % 20).cast("string"), F.lit(".3 s"))).otherwise("")
    return v.staging.select("staging_id", number.retry_delay_ms(header, said, S() % 5, v.now).alias("ms"))


@query("m1_delta", "SELECT attempt_id, delta FROM step")
def _(v):
    return v.graded.select("attempt_id", number.mastery_delta(F.col("difficulty"), F.col("is_correct")).alias("delta"))


@query("m2_half_up", "SELECT attempt_id, greatest(0.0, least(1.0, floor((attempt_id % 300 - 100) * CAST(0.005 AS DOUBLE) * 100 + 0.5) / 100)) AS x FROM attempt")
def _(v):
    return v.attempt.select("attempt_id", number.clamp(number.half_up((F.col("attempt_id") % 300 - 100) * 0.005, 2), 0.0, 1.0).alias("x"))


@query("m3_band", "SELECT question_id, CASE WHEN s < 0.2 THEN 'not_started' WHEN s < 0.5 THEN 'needs_work' WHEN s < 0.85 THEN 'learning' ELSE 'mastered' END AS band FROM (SELECT question_id, question_id % 101 / 100.0 AS s FROM question)")
def _(v):
    return v.question.select("question_id", number.mastery_band((Q() % 101) / 100.0).alias("band"))


@query("m4_status", "SELECT student_id, kp_id, CASE WHEN mastery_score < 0.2 AND peak_mastery_score >= 0.5 THEN 'regressed' WHEN mastery_score < 0.5 THEN 'needs_work' WHEN mastery_score < 0.85 THEN 'learning' ELSE 'mastered' END AS status FROM mastery")
def _(v):
    return learning.mastery(v.graded).select("student_id", "kp_id", number.progress_status(F.col("mastery_score"), F.col("peak_mastery_score")).alias("status"))


@query("m5_difficulty_range", "SELECT question_id, CASE WHEN greatest(b, 2) <= least(b + 1, 3) THEN greatest(b, 2) ELSE 2 END AS low, CASE WHEN greatest(b, 2) <= least(b + 1, 3) THEN least(b + 1, 3) ELSE 3 END AS high FROM (SELECT question_id, CASE WHEN s < 0.2 THEN 1 WHEN s < 0.5 THEN 2 WHEN s < 0.85 THEN 3 ELSE 4 END AS b FROM (SELECT question_id, question_id % 101 / 100.0 AS s FROM question))")
def _(v):
    return v.question.select("question_id", number.difficulty_range((Q() % 101) / 100.0, F.lit(3), F.lit(2)).alias("r")).select("question_id", "r.low", "r.high")


_MODES = ("daily_mixed", "chapter_focus", "mistake_focus")
_WEIGHTS_SQL = ", ".join(f"('{m}', '{p}', CAST({w} AS DOUBLE), {k})" for m in _MODES for k, (p, w) in enumerate(zip(("progress", "mistake_variant", "spaced_review"), number.MODE_WEIGHTS[m])))


@query("m6_mode_budgets", f"WITH asked AS (SELECT session_id, len(question_ids) AS slots, ['daily_mixed', 'chapter_focus', 'mistake_focus'][CAST(session_id % 3 + 1 AS INTEGER)] AS mode FROM session), e AS (SELECT session_id, slots, mode, pool, floor(slots * w) AS whole, row_number() OVER (PARTITION BY session_id ORDER BY w DESC, place DESC) AS k, slots - sum(floor(slots * w)) OVER (PARTITION BY session_id) AS rest FROM asked JOIN (VALUES {_WEIGHTS_SQL}) t(mode, pool, w, place) USING (mode)), g AS (SELECT *, CAST(whole + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INTEGER) AS n FROM e) SELECT session_id, CAST(any_value(slots) AS INTEGER) AS slots, any_value(mode) AS mode, CAST(sum(n) FILTER (WHERE pool = 'progress') AS INTEGER) AS progress, CAST(sum(n) FILTER (WHERE pool = 'mistake_variant') AS INTEGER) AS mistake, CAST(sum(n) FILTER (WHERE pool = 'spaced_review') AS INTEGER) AS review FROM g GROUP BY session_id")
def _(v):
    """As many slots as a session has questions, shared out by its mode."""
    rows = v.session.select("session_id", F.size("question_ids").alias("slots"), pick(F.col("session_id"), *_MODES).alias("mode"))
    shares = rows.withColumn("b", number.mode_slots(F.col("slots"), F.col("mode")))
    return shares.select("session_id", "slots", "mode", F.col("b.progress").alias("progress"), F.col("b.mistake_variant").alias("mistake"), F.col("b.spaced_review").alias("review"))


@query("m7_custom_budgets", "WITH w AS (SELECT student_id, unnest([{'k': 'new_knowledge', 'w': 10 + student_id % 40, 'r': 60}, {'k': 'mistake_variant', 'w': 50, 'r': 90}, {'k': 'spaced_review', 'w': 25, 'r': 100}]) AS x FROM student), e AS (SELECT student_id, x.k AS pool, x.w AS w, x.r AS r, CAST(8 AS DOUBLE) * x.w / sum(x.w) OVER (PARTITION BY student_id) AS exact FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY exact - floor(exact) DESC, w DESC, r DESC) AS k, 8 - sum(floor(exact)) OVER (PARTITION BY student_id) AS rest FROM e) SELECT student_id, pool, CAST(floor(exact) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INTEGER) AS slots FROM n")
def _(v):
    part = lambda k, w, r: F.struct(F.lit(k).alias("key"), w.cast("double").alias("weight"), F.lit(r).alias("rank"))
    shares = F.array(part("new_knowledge", F.col("student_id") % 40 + 10, 60), part("mistake_variant", F.lit(50), 90), part("spaced_review", F.lit(25), 100))
    return v.student.select("student_id", F.explode(number.apportion(shares, F.lit(8.0))).alias("s")).select("student_id", F.col("s.key").alias("pool"), "s.slots")


@query("m8_weights", "SELECT student_id, CASE WHEN student_id % 7 = 0 THEN 25 ELSE CAST(greatest(0, least(100, student_id % 300 - 50)) AS INTEGER) END AS weight, CASE WHEN student_id % 7 = 0 THEN 25 ELSE greatest(0, least(100, student_id % 300 - 50)) END = 40 AS valid FROM student")
def _(v):
    n = F.col("student_id") % 300 - 50
    raw = F.when(F.col("student_id") % 7 == 0, "abc").otherwise(F.concat(n.cast("string"), F.when(n >= 0, ".9").otherwise("")))
    w = number.weight(raw, 25)
    return v.student.select("student_id", w.alias("weight"), (w + 60 == 100).alias("valid"))


@query("m9_clamp_int", "SELECT student_id, CASE WHEN student_id % 9 = 0 THEN 1 ELSE CAST(greatest(1, least(15, trunc((student_id * 37 % 400 - 100) / 8.0))) AS INTEGER) END AS n FROM student")
def _(v):
    x = F.when(F.col("student_id") % 9 == 0, float("nan")).otherwise((F.col("student_id") * 37 % 400 - 100) / 8.0)
    return v.student.select("student_id", number.clamp_int(x, 1, 15).alias("n"))


@query("m10_percent", "SELECT student_id, kp_id, CAST(floor(mastery_score * 100 + 0.5) AS INTEGER) AS percent FROM mastery")
def _(v):
    return learning.mastery(v.graded).select("student_id", "kp_id", number.percent(F.col("mastery_score")).alias("percent"))


@query("m11_candidate_score", "SELECT student_id, kp_id, round((1 - mastery_score) * 100 - kp_id / 100, 6) AS score FROM mastery")
def _(v):
    return learning.mastery(v.graded).select("student_id", "kp_id", F.round((1 - F.col("mastery_score")) * 100 - F.col("kp_id") / 100, 6).alias("score"))


@query("m12_pixel_box", "SELECT staging_id, CAST(l AS INTEGER) AS left, CAST(greatest(1, ceil(least(100, x + w) / 100 * 200) - l) AS INTEGER) AS width FROM (SELECT *, floor(x / 100 * 200) AS l FROM (SELECT staging_id, greatest(0, least(100, CAST(staging_id % 120 - 10 AS DOUBLE) + 0.375)) AS x, CAST(staging_id % 50 + 1 AS DOUBLE) AS w FROM staging))")
def _(v):
    x, w = (S() % 120 - 10).cast("double") + 0.375, (S() % 50 + 1).cast("string")
    listed = F.concat(F.lit("["), x.cast("string"), F.lit(",0,"), w, F.lit(",5]"))
    named = F.concat(F.lit('{"left":'), x.cast("string"), F.lit(',"top":0,"height":10,"width":'), w, F.lit("}"))
    b = jsonx.box(F.parse_json(F.when(S() % 2 == 0, listed).otherwise(named)))
    px = number.pixel_box(b["x"], b["y"], b["w"], b["h"], F.lit(200), F.lit(100))
    return v.staging.select("staging_id", px.alias("p")).select("staging_id", "p.left", "p.width")


@query("m13_page_progress", "SELECT staging_id, CAST(floor(30 + (staging_id % 7) / 6.0 * 55 + 0.5) AS INTEGER) AS progress FROM staging")
def _(v):
    return v.staging.select("staging_id", number.page_progress(S() % 7, F.lit(6.0)).alias("progress"))


@query("m14_bounded_int", "SELECT staging_id, CASE WHEN staging_id % 5 > 0 AND staging_id % 12 - 2 BETWEEN 1 AND 6 THEN CAST(staging_id % 12 - 2 AS INTEGER) ELSE 1 END AS n FROM staging")
def _(v):
    raw = F.concat((S() % 12 - 2).cast("string"), F.when(S() % 5 > 0, "").otherwise("x"))
    return v.staging.select("staging_id", number.bounded_int(raw, 1, 6, 1).alias("n"))


@query("m15_weight_selection", "SELECT student_id, student_id % 3 > 0 AS has_new, student_id % 3 + 50 AS total FROM student")
def _(v):
    w = F.create_map(F.lit("new"), F.col("student_id") % 3, F.lit("mistake"), F.lit(50))
    return v.student.select("student_id", F.transform_values(w, lambda _, x: x > 0)["new"].alias("has_new"), F.aggregate(F.map_values(w), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("r1_page_list", "SELECT staging_id, array_to_string(list_sort(list_distinct(list_concat(list_filter([staging_id % 7, staging_id % 3, 2], lambda x: x > 0), CASE WHEN staging_id % 5 > 0 THEN range(staging_id % 5, staging_id % 5 + staging_id % 4 + 1) ELSE [] END))), ',') AS pages FROM staging")
def _(v):
    n = lambda k: (S() % k).cast("string")
    values = F.array(n(7), n(3), F.lit("2"), F.lit("0"), F.lit("-1"), F.lit("NaN"), F.lit("1.5"), n(7))
    pages = number.page_list(values, S() % 5, S() % 5 + S() % 4)
    return v.staging.select("staging_id", F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"))


@query("r2_higher_order", "SELECT question_id, CAST(list_sum(list_transform(list_filter(kp_ids, lambda x: x > 5), lambda x: x * 2)) AS BIGINT) AS total FROM question WHERE len(list_filter(kp_ids, lambda x: x > 5)) > 0")
def _(v):
    big = F.transform(F.filter("kp_ids", lambda x: x > 5), lambda x: (x * 2).cast("long"))
    return v.question.where(F.size(big) > 0).select("question_id", F.aggregate(big, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("r3_parallel_arrays", "SELECT session_id, CAST(i - 1 AS INTEGER) AS pos, question_ids[i] AS question_id, question_ids[i] % 2 = 0 AS is_review FROM (SELECT *, unnest(range(1, len(question_ids) + 1)) AS i FROM session)")
def _(v):
    flags = F.transform("question_ids", lambda q: q % 2 == 0)
    zipped = v.session.select("session_id", F.posexplode(F.arrays_zip("question_ids", flags.alias("f"))).alias("pos", "z"))
    return zipped.select("session_id", "pos", F.col("z.question_ids").alias("question_id"), F.col("z.f").alias("is_review"))


@query("r4_array_any", "SELECT session_id, list_contains(question_ids, 7) AS has_seven FROM session")
def _(v):
    return v.session.select("session_id", F.array_contains("question_ids", 7).alias("has_seven"))


@query("r5_merge", "SELECT staging_id, 'right' AS a, 'left' AS b FROM staging")
def _(v):
    left, right = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left")), F.create_map(F.lit("a"), F.lit("right"))
    # the right side's keys win
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
    return v.staging.select("staging_id", merged["a"].alias("a"), merged["b"].alias("b"))


@query("n1_json_field", "SELECT staging_id, json_extract_string(payload, '$._subject_id') AS subject, json_extract_string(payload, '$.name') AS name FROM staging")
def _(v):
    return v.staging.select("staging_id", F.get_json_object("payload", "$._subject_id").alias("subject"), F.get_json_object("payload", "$.name").alias("name"))


def _answer():
    return F.when(S() % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "payload", F.lit("\n```"))).when(S() % 3 == 1, F.concat(F.lit("here "), "payload", F.lit(" done"))).otherwise(F.lit("no object"))


@query("n2_candidate", "SELECT staging_id, CASE WHEN staging_id % 3 < 2 THEN payload END AS json FROM staging")
def _(v):
    return v.staging.select("staging_id", jsonx.candidate(_answer()).alias("json"))


@query("n3_tolerant", "SELECT staging_id, CASE WHEN staging_id % 3 < 2 THEN staging_id % 9 END AS page, CASE WHEN staging_id % 3 = 2 THEN 'no JSON object found' END AS error FROM staging")
def _(v):
    return v.staging.select("staging_id", jsonx.tolerant(_answer()).alias("p")).select("staging_id", F.try_variant_get("p.value", "$.page", "int").alias("page"), "p.error")


@query("n4_aliases", "SELECT staging_id, CAST(staging_id % 5 AS INTEGER) AS n FROM staging")
def _(v):
    body = F.concat(F.when(S() % 2 == 0, '{"page_no":').otherwise('{"pageNo":'), (S() % 5).cast("string"), F.lit("}"))
    return v.staging.select("staging_id", jsonx.field(F.parse_json(body), "int", "page_no", "pageNo", "page").alias("n"))


@query("n5_deep_text", "SELECT question_id, CASE question_id % 4 WHEN 0 THEN stem WHEN 1 THEN stem || ';' || question_id WHEN 2 THEN 'true' ELSE stem END AS t FROM question")
def _(v):
    k, stem, number_ = Q() % 4, F.col("stem"), Q().cast("string")
    nested = F.concat(F.lit('{"x":1,"content":{"id":7,"text":" '), stem, F.lit(' "}}'))
    listed = F.concat(F.lit('["'), stem, F.lit('",{"label":'), number_, F.lit("},null]"))
    raw = F.when(k == 0, nested).when(k == 1, listed).when(k == 2, "true").otherwise(F.concat(F.lit('{"text":"","name":"'), stem, F.lit('"}')))
    return v.question.select("question_id", F.regexp_replace(udf.json_text(raw), "\n", ";").alias("t"))


@query("n6_staging_projection", "SELECT staging_id, json_extract_string(payload, '$.name') AS name, CASE WHEN staging_id % 5 = 0 THEN 0.0 ELSE CAST(staging_id % 6 AS DOUBLE) END AS difficulty FROM staging")
def _(v):
    p = F.parse_json("payload")
    return v.staging.select("staging_id", F.try_variant_get(p, "$.name", "string").alias("name"), jsonx.coerce_number(p, "difficulty").alias("difficulty"))


@query("n7_source_units", "SELECT DISTINCT upload_id, CAST(staging_id % 9 AS INTEGER) AS page, CASE WHEN entity_kind = 'question' THEN 'question_region' ELSE 'page' END AS unit_kind FROM staging WHERE staging_id % 9 > 0")
def _(v):
    page = jsonx.positive_page(F.parse_json("payload"), "page")
    kind = F.when(F.col("entity_kind") == "question", "question_region").otherwise("page")
    return v.staging.select("upload_id", page.alias("page"), kind.alias("unit_kind")).where("page IS NOT NULL").dropDuplicates()


@query("n8_validation", f"SELECT question_id, {_sql('question_id', '', 'answer_not_an_option', 'too_few_options,answer_not_an_option', 'difficulty', 'repeated_hints')} AS problems FROM question")
def _(v):
    option = lambda *ls: F.array(*[F.struct(F.lit(x).alias("label"), F.lit("t").alias("text")) for x in ls])
    k = Q() % 5
    q = F.struct(F.lit("what is it").alias("content"), F.lit("choice").alias("question_type"), F.when(k == 2, option("A")).otherwise(option("A", "B")).alias("options"), F.when(k == 1, "C").when(k == 2, "1").otherwise("A").alias("answer"), F.lit("s").alias("solution_text"), F.when(k == 3, 2.5).otherwise(2.0).alias("difficulty"), F.when(k == 4, F.array(F.lit("h"), F.lit("h"))).otherwise(F.array(F.lit("h"))).alias("kp_hints"))
    return v.question.select("question_id", F.array_join(jsonx.question_problems(q), ",").alias("problems"))


@query("n9_page_fallback", "SELECT upload_id, staging_id FROM staging WHERE upload_id % 2 = 0 AND staging_id % 3 = 0 UNION ALL SELECT upload_id, staging_id FROM staging s WHERE staging_id % 3 = 1 AND NOT EXISTS (SELECT 1 FROM staging f WHERE f.upload_id = s.upload_id AND f.upload_id % 2 = 0 AND f.staging_id % 3 = 0)")
def _(v):
    from . import ingest

    rows = v.staging.select("upload_id", "staging_id")
    return ingest.first_filled(rows.where("upload_id % 2 = 0 AND staging_id % 3 = 0"), rows.where("staging_id % 3 = 1"), "upload_id").select("upload_id", "staging_id")


@query("n10_flatten", "SELECT staging_id, CAST(c AS INTEGER) AS chapter, 'p' || c || i AS point FROM staging, (SELECT unnest(range(2)) AS c), (SELECT unnest(range(2)) AS i)")
def _(v):
    body = F.lit('{"chapters":[{"no":0,"sections":[{"points":["p00"]}],"points":["p01"]},{"no":1,"sections":[{"points":["p10","p11"]}]}]}')
    chapters = v.staging.select("staging_id", F.explode(jsonx.elements(F.parse_json(body), "chapters")).alias("c"))
    inner = F.flatten(F.transform(jsonx.elements(F.col("c"), "sections"), lambda s: F.try_variant_get(s, "$.points", "array<string>")))
    own = F.coalesce(F.try_variant_get("c", "$.points", "array<string>"), F.array().cast("array<string>"))
    return chapters.select("staging_id", F.try_variant_get("c", "$.no", "int").alias("chapter"), F.explode(F.concat(inner, own)).alias("point"))


@query("n11_source_prefix", "SELECT upload_id, 'ks' || (upload_id % 2 + 1) || '-' || staging_id AS id FROM staging")
def _(v):
    return v.staging.select("upload_id", F.concat(F.lit("ks"), (F.col("upload_id") % 2 + 1).cast("string"), F.lit("-"), S().cast("string")).alias("id"))


@query("n12_last_figure", "SELECT upload_id, CASE WHEN count(*) FILTER (WHERE review_status = 'accepted') > 0 THEN max(staging_id) FILTER (WHERE review_status = 'accepted') ELSE max(staging_id) END AS staging_id FROM staging GROUP BY upload_id")
def _(v):
    return v.staging.groupBy("upload_id").agg(F.max_by("staging_id", F.struct((F.col("review_status") == "accepted"), "staging_id")).alias("staging_id"))


@query("n13_redaction", "SELECT staging_id, '{\"a\":{\"b\":' || staging_id || '}}' AS shown FROM staging")
def _(v):
    raw = F.concat(F.lit('{"question_id":5,"_x":1,"a":{"kpId":3,"b":'), S().cast("string"), F.lit("}}"))
    return v.staging.select("staging_id", udf.redact_json(raw).alias("shown"))


@query("n14_usage_remap", "SELECT staging_id, staging_id % 50 AS input, CAST(greatest(0, staging_id % 9 - 3) AS BIGINT) AS output FROM staging")
def _(v):
    return v.staging.select("staging_id", F.coalesce(S() % 50, F.lit(0)).alias("input"), F.greatest(F.lit(0), S() % 9 - 3).cast("long").alias("output"))


@query("n15_ref_coalesce", "SELECT staging_id, CASE WHEN staging_id % 2 = 0 THEN 7 ELSE 9 END AS page FROM staging")
def _(v):
    p = F.parse_json(pick(S(), '{"source_ref":{"page":7},"source_hint":{"page":9}}', '{"source_hint":{"page":9}}'))
    return v.staging.select("staging_id", F.coalesce(F.try_variant_get(p, "$.source_ref.page", "int"), F.try_variant_get(p, "$.source_hint.page", "int")).alias("page"))


@query("n16_context_lines", "SELECT subject_id, string_agg(n || '. name=' || name || CASE WHEN chapter_no IS NULL THEN '' ELSE '; chapter=' || chapter_no END, chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY kp_id) AS n FROM kp) WHERE n <= 180 GROUP BY subject_id")
def _(v):
    from . import ingest

    rows = ingest.in_order(v.kp, ["subject_id"], "kp_id").where("place <= 180")
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.concat_ws("; ", F.concat(F.lit("name="), "name"), F.concat(F.lit("chapter="), "chapter_no")))
    return rows.groupBy("subject_id").agg(F.array_join(core.ordered_list(["place"], line), "\n").alias("context"))


@query("n17_tables", f"SELECT staging_id, {_sql('staging_id', 'a|b', 'x|y')} AS columns, {_sql('staging_id', '1,2;3,', '1,;,2')} AS rows FROM staging")
def _(v):
    m = jsonx.table_matrix(F.parse_json(pick(S(), '{"headers":["a","b"],"rows":[["1","2"],["3",null]]}', '{"rows":[{"x":1,"y":null},{"y":2}]}')))
    return v.staging.select("staging_id", F.array_join(m["columns"], "|").alias("columns"), F.array_join(F.transform(m["rows"], lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query("n18_related_points", "SELECT staging_id, 'a,b' AS names FROM staging")
def _(v):
    items = jsonx.elements(F.parse_json(F.lit('{"related":["a",{"name":"b"},{"x":1},""]}')), "related")
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    names = F.filter(F.transform(items, name), lambda x: x.isNotNull() & (x != ""))
    return v.staging.select("staging_id", F.array_join(names, ",").alias("names"))


@query("n19_unit_defaults", f"SELECT staging_id, {_sql('staging_id', 3, 1, 1)} AS page, {_sql('staging_id', 'slide', 'text_block', 'page')} AS kind FROM staging")
def _(v):
    p = F.parse_json(pick(S(), '{"pageNo":3,"kind":"PPT"}', '{"page":-2}', '{"unit_kind":"page"}'))
    return v.staging.select("staging_id", F.coalesce(jsonx.positive_page(p, "page_no", "pageNo", "page"), F.lit(1)).alias("page"), text.unit_kind(jsonx.text_field(p, "unit_kind", "unitKind", "kind")).alias("kind"))


@query("n20_answer_draft", f"SELECT staging_id, {_sql('staging_id', 1.0, 0.0, 0.5)} AS confidence, {_sql('staging_id', 'w,v', 'v', 'v')} AS warnings FROM staging")
def _(v):
    p = F.parse_json(pick(S(), '{"confidence":3,"warnings":["w","v"]}', '{"confidence":-1}', '{"confidence":0.5,"warnings":["v"]}'))
    warnings = F.array_distinct(F.concat(F.coalesce(F.try_variant_get(p, "$.warnings", "array<string>"), F.array().cast("array<string>")), F.array(F.lit("v"))))
    return v.staging.select("staging_id", number.clamp(F.try_variant_get(p, "$.confidence", "double"), 0.0, 1.0).alias("confidence"), F.array_join(warnings, ",").alias("warnings"))


@query("n21_image_refs", "SELECT staging_id, 'p1:page,p2:figure' AS refs FROM staging")
def _(v):
    refs = jsonx.elements(F.parse_json(F.lit('{"refs":[{"path":"p1"},{"path":"p2","kind":"figure"},{"kind":"page"}]}')), "refs")
    kept = F.filter(refs, lambda r: F.try_variant_get(r, "$.path", "string").isNotNull())
    shown = F.transform(kept, lambda r: F.concat(F.try_variant_get(r, "$.path", "string"), F.lit(":"), F.coalesce(F.try_variant_get(r, "$.kind", "string"), F.lit("page"))))
    return v.staging.select("staging_id", F.array_join(shown, ",").alias("refs"))


@query("n22_safe_pages", "SELECT upload_id, count(*) AS pages, array_to_string(list(staging_id % 9 ORDER BY staging_id), ',') AS numbers FROM staging GROUP BY upload_id")
def _(v):
    page = F.struct("staging_id", F.get_json_object("payload", "$.page").alias("page"))
    rows = v.staging.groupBy("upload_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    return rows.select("upload_id", F.size("p").cast("long").alias("pages"), F.array_join(F.transform("p", lambda x: x["page"]), ",").alias("numbers"))


@query("n23_enum_default", f"SELECT staging_id, {_sql('staging_id', 'junior', 'senior', 'senior')} AS stage FROM staging")
def _(v):
    raw = pick(S(), "junior", "none", "")
    return v.staging.select("staging_id", F.when(raw.isin("primary", "junior", "senior"), raw).otherwise("senior").alias("stage"))
