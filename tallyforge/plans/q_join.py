"""Queries: joins (J rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import core, fuzzy

from . import learning
from .registry import query

_SCORES = "SELECT u.student_id, u.kp_id, coalesce(m.mastery_score, 0.0) AS score FROM unlocked u LEFT JOIN mastery m USING (student_id, kp_id)"


@query("j1_lookup_left_join", _SCORES)
def _(v):
    return v.unlocked.join(learning.mastery(v.graded), ["student_id", "kp_id"], "left").select("student_id", "kp_id", F.coalesce("mastery_score", F.lit(0.0)).alias("score"))


@query("j2_inner_join", "SELECT attempt_id, q.stem FROM attempt JOIN question q USING (question_id)")
def _(v):
    return v.attempt.join(v.question, "question_id").select("attempt_id", "stem")


@query("j3_semi_join", "SELECT kp_id FROM kp WHERE EXISTS (SELECT 1 FROM material m WHERE m.kp_id = kp.kp_id AND m.material_type = 'exam_trend')")
def _(v):
    return v.kp.join(v.material.where("material_type = 'exam_trend'"), "kp_id", "left_semi").select("kp_id")


@query("j4_anti_join", "SELECT question_id FROM question q WHERE NOT EXISTS (SELECT 1 FROM attempt a WHERE a.question_id = q.question_id)")
def _(v):
    return v.question.join(v.attempt, "question_id", "left_anti").select("question_id")


@query("j5_relation_filter", "SELECT attempt_id FROM graded WHERE primary_kp IN (2, 3)")
def _(v):
    return v.attempt.join(v.question.where(F.col("primary_kp").isin(2, 3)), "question_id").select("attempt_id")


@query("j6_nested_include", "SELECT student_id, array_to_string(list(session_id ORDER BY session_id), ',') AS sessions, max_by(session_id, started_at) AS latest FROM session GROUP BY student_id")
def _(v):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("session_id")), lambda x: x.cast("string")), ",")
    return v.session.groupBy("student_id").agg(ids.alias("sessions"), F.max_by("session_id", "started_at").alias("latest"))


@query("j7_nested_select", "SELECT material_id, kp.name, kp.chapter_no FROM material LEFT JOIN kp USING (kp_id)")
def _(v):
    point = v.kp.select("kp_id", F.struct("name", "chapter_no").alias("point"))
    return v.material.join(point, "kp_id", "left").select("material_id", "point.name", "point.chapter_no")


@query("j8_array_key_join", "SELECT g.session_id, g.kp_id, m.materials, m.newest FROM (SELECT DISTINCT session_id, unnest(kp_ids) AS kp_id FROM graded) g JOIN (SELECT kp_id, count(*) AS materials, max_by(material_id, {'t': created_at, 'i': material_id}) AS newest FROM material GROUP BY kp_id) m USING (kp_id)")
def _(v):
    """A session's points by its questions' arrays, each with its materials counted before the join: no row for each pair of session and material."""
    points = v.graded.select("session_id", F.explode("kp_ids").alias("kp_id")).distinct()
    counted = v.material.groupBy("kp_id").agg(F.count(F.lit(1)).alias("materials"), F.max_by("material_id", F.struct("created_at", "material_id")).alias("newest"))
    return points.join(counted, "kp_id").select("session_id", "kp_id", "materials", "newest")


@query("j9_provenance", "SELECT kp.kp_id, max_by(s.payload, s.staging_id) AS payload FROM kp JOIN staging s ON s.published_id = kp.kp_id AND s.entity_kind = 'knowledge_point' GROUP BY kp.kp_id")
def _(v):
    rows = v.kp.join(v.staging.where("entity_kind = 'knowledge_point'"), F.col("kp_id") == F.col("published_id"))
    return rows.groupBy("kp_id").agg(F.max_by("payload", "staging_id").alias("payload"))


@query("j10_scalar_subquery", "SELECT upload_id, (SELECT min_by(json_extract_string(payload, '$._subject_id'), staging_id) FROM staging s WHERE s.upload_id = u.upload_id) AS first_subject FROM upload u")
def _(v):
    first = v.staging.groupBy("upload_id").agg(F.min_by(F.get_json_object("payload", "$._subject_id"), "staging_id").alias("first_subject"))
    return v.upload.join(first, "upload_id", "left").select("upload_id", "first_subject")


@query("j11_temporal_containment", "SELECT s.session_id, m.question_id FROM session s JOIN mistake m ON m.student_id = s.student_id AND m.resolved_at >= s.started_at AND m.resolved_at <= s.ended_at WHERE EXISTS (SELECT 1 FROM attempt a WHERE a.session_id = s.session_id AND a.question_id = m.question_id AND a.is_correct)")
def _(v):
    book = learning.mistakes(v.attempt).where("status = 'resolved'")
    rows = v.session.join(book, "student_id").where(F.col("resolved_at").between(F.col("started_at"), F.col("ended_at")))
    return rows.join(v.attempt.where("is_correct"), ["session_id", "question_id"], "left_semi").select("session_id", "question_id")


@query("j12_first_tier", "WITH t AS (SELECT upload_id % 10 AS grp, upload_id, CASE WHEN status = 'parsed' THEN 0 ELSE 1 END AS tier FROM upload) SELECT grp, upload_id FROM (SELECT *, min(tier) OVER (PARTITION BY grp) AS m FROM t) WHERE tier = m")
def _(v):
    rows = v.upload.withColumn("grp", F.col("upload_id") % 10)
    return core.first_tier(rows, ["grp"], F.when(F.col("status") == "parsed", 0).otherwise(1)).select("grp", "upload_id")


@query("j13_scope_intersection", "SELECT u.student_id, u.kp_id, coalesce(kp.chapter_no, 'unassigned') AS chapter FROM unlocked u JOIN kp USING (kp_id)")
def _(v):
    scope = learning.textbook_scope(v.kp).select("kp_id", F.col("chapter_no").alias("chapter"))
    return v.unlocked.join(scope, "kp_id").select("student_id", "kp_id", "chapter")


#: Hints made of the points' names, matched again by all their substrings.
HINTS_SQL = """hints AS (SELECT staging_id AS hint_id, subject_id, lower(CASE staging_id % 4 WHEN 0 THEN name WHEN 1 THEN name || ' basics' WHEN 2 THEN substr(name, 1, 3) ELSE 'zz' || substr(name, 2, 3) || 'q' END) AS h FROM staging JOIN kp ON kp.kp_id = staging_id % 25),
asked AS (SELECT DISTINCT subject_id, h FROM hints),
pairs AS (SELECT a.subject_id, a.h, k.kp_id, lower(k.name) AS n FROM asked a JOIN kp k USING (subject_id)),
direct AS (SELECT subject_id, h, kp_id, CASE WHEN h = n THEN 1 ELSE 2 END AS tier, 0 AS shared FROM pairs WHERE contains(h, n) OR contains(n, h)),
parts AS (SELECT DISTINCT h, substr(h, i, l) AS part FROM asked, (SELECT unnest(range(1, 40)) AS i), (SELECT unnest(range(2, 40)) AS l) WHERE i + l - 1 <= length(h)),
common AS (SELECT p.subject_id, p.h, p.kp_id, 4 AS tier, max(length(part)) AS shared FROM pairs p JOIN parts s ON s.h = p.h AND contains(p.n, s.part) WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.subject_id = p.subject_id AND d.h = p.h) GROUP BY ALL),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, h ORDER BY tier, shared DESC, kp_id) AS k FROM (SELECT * FROM direct UNION ALL SELECT * FROM common)) WHERE k = 1)"""


def name_hints(v):
    k, name = F.col("staging_id") % 4, F.col("name")
    hint = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" basics"))).when(k == 2, F.substring(name, 1, 3)).otherwise(F.concat(F.lit("zz"), F.substring(name, 2, 3), F.lit("q")))
    rows = v.staging.withColumn("kp_id", F.col("staging_id") % 25).join(v.kp, "kp_id")
    return rows.select(F.col("staging_id").alias("hint_id"), "subject_id", hint.alias("hint"))


@query("j14_tiered_fuzzy", f"WITH {HINTS_SQL} SELECT hint_id, kp_id, tier FROM hints LEFT JOIN matched USING (subject_id, h)")
def _(v):
    return fuzzy.match_hints(name_hints(v), v.kp)


#: Items with a hint that is a point's name, one that holds it, none but the name in the text, a rule's word, or scraps of a name.
SCORED_SQL = """points AS (SELECT subject_id, kp_id, name, name || ' ' || coalesce(chapter_no, '') || CASE WHEN kp_id % 6 = 0 THEN ' 子集' ELSE '' END AS search FROM kp),
asked AS (SELECT staging_id AS item_id, subject_id, CASE staging_id % 5 WHEN 0 THEN lower(name) WHEN 1 THEN name || ', extra' ELSE '' END AS hint,
 CASE staging_id % 5 WHEN 2 THEN 'about ' || name || ' and more' WHEN 3 THEN '真子集 0' WHEN 4 THEN substr(name, 1, 2) || 'zq' || (staging_id % 7) ELSE '0' END AS item FROM staging JOIN kp ON kp.kp_id = staging_id % 25),
plain AS (SELECT item_id, kp_id, item, search, regexp_replace(lower(item), '[\\s,.]+', '', 'g') AS i, regexp_replace(lower(hint), '[\\s,.]+', '', 'g') AS h, regexp_replace(lower(name), '[\\s,.]+', '', 'g') AS n, regexp_replace(lower(search), '[\\s,.]+', '', 'g') AS s FROM asked JOIN points USING (subject_id)),
shared AS (SELECT *, len(list_intersect(list_distinct(string_split(i, '')), list_distinct(string_split(s, '')))) / least(len(list_distinct(string_split(i, ''))), len(list_distinct(string_split(s, '')))) AS overlap FROM plain),
scores AS (SELECT item_id, kp_id, greatest(CASE WHEN h <> '' AND h = n THEN 0.98 END, CASE WHEN h <> '' AND (contains(s, h) OR contains(h, n)) THEN 0.88 END, CASE WHEN contains(i, n) THEN 0.82 END, CASE WHEN contains(item, '子集') AND contains(search, '子集') THEN 0.84 END, CASE WHEN overlap >= 0.55 THEN 0.62 WHEN overlap >= 0.35 THEN 0.48 ELSE 0 END) AS score FROM shared)"""


@query("j15_scored_match", f"WITH {SCORED_SQL} SELECT item_id, kp_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kp_id) AS k FROM scores WHERE score >= 0.45) WHERE k = 1")
def _(v):
    k, name = F.col("staging_id") % 5, F.col("name")
    search = F.concat(name, F.lit(" "), F.coalesce("chapter_no", F.lit("")), F.when(F.col("kp_id") % 6 == 0, " 子集").otherwise(""))
    points = v.kp.select("subject_id", "kp_id", "name", search.alias("search_text"))
    rows = v.staging.withColumn("kp_id", F.col("staging_id") % 25).join(v.kp, "kp_id")
    hint = F.when(k == 0, F.lower(name)).when(k == 1, F.concat(name, F.lit(", extra"))).otherwise("")
    scraps = F.concat(F.substring(name, 1, 2), F.lit("zq"), (F.col("staging_id") % 7).cast("string"))
    item = F.when(k == 2, F.concat(F.lit("about "), name, F.lit(" and more"))).when(k == 3, "真子集 0").when(k == 4, scraps).otherwise("0")
    return fuzzy.best_match(rows.select(F.col("staging_id").alias("item_id"), "subject_id", item.alias("item_text"), hint.alias("hint")), points, "subject_id")


@query("j16_generated", "SELECT key, min_by(hint, doc_id) AS name FROM (SELECT doc_id, hint, regexp_replace(lower(hint), '[，。、“”‘’；：:,.()\\[\\]{}<>《》【】|_—-]', '', 'g') AS key FROM (SELECT doc_id, regexp_extract(text, '^[^ \\n\\t]+') AS hint FROM documents WHERE text IS NOT NULL)) WHERE key <> '' GROUP BY key", views=False)
def _(v):
    """The first words of texts as hints: one point for each normal form, by its first spelling."""
    items = v.table("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), F.regexp_extract("text", "^[^ \\n\\t]+", 0).alias("hint"))
    return fuzzy.generated_points(items).select(text.knowledge_text(F.col("name")).alias("key"), "name")


@query("j17_tiered_resolution", "WITH asked AS (SELECT staging_id, upload_id % 2 AS subject_id, [published_id, staging_id % 30, NULL] AS ids, [(SELECT name FROM kp WHERE kp_id = staging_id * 3 % 25), 'no such point', ''] AS hints FROM staging), by_id AS (SELECT staging_id, list_sort(list(DISTINCT kp_id)) AS found FROM (SELECT staging_id, subject_id, unnest(ids) AS kp_id FROM asked) JOIN kp USING (subject_id, kp_id) GROUP BY staging_id), by_name AS (SELECT staging_id, list_sort(list(DISTINCT kp_id)) AS found FROM (SELECT staging_id, subject_id, unnest(hints) AS name FROM asked) JOIN kp USING (subject_id, name) GROUP BY staging_id) SELECT staging_id AS item_id, array_to_string(coalesce(i.found, n.found), ',') AS kp_ids, CAST(CASE WHEN i.found IS NOT NULL THEN 1 WHEN n.found IS NOT NULL THEN 2 END AS INTEGER) AS tier FROM asked LEFT JOIN by_id i USING (staging_id) LEFT JOIN by_name n USING (staging_id)")
def _(v):
    """Points by the ids of a payload that the subject knows, else by its hints."""
    third = v.kp.select(F.col("kp_id").alias("third"), "name")
    rows = v.staging.withColumn("third", F.col("staging_id") * 3 % 25).join(third, "third")
    ids = F.array(F.col("published_id"), F.col("staging_id") % 30, F.lit(None).cast("long"))
    items = rows.select(F.col("staging_id").alias("item_id"), (F.col("upload_id") % 2).alias("subject_id"), ids.alias("ids"), F.array("name", F.lit("no such point"), F.lit("")).alias("hints"))
    return fuzzy.resolve_points(items, v.kp).select("item_id", F.array_join(F.transform("kp_ids", lambda x: x.cast("string")), ",").alias("kp_ids"), "tier")


#: Old and new rows of an upload: every fifth row's content is one that its upload shares, every third new row keeps its old number.
RERUN_SQL = """said AS (SELECT *, CASE WHEN staging_id % 5 = 0 THEN 'content that upload ' || upload_id || ' shares' ELSE payload END AS content FROM staging),
o AS (SELECT upload_id, staging_id AS old_id, staging_id // 96 AS number, substr(regexp_replace(content, '\\s+', '', 'g'), 1, 30) AS c FROM said WHERE staging_id % 96 < 48),
n AS (SELECT upload_id, staging_id AS new_id, content, CASE WHEN staging_id % 3 = 0 THEN staging_id // 96 END AS number, substr(regexp_replace(content, '\\s+', '', 'g'), 1, 30) AS c FROM said WHERE staging_id % 96 >= 48),
found AS (SELECT old_id, new_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY tier, new_id) AS k FROM (SELECT old_id, new_id, CASE WHEN o.number = n.number THEN 1 WHEN length(o.c) > 10 AND o.c = n.c THEN 2 ELSE 3 END AS tier FROM o JOIN n USING (upload_id))) WHERE k = 1)"""


def rerun_rows(v):
    content = F.when(F.col("staging_id") % 5 == 0, F.concat(F.lit("content that upload "), F.col("upload_id").cast("string"), F.lit(" shares"))).otherwise(F.col("payload"))
    rows = v.staging.select("upload_id", "staging_id", content.alias("content"), F.expr("staging_id div 96").alias("number"))
    old = rows.where("staging_id % 96 < 48").withColumnRenamed("staging_id", "old_id")
    new = rows.where("staging_id % 96 >= 48").withColumn("number", F.when(F.col("staging_id") % 3 == 0, F.col("number"))).withColumnRenamed("staging_id", "new_id")
    return old, new


@query("j18_rerun_match", f"WITH {RERUN_SQL} SELECT old_id, new_id, CAST(tier AS INTEGER) AS tier FROM found")
def _(v):
    return fuzzy.rerun_match(*rerun_rows(v))


@query("j19_find_or_create", "SELECT DISTINCT s.upload_id, CASE WHEN s.staging_id % 2 = 0 THEN s.staging_id % 9 END AS page FROM staging s WHERE NOT EXISTS (SELECT 1 FROM staging e WHERE e.staging_id < 200 AND e.upload_id = s.upload_id AND (CASE WHEN e.staging_id % 2 = 0 THEN e.staging_id % 9 END) IS NOT DISTINCT FROM (CASE WHEN s.staging_id % 2 = 0 THEN s.staging_id % 9 END))")
def _(v):
    units = v.staging.select("staging_id", "upload_id", F.when(F.col("staging_id") % 2 == 0, F.col("staging_id") % 9).alias("page"))
    there = units.where("staging_id < 200").select(F.col("upload_id").alias("u"), F.col("page").alias("p")).distinct()
    return units.join(there, (F.col("upload_id") == F.col("u")) & F.col("page").eqNullSafe(F.col("p")), "left_anti").select("upload_id", "page").distinct()


@query("j20_ordered_restore", "SELECT session_id, CAST(i - 1 AS INTEGER) AS pos, question_ids[i] AS question_id, q.stem FROM (SELECT *, unnest(range(1, len(question_ids) + 1)) AS i FROM session) JOIN question q ON q.question_id = question_ids[i]")
def _(v):
    return v.session.select("session_id", F.posexplode("question_ids").alias("pos", "question_id")).join(v.question, "question_id").select("session_id", "pos", "question_id", "stem")


@query("j21_completeness", "SELECT session_id, CAST(count(DISTINCT q) AS BIGINT) AS missing FROM (SELECT session_id, unnest(question_ids) AS q FROM session) WHERE q NOT IN (SELECT question_id FROM question WHERE question_id < 20) GROUP BY session_id")
def _(v):
    asked = v.session.select("session_id", F.explode("question_ids").alias("question_id"))
    return core.missing_references(asked, v.question.where("question_id < 20"), ["question_id"]).groupBy("session_id").agg(F.count_distinct("question_id").alias("missing"))


@query("j22_figure_assets", "SELECT s.staging_id, u.sha256 FROM staging s JOIN upload u ON 'q' || s.staging_id || '/f1' = 'q' || u.upload_id || '/f1'")
def _(v):
    key = lambda c: F.concat(F.lit("q"), F.col(c).cast("string"), F.lit("/f1"))
    figures = v.staging.select("staging_id", F.explode(F.array(key("staging_id"))).alias("asset_key"))
    return figures.join(v.upload.select(key("upload_id").alias("asset_key"), "sha256"), "asset_key").select("staging_id", "sha256")


@query("j23_slot_view", "SELECT attempt_id, row_number() OVER (PARTITION BY session_id ORDER BY attempt_id) AS place, coalesce(kp.name, '未命名') AS title FROM graded LEFT JOIN kp ON kp.kp_id = primary_kp AND kp.kp_id <> 3")
def _(v):
    named = v.graded.join(v.kp.where("kp_id <> 3").select("kp_id", "name"), F.col("primary_kp") == F.col("kp_id"), "left")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("attempt_id"))
    return named.select("attempt_id", place.alias("place"), F.coalesce("name", F.lit("未命名")).alias("title"))


@query("j24_missing_default", "SELECT question_id, coalesce(CAST(kp.kp_id AS VARCHAR), '__missing__' || question_id) AS group_key FROM question LEFT JOIN kp ON kp.kp_id = primary_kp AND kp.chapter_no IS NOT NULL")
def _(v):
    known = v.kp.where("chapter_no IS NOT NULL").select("kp_id")
    rows = v.question.join(known, F.col("primary_kp") == F.col("kp_id"), "left")
    return rows.select("question_id", F.coalesce(F.col("kp_id").cast("string"), F.concat(F.lit("__missing__"), F.col("question_id").cast("string"))).alias("group_key"))


@query("j25_point_context", "SELECT subject_id, array_to_string(list(name ORDER BY kp_id), '|') AS names FROM kp GROUP BY subject_id")
def _(v):
    return v.kp.groupBy("subject_id").agg(F.array_join(core.ordered_list(["kp_id"], F.col("name")), "|").alias("names"))


@query("j8b_material_points", "SELECT kp_id, count(*) AS n FROM material JOIN kp USING (kp_id) GROUP BY kp_id")
def _(v):
    return v.material.join(v.kp, "kp_id").groupBy("kp_id").agg(F.count(F.lit(1)).alias("n")).select("kp_id", "n").where(text.blank_to_null(F.col("kp_id").cast("string")).isNotNull())
