"""Queries: scans, sources, sinks, projections and filters (S and F rows of the inventory)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import core
from tallyforge.sources import documents, model_calls, scheduling, shared, store

from .registry import query


@query("s1_table_scan", "SELECT question_id, primary_kp, difficulty, question_type FROM question")
def _(v):
    return v.question.select("question_id", "primary_kp", "difficulty", "question_type")


@query("s2_point_lookup", "SELECT kp_id, name, subject_id FROM kp WHERE kp_id = 7")
def _(v):
    return v.kp.where("kp_id = 7").select("kp_id", "name", "subject_id").limit(1)


@query("s3_raw_sql", "SELECT question_id, stem FROM question WHERE difficulty >= 3 AND primary_kp = 4")
def _(v):
    v.question.createOrReplaceTempView("tallyforge_question")
    return v.spark.sql("SELECT question_id, stem FROM tallyforge_question WHERE difficulty >= :least AND primary_kp = :kp", args={"least": 3, "kp": 4})


@query("s4_file_kinds", "SELECT upload_id, CASE WHEN upload_id % 3 = 0 THEN 'pdf' WHEN upload_id % 3 = 1 THEN 'word' ELSE 'image' END AS kind FROM upload")
def _(v):
    path = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("PDF", "docx", "jpeg"))), (F.col("upload_id") % 3 + 1).cast("int")))
    return v.upload.select("upload_id", documents.file_kind(path).alias("kind"))


@query("s5_page_explode", "SELECT page_id, CAST(i - 1 AS INTEGER) AS part, parts[i] AS body FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS parts FROM pages), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)", views=False)
def _(v):
    return documents.html_pages(v.table("pages"))


@query("s7_model_calls", """WITH h AS (SELECT material_id, title AS prompt, sha256(title) AS d FROM material), k AS (SELECT *, CAST('0x' || substr(d, 1, 2) AS INTEGER) % 10 > 0 AS ok FROM h)
 SELECT material_id, prompt, ok, CASE WHEN ok THEN 200 ELSE 429 END AS http_status, CASE WHEN ok THEN '{"answer": "' || substr(d, 1, 8) || '"}' ELSE 'retry after 2' END AS text, CASE WHEN ok THEN length(prompt) END AS prompt_tokens, CASE WHEN ok THEN 8 END AS completion_tokens FROM k""")
def _(v):
    return model_calls.call(v.material.select("material_id", F.col("title").alias("prompt")), "prompt", model_calls.stub_client, scheduling.Schedule(sleep=scheduling.no_wait))


@query("s8_answer_text", "SELECT staging_id, 'answer ' || staging_id AS text FROM staging")
def _(v):
    text_ = F.concat(F.lit("answer "), F.col("staging_id").cast("string"))
    chat = F.concat(F.lit('{"choices":[{"message":{"content":"'), text_, F.lit('"}}]}'))
    other = F.concat(F.lit('{"content":[{"type":"text","text":"'), text_, F.lit('"}]}'))
    body = F.when(F.col("staging_id") % 2 == 0, chat).otherwise(other)
    return v.staging.select("staging_id", model_calls.answer_text(F.parse_json(body)).alias("text"))


@query("s9_usage", "SELECT staging_id, staging_id % 100 AS prompt, staging_id % 7 AS completion, staging_id % 100 + staging_id % 7 AS total FROM staging")
def _(v):
    a, b = (F.col("staging_id") % 100).cast("string"), (F.col("staging_id") % 7).cast("string")
    one = F.concat(F.lit('{"usage":{"prompt_tokens":'), a, F.lit(',"completion_tokens":'), b, F.lit("}}"))
    two = F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), a, F.lit(',"candidatesTokenCount":'), b, F.lit("}}"))
    return v.staging.select("staging_id", model_calls.usage(F.parse_json(F.when(F.col("staging_id") % 2 == 0, one).otherwise(two))).alias("u")).select("staging_id", "u.prompt", "u.completion", "u.total")


def _stored(v):
    """A store with every upload's bytes under the key of their hash, and its root."""
    root = shared.fresh_folder(v.spark)
    rows = v.table("documents").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("content"))
    own = rows.withColumn("expected", F.sha2("content", 256)).dropDuplicates(["expected"])
    store.put(own.withColumn("key", documents.storage_key(F.col("expected"), F.lit("pdf"))), root)
    return root


@query("s10_content_address", "SELECT sha256(text) AS sha256, 'uploads/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.pdf' AS storage_key, count(*) AS copies, CAST(any_value(strlen(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY ALL", views=False)
def _(v):
    """Uploads are stored by their hash, read back and hashed again; copies share an object."""
    back = store.listing(v.spark, _stored(v), content=True).select(F.col("key").alias("storage_key"), "size", F.sha2("content", 256).alias("sha256"))
    copies = v.upload.where("sha256 IS NOT NULL").groupBy(F.col("sha256").alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    return back.join(copies, F.col("sha256") == F.col("h")).select("sha256", "storage_key", "copies", "size")


@query("s11_prefix_listing", "SELECT DISTINCT 'uploads/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.pdf' AS key, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE sha256(text) LIKE 'a%'", views=False)
def _(v):
    return store.listing(v.spark, _stored(v), "uploads/sha256/a").select("key", "size").orderBy("key")


@query("s13_latest_asset", "SELECT sha256, upload_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY upload_id DESC) AS n FROM upload) WHERE n = 1")
def _(v):
    return v.upload.groupBy("sha256").agg(F.max("upload_id").alias("upload_id"))


@query("s14_bulk_insert", "SELECT attempt_id, student_id FROM attempt UNION ALL SELECT redo_id, student_id FROM redo")
def _(v):
    return v.attempt.select("attempt_id", "student_id").unionByName(v.redo.select(F.col("redo_id").alias("attempt_id"), "student_id"))


@query(
    "s15_upsert",
    """WITH old AS (SELECT student_id, question_id, count(*) AS error_count, max(attempt_id) AS last_id FROM attempt WHERE NOT is_correct AND attempt_id % 2 = 0 GROUP BY ALL),
 new AS (SELECT student_id, question_id, count(*) AS error_count, max(attempt_id) AS last_id FROM attempt WHERE NOT is_correct AND attempt_id % 2 = 1 GROUP BY ALL)
 SELECT student_id, question_id, CAST(coalesce(o.error_count, 0) + coalesce(n.error_count, 0) AS BIGINT) AS error_count, coalesce(n.last_id, o.last_id) AS last_id FROM old o FULL JOIN new n USING (student_id, question_id)""",
)
def _(v):
    wrong = v.attempt.where("NOT is_correct")
    half = lambda k: wrong.where(F.col("attempt_id") % 2 == k).groupBy("student_id", "question_id").agg(F.count(F.lit(1)).alias("error_count"), F.max("attempt_id").alias("last_id"))
    return core.upsert(half(0), half(1), ["student_id", "question_id"], {"error_count": F.col("old.error_count") + F.col("new.error_count")})


@query("s16_update_where", "SELECT upload_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM upload")
def _(v):
    return core.update_where(v.upload, F.col("status").isin("queued", "running"), {"status": F.lit("failed")}).select("upload_id", "status")


@query("s17_cascade_delete", "SELECT staging_id, upload_id FROM staging WHERE upload_id NOT IN (SELECT upload_id FROM upload WHERE status = 'failed')")
def _(v):
    return core.delete_keys(v.staging, v.upload.where("status = 'failed'"), ["upload_id"]).select("staging_id", "upload_id")


@query("s18_last_reference", "SELECT upload_id, sha256 FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n FROM upload) WHERE n = 1")
def _(v):
    return v.upload.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("upload_id").alias("upload_id")).where("n = 1").select("upload_id", "sha256")


@query("s19_orphan_delete", "SELECT kp_id, name FROM kp WHERE kp_id IN (SELECT primary_kp FROM question)")
def _(v):
    return v.kp.join(v.question.select(F.col("primary_kp").alias("kp_id")), "kp_id", "left_semi").select("kp_id", "name")


@query("s20_seed_load", "SELECT subject_id, CASE subject_id WHEN 1 THEN 'MATHS' WHEN 9 THEN 'NEW' ELSE name END AS name FROM (SELECT subject_id, name FROM subject UNION ALL SELECT 9, 'NEW')")
def _(v):
    seed = v.spark.createDataFrame([(1, "MATHS"), (9, "NEW")], "subject_id int, name string")
    return core.upsert(v.subject.select(F.col("subject_id").cast("int"), "name"), seed, ["subject_id"])


@query("s21_payload_log", "SELECT staging_id, '{\"key\":\"api_key=***\",\"body\":\"' || substr(payload, 2, 10) || '...' AS line FROM staging")
def _(v):
    raw = F.concat(F.lit('{"key":"api_key=Abc.123","body":"'), F.substring("payload", 2, 5000))
    return v.staging.select("staging_id", F.concat(F.substring(model_calls.log_text(raw, 43), 1, F.length(F.lit('{"key":"api_key=***","body":"')) + 10), F.lit("...")).alias("line"))


@query("s22_read_modes", "WITH parts AS (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS p, page_id % 3 AS k, html FROM pages) SELECT page_id, 'direct' AS mode, CAST(NULL AS INTEGER) AS page, sha256(html) AS sha256 FROM parts WHERE k = 0 UNION ALL SELECT page_id, CASE k WHEN 1 THEN 'pages' ELSE 'word' END, CAST(i AS INTEGER), sha256(CASE k WHEN 1 THEN p[i] ELSE 'W:' || p[i] END) FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts WHERE k > 0)", views=False)
def _(v):
    """Pages as files of three kinds: images go whole, PDF files by page, Word files by page after a conversion."""
    k = F.col("page_id") % 3
    suffix = F.when(k == 0, ".png").when(k == 1, ".pdf").otherwise(".docx")
    files = v.table("pages").select(F.concat(F.col("page_id").cast("string"), suffix).alias("path"), F.col("html").cast("binary").alias("content"))
    render = lambda _, data: (m.encode() for m in re.findall("<p>([^<]*)", data.decode()))
    convert = lambda _, data: data.replace(b"<p>", b"<p>W:")
    out = documents.read_parts(files.withColumn("kind", documents.file_kind(F.col("path"))), render, convert)
    return out.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("page_id"), "mode", "page", F.sha2("content", 256).alias("sha256"))


@query("s12_delete_blobs", "SELECT 'uploads/sha256/' || substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS key, bool_and(upload_id % 2 = 0) AS gone, CASE WHEN bool_and(upload_id % 2 = 0) THEN NULL ELSE sha256 END AS kept FROM upload WHERE sha256 IS NOT NULL GROUP BY sha256")
def _(v):
    """An object goes with the last upload that refers to it; what is left is got and hashed again."""
    root = _stored(v)
    rows = v.upload.where("sha256 IS NOT NULL").withColumn("key", documents.storage_key(F.col("sha256"), F.lit("pdf")))
    dropped, used = rows.where("upload_id % 2 = 0").select("key"), rows.where("upload_id % 2 = 1").select("key")
    store.delete(dropped.distinct().join(used.distinct(), "key", "left_anti"), root)
    found = shared.written(store.exists(rows.select("key").distinct(), root))
    left = store.get(found.where("found").select("key"), root).select(F.col("key").alias("k"), F.sha2("content", 256).alias("kept"))
    return found.join(left, F.col("key") == F.col("k"), "left").select("key", (~F.col("found")).alias("gone"), "kept")


_FIGURES = "SELECT s.staging_id, s.published_id, u.sha256, 'f' || (s.staging_id % 3) AS figure, CAST(json_extract_string(payload, '$.page') AS INTEGER) AS page FROM staging s LEFT JOIN upload u ON u.upload_id = s.staging_id WHERE s.entity_kind = 'question' AND s.review_status = 'accepted' AND s.published_id IS NOT NULL"


@query("s27_figure_records", f"SELECT staging_id, 'question-' || published_id || '-' || figure || '.png' AS asset_key, 'derived/' || sha256 || '/figure-crop/1/question-' || published_id || '-' || figure || '.png' AS storage_path, page AS source_page FROM ({_FIGURES}) WHERE page > 0")
def _(v):
    return _figures(v)[0].select("staging_id", "asset_key", "storage_path", "source_page")


@query("s28_figure_backfill", f"SELECT count(*) AS scanned, count(*) FILTER (WHERE page <= 0) AS skipped, count(*) FILTER (WHERE page > 0) AS generated, CAST(0 AS BIGINT) AS failed FROM ({_FIGURES})")
def _(v):
    records, scanned = _figures(v)
    return documents.backfill_summary(scanned, records, "staging_id")


def _figures(v):
    asked = v.staging.where("entity_kind = 'question' AND review_status = 'accepted' AND published_id IS NOT NULL").join(v.upload.select(F.col("upload_id").alias("staging_id"), "sha256"), "staging_id", "left")
    page = F.get_json_object("payload", "$.page").cast("int")
    figure = F.struct(F.concat(F.lit("f"), (F.col("staging_id") % 3).cast("string")).alias("id"), page.alias("source_page"), F.array(*[F.lit(x) for x in (0.0, 0.0, 50.0, 50.0)]).alias("bbox"), F.lit("").alias("description"))
    rows = asked.select("staging_id", F.col("published_id").cast("string").alias("question_id"), "sha256", F.array(figure).alias("figures"))
    return documents.figure_records(rows), asked


@query("s23_request_body", "SELECT staging_id, CASE staging_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'input_text' WHEN 2 THEN title ELSE '4096' END AS probe FROM (SELECT staging_id, 'p' || staging_id AS title FROM staging)")
def _(v):
    k = F.col("staging_id") % 4
    shape = F.when(k == 0, "chat").when(k == 1, "responses").when(k == 2, "generate").otherwise("messages")
    body = model_calls.request_body(shape, F.lit("m"), F.concat(F.lit("p"), F.col("staging_id").cast("string")), F.lit("data:x"))
    probe = F.when(k == 0, F.get_json_object(body, "$.messages[0].role")).when(k == 1, F.get_json_object(body, "$.input[0].content[0].type")).when(k == 2, F.get_json_object(body, "$.contents[0].parts[0].text")).otherwise(F.get_json_object(body, "$.max_tokens"))
    return v.staging.select("staging_id", probe.alias("probe"))


@query("s24_provider_target", "SELECT n_nationkey AS provider_id, CASE n_nationkey % 3 WHEN 0 THEN 'responses' WHEN 1 THEN 'generate' ELSE 'chat' END AS shape, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS endpoint_name, CASE WHEN n_nationkey % 5 = 0 THEN 0.5 END AS temperature FROM nation", views=False)
def _(v):
    k = F.col("n_nationkey")
    protocol = F.when(k % 3 == 0, "openai_responses").when(k % 3 == 1, "gemini_native").otherwise("openai_chat")
    target = model_calls.provider_target(protocol, F.when(k % 2 == 0, F.concat(F.lit("env:"), "n_name")).otherwise(F.lit("https://host")), F.lit(0.5), k % 5 == 0, F.lit("max_tokens"))
    return v.table("nation").select(k.alias("provider_id"), target.alias("t")).select("provider_id", "t.shape", "t.endpoint_name", "t.temperature")


@query("s25_alias_lookup", "SELECT customer.c_custkey, n_nationkey AS target FROM customer JOIN nation ON n_nationkey = c_nationkey", views=False)
def _(v):
    targets = v.table("nation").select(F.col("n_nationkey").alias("target"), F.explode(F.array(F.col("n_name"), F.concat(F.lit("alias-"), F.col("n_nationkey").cast("string")))).alias("alias"))
    asked = v.table("customer").select("c_custkey", F.concat(F.lit("alias-"), F.col("c_nationkey").cast("string")).alias("alias"))
    return asked.join(targets, "alias").select("c_custkey", "target")


@query("s29_key_rename", "SELECT material_id, CASE kp_id WHEN 3 THEN 4 WHEN 24 THEN 0 ELSE kp_id END AS kp_id FROM material")
def _(v):
    mapping = v.spark.createDataFrame([(3, 4), (24, 0)], "old_key int, new_key int")
    return core.rename_keys(v.material.select("material_id", "kp_id"), mapping, "kp_id")


@query("s30_preferences", "SELECT student_id, CASE WHEN student_id % 3 = 0 AND student_id % 2 = 0 THEN 'custom' ELSE 'auto' END AS mode, CASE WHEN student_id % 3 = 0 AND student_id % 2 = 0 THEN '10/20/30/40' ELSE '40/30/20/10' END AS weights FROM student")
def _(v):
    """Every third learner asks for weights of their own; those of odd numbers don't add up to 100 and are refused."""
    weights = lambda *w: F.array(*[F.lit(x) for x in w])
    old = v.student.select("student_id", F.lit("auto").alias("mode"), weights(40, 30, 20, 10).alias("weights"))
    asked = v.student.where("student_id % 3 = 0").select("student_id", F.lit("custom").alias("mode"), F.when(F.col("student_id") % 2 == 0, weights(10, 20, 30, 40)).otherwise(weights(10, 20, 30, 50)).alias("weights"))
    out = core.upsert(old, core.sound_preferences(asked), ["student_id"])
    return out.select("student_id", "mode", F.array_join(F.col("weights").cast("array<string>"), "/").alias("weights"))


@query("s31_provider_registry", "SELECT 'p-' || c_nationkey AS id, arg_min(c_custkey, {'own': CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END, 'k': c_custkey}) AS db_id FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey", views=False)
def _(v):
    """Providers that are switched on, listed by public id: the row whose own id is the public one stands before its aliases."""
    rows = v.table("customer").select(F.col("c_custkey").alias("db_id"), F.concat(F.lit("p-"), F.col("c_nationkey").cast("string")).alias("id"), "c_acctbal", F.lit(False).alias("enabled"), (F.col("c_custkey") % 7 == 0).alias("is_own"))
    switched = core.update_where(rows, F.col("c_acctbal") > 5000, {"enabled": F.lit(True)})
    return core.dedupe(switched.where("enabled"), ["id"], [F.col("is_own").desc(), "db_id"]).select("id", "db_id")


@query("s32_enqueue", "SELECT sha256, min(upload_id) AS upload_id, 'job-' || min(upload_id) AS job_id, 'queued' AS status, count(*) - 1 AS repeats FROM upload GROUP BY sha256")
def _(v):
    """One stored upload and one queued job for each content; the files that repeat it are counted."""
    _, jobs = core.enqueue(v.upload, "sha256", "upload_id")
    return jobs.select("sha256", "upload_id", "job_id", "status", "repeats")


@query("f1_projection", "SELECT question_id AS id, primary_kp AS primaryKpId, difficulty FROM question")
def _(v):
    return v.question.select(F.col("question_id").alias("id"), F.col("primary_kp").alias("primaryKpId"), "difficulty")


@query("f2_conjunction", "SELECT attempt_id FROM attempt WHERE is_correct AND student_id = 8")
def _(v):
    return v.attempt.where(F.col("is_correct") & (F.col("student_id") == 8)).select("attempt_id")


@query("f3_in_list", "SELECT question_id FROM question WHERE primary_kp IN (1, 2, 3)")
def _(v):
    return v.question.where(F.col("primary_kp").isin(1, 2, 3)).select("question_id")


@query("f4_range", "SELECT attempt_id FROM attempt WHERE answered_at >= TIMESTAMP '2024-01-10' AND answered_at <= TIMESTAMP '2024-01-12'")
def _(v):
    return v.attempt.where(F.col("answered_at").between("2024-01-10", "2024-01-12")).select("attempt_id")


@query("f5_or_overlap", "SELECT question_id FROM question WHERE primary_kp IN (1, 2) OR list_has_any(kp_ids, [5, 6])")
def _(v):
    return v.question.where(F.col("primary_kp").isin(1, 2) | F.arrays_overlap("kp_ids", F.array(F.lit(5), F.lit(6)))).select("question_id")


@query("f6_null_predicate", "SELECT staging_id FROM staging WHERE published_id IS NOT NULL AND upload_id IN (SELECT upload_id FROM upload WHERE subject_id IS NULL)")
def _(v):
    return v.staging.where("published_id IS NOT NULL").join(v.upload.where("subject_id IS NULL"), "upload_id", "left_semi").select("staging_id")


@query("f7_search", "SELECT question_id, stem FROM question WHERE contains(lower(stem), 'red w')")
def _(v):
    return core.search(v.question, "stem", "Red W").select("question_id", "stem")


@query("f8_prefix", "SELECT question_id FROM question WHERE contains(stem, 'ring') OR starts_with(stem, 'small')")
def _(v):
    return v.question.where(F.col("stem").contains("ring") | F.col("stem").startswith("small")).select("question_id")


@query("f9_array_member", "SELECT question_id FROM question WHERE list_contains(kp_ids, 9)")
def _(v):
    return v.question.where(F.array_contains("kp_ids", 9)).select("question_id")


@query("f10_array_overlap", "SELECT question_id FROM question WHERE list_has_any(kp_ids, [2, 4, 6])")
def _(v):
    return v.question.where(F.arrays_overlap("kp_ids", F.array(*map(F.lit, (2, 4, 6))))).select("question_id")


@query("f11_array_subset", "SELECT question_id FROM question WHERE list_has_all([0, 1, 2, 3, 4, 5, 10, 12], kp_ids)")
def _(v):
    return v.question.where(F.size(F.array_except("kp_ids", F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 10, 12))))) == 0).select("question_id")


@query("f12_optional_filter", "SELECT question_id FROM question WHERE difficulty = 2")
def _(v):
    return core.maybe(core.maybe(v.question, F.col("difficulty") == 2), None).select("question_id")


@query("f13_scope", "SELECT u.student_id, u.kp_id FROM unlocked u JOIN kp USING (kp_id) JOIN student s ON s.student_id = u.student_id WHERE kp.subject_id = s.subject_id")
def _(v):
    from . import learning

    return learning.allowed_points(v.student, v.unlocked, v.kp).select("student_id", "kp_id")


@query("f14_progress_filter", "SELECT student_id, kp_id FROM mastery WHERE CASE WHEN mastery_score < 0.2 AND peak_mastery_score >= 0.5 THEN 'regressed' WHEN mastery_score < 0.5 THEN 'needs_work' ELSE '' END IN ('regressed', 'needs_work')")
def _(v):
    from tallyforge.functions import number

    from . import learning

    rows = learning.mastery(v.graded).withColumn("status", number.progress_status(F.col("mastery_score"), F.col("peak_mastery_score")))
    return rows.where(learning.needs_work()).select("student_id", "kp_id")


@query("f15_drop_invalid", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents WHERE trim(text) <> '' AND n_chars > 0", views=False)
def _(v):
    rows = v.table("documents").where((F.trim("text") != "") & (F.col("n_chars") > 0))
    return rows.select("doc_id", F.col("n_chars").cast("string").try_cast("double").alias("n"))


@query("f16_not_canonical", "SELECT kp_id, ' ' || chapter_no AS chapter_no FROM kp WHERE chapter_no IS NOT NULL")
def _(v):
    raw = v.kp.select("kp_id", F.concat(F.lit(" "), "chapter_no").alias("chapter_no"))
    return raw.where(text.chapter_number(F.col("chapter_no")) != F.col("chapter_no"))


@query("f17_capability", "SELECT staging_id FROM staging WHERE staging_id % 2 = 0")
def _(v):
    caps = F.parse_json(F.when(F.col("staging_id") % 2 == 0, '{"vision":true}').otherwise('{"vision":false}'))
    return v.staging.where(F.try_variant_get(caps, "$.vision", "boolean")).select("staging_id")


_PAGE_WORDS = ("扫码加群", "版权所有", "公众号福利", "名师 教龄", "限时优惠", "目录", "数学讲座", "")
_HITS = ", ".join(f"CASE WHEN regexp_matches(said, '{p}') THEN '{name}' END" for p, name in text.NON_LEARNING)
_OUTSIDE = "CASE WHEN regexp_matches(said, '班主任|公众号|小程序|讲座|福利') AND NOT regexp_matches(said, '集合|函数|数学|物理|化学|语文|英语') THEN 'non_subject_content' END"


@query("f18_non_learning", f"SELECT material_id, array_to_string(list_filter([{_HITS}, {_OUTSIDE}], lambda x: x IS NOT NULL), ',') AS categories FROM (SELECT material_id, coalesce(title, '') || ' ' || {list(_PAGE_WORDS)}[CAST(material_id % {len(_PAGE_WORDS)} + 1 AS INTEGER)] AS said FROM material)")
def _(v):
    word = F.element_at(F.array(*map(F.lit, _PAGE_WORDS)), (F.col("material_id") % len(_PAGE_WORDS) + 1).cast("int"))
    said = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), word)
    return v.material.select("material_id", F.array_join(text.non_learning(said), ",").alias("categories"))


_SAID = "CASE material_id % 6 WHEN 0 THEN title || ' 扫码加群' WHEN 1 THEN '例题：要求 ' || title WHEN 2 THEN '题型一 ' || title || ' ?' WHEN 3 THEN '选择题 知识点' WHEN 4 THEN '' ELSE title END"
_ASKS = "(^|[^要])求|计算|证明|选择|选出|填空|填写|回答|解答|完成|补全|写出|列出|判断|化简|解方程|作图|画出|说明理由|请说明|问[:：]|多少|哪(个|项|一项)|下列|正确|错误|_{2,}|（\\s*）|\\(\\s*\\)|\\?|？"
_TELLS = "题型\\s*[一二三四五六七八九十0-9]+|题型讲解|知识点|方法总结|考点|技巧|口诀|扫码|二维码|公众号|课程|视频|讲解|例题|广告|look at me|看成一个整体|插空法|捆绑法"


@query("f19_question_text", f"SELECT material_id FROM (SELECT material_id, trim(coalesce({_SAID}, '')) <> '' AS filled, regexp_matches(lower({_SAID}), '{_TELLS}') AS tells, regexp_matches(replace({_SAID}, '选择题', ''), '{_ASKS}') AS asks, material_id % 7 = 0 AS opts FROM material WHERE title IS NOT NULL) WHERE (filled OR opts) AND (NOT tells OR asks OR opts)")
def _(v):
    k, title = F.col("material_id") % 6, F.col("title")
    said = F.when(k == 0, F.concat(title, F.lit(" 扫码加群"))).when(k == 1, F.concat(F.lit("例题：要求 "), title)).when(k == 2, F.concat(F.lit("题型一 "), title, F.lit(" ?"))).when(k == 3, "选择题 知识点").when(k == 4, "").otherwise(title)
    none = F.lit(None).cast("string")
    empty = {c: none.alias(c) for c in ("type", "answer_area", "answer", "analysis", "figure_description", "raw_text")}
    options = F.when(F.col("material_id") % 7 == 0, F.array(F.lit("A"), F.lit("B"))).alias("options")
    subs = F.lit(None).cast("array<struct<number:string,stem:string,answer:string,analysis:string>>").alias("sub_questions")
    figures = F.lit(None).cast("array<struct<description:string,labels:array<string>>>").alias("figures")
    question = F.struct(said.alias("stem"), *empty.values(), options, subs, figures)
    return v.material.where("title IS NOT NULL").select("material_id", question.alias("q")).where(text.is_question(F.col("q"))).select("material_id")


@query("f20_preflight", "SELECT question_id, CASE WHEN question_type = 'choice' THEN 'no_options' ELSE '' END AS issues FROM question")
def _(v):
    issues = core.violations((F.trim("stem") == "", "empty_stem"), (F.col("question_type") == "choice", "no_options"), (F.col("stem").contains("如图"), "missing_visual"))
    return v.question.select("question_id", F.array_join(issues, ",").alias("issues"))


@query("f21_bulk_accept", "SELECT s.staging_id, coalesce(CASE WHEN s.staging_id % 5 <> 0 THEN s.staging_id % 2 END, u.subject_id) AS subject_id, CASE WHEN s.staging_id % 5 = 0 AND u.subject_id IS NULL THEN 'missing_subject' ELSE '' END AS skip FROM staging s JOIN upload u ON u.upload_id = s.upload_id WHERE review_status = 'pending' AND entity_kind IN ('source_document', 'learning_material')")
def _(v):
    rows = v.staging.where((F.col("review_status") == "pending") & F.col("entity_kind").isin("source_document", "learning_material"))
    own = F.when(F.col("staging_id") % 5 != 0, F.get_json_object("payload", "$._subject_id").cast("int"))
    rows = rows.join(v.upload.select("upload_id", F.col("subject_id").alias("fallback")), "upload_id").withColumn("subject_id", F.coalesce(own, "fallback"))
    return rows.select("staging_id", "subject_id", F.when(F.col("subject_id").isNull(), "missing_subject").otherwise("").alias("skip"))


@query("f22_storage_guard", "SELECT upload_id, key LIKE 'derived/%' AND NOT contains(key, '..') AND NOT contains(key, chr(92)) AS safe FROM (SELECT upload_id, CASE upload_id % 5 WHEN 0 THEN 'derived/' || sha256 || '.png' WHEN 1 THEN 'derived/../' || sha256 WHEN 2 THEN '/derived/' || sha256 WHEN 3 THEN 'derived/a' || chr(92) || sha256 ELSE sha256 END AS key FROM upload)")
def _(v):
    k, sha = F.col("upload_id") % 5, F.col("sha256")
    key = F.when(k == 0, F.concat(F.lit("derived/"), sha, F.lit(".png"))).when(k == 1, F.concat(F.lit("derived/../"), sha)).when(k == 2, F.concat(F.lit("/derived/"), sha)).when(k == 3, F.concat(F.lit("derived/a\\"), sha)).otherwise(sha)
    return v.upload.select("upload_id", documents.safe_key(key).alias("safe"))


@query("f23_upload_rules", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'too_large' ELSE '' END || CASE WHEN lang NOT IN ('en', 'de') THEN ',bad_type' ELSE '' END AS problems FROM documents", views=False)
def _(v):
    big, bad = F.col("n_chars") > 5000, ~F.col("lang").isin("en", "de")
    return v.table("documents").select("doc_id", F.concat(F.when(big, "too_large").otherwise(""), F.when(bad, ",bad_type").otherwise("")).alias("problems"))


@query("f24_unique_names", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1", views=False)
def _(v):
    return v.table("part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("f25_group_filter", "SELECT upload_id FROM upload WHERE original_name = (SELECT original_name FROM upload WHERE upload_id = 3) AND subject_id = 1")
def _(v):
    group = v.upload.where("upload_id = 3").select("original_name")
    return v.upload.where("subject_id = 1").join(group, "original_name", "left_semi").select("upload_id")


@query("f26_usable_figures", "SELECT staging_id, CAST(CASE WHEN staging_id % 9 > 0 THEN 1 ELSE 0 END AS INTEGER) AS usable FROM staging")
def _(v):
    fig = F.array(F.struct(F.lit("f1").alias("id"), F.get_json_object("payload", "$.page").cast("int").alias("page"), F.lit("[0,0,1,1]").alias("bbox")), F.struct(F.lit(None).cast("string").alias("id"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("bbox")))
    good = F.filter(fig, lambda f: f["id"].isNotNull() & (f["page"] > 0) & f["bbox"].isNotNull())
    return v.staging.select("staging_id", F.size(good).alias("usable"))


@query("f27_missing_relation", "SELECT session_id, NULL::VARCHAR AS advice FROM session")
def _(v):
    there = v.spark.catalog.tableExists("session_review_advice")
    advice = v.spark.table("session_review_advice") if there else v.spark.createDataFrame([], "session_id long, advice string")
    return v.session.select("session_id").join(advice, "session_id", "left")
