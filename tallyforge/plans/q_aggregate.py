"""Queries: aggregations, windows, sorts and set operations (A, W, O and U rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import number, text
from tallyforge.operators import core

from . import ingest, learning
from .registry import query

_STATUS = "CASE WHEN m.mastery_score IS NULL THEN 'not_started' WHEN m.mastery_score < 0.2 AND m.peak_mastery_score >= 0.5 THEN 'regressed' WHEN m.mastery_score < 0.5 THEN 'needs_work' WHEN m.mastery_score < 0.85 THEN 'learning' ELSE 'mastered' END"
ITEMS_SQL = f"""open_kp AS (SELECT DISTINCT m.student_id, q.primary_kp AS kp_id FROM mistake m JOIN question q USING (question_id) WHERE m.status = 'open'),
due_kp AS (SELECT student_id, kp_id FROM review, now_at WHERE next_review_at <= now),
items AS (SELECT u.student_id, u.kp_id, kp.name, kp.chapter_no, {_STATUS} AS status, CAST(floor(coalesce(m.mastery_score, 0) * 100 + 0.5) AS INTEGER) AS progress_percent, coalesce(m.attempts, 0) AS practice_count, o.kp_id IS NOT NULL AS has_open_mistake, d.kp_id IS NOT NULL AS needs_review
 FROM unlocked u JOIN kp USING (kp_id) LEFT JOIN mastery m ON m.student_id = u.student_id AND m.kp_id = u.kp_id LEFT JOIN open_kp o ON o.student_id = u.student_id AND o.kp_id = u.kp_id LEFT JOIN due_kp d ON d.student_id = u.student_id AND d.kp_id = u.kp_id)"""
_WORK = "status IN ('needs_work', 'regressed')"


def items(v):
    return learning.progress_items(v.unlocked.join(v.kp, "kp_id").select("student_id", "kp_id", "name", "chapter_no"), learning.mastery(v.graded), learning.mistakes(v.attempt), learning.reviews(v.graded), v.question, v.now)


@query("a1_count", "SELECT count(*) AS n FROM attempt WHERE is_correct")
def _(v):
    return v.attempt.where("is_correct").agg(F.count(F.lit(1)).alias("n"))


@query("a2_group_count", "SELECT kp_id, count(*) AS n FROM material GROUP BY kp_id")
def _(v):
    return v.material.groupBy("kp_id").agg(F.count(F.lit(1)).alias("n"))


@query("a3_unnest_count", "SELECT kp_id, count(*) AS n FROM (SELECT unnest(kp_ids) AS kp_id FROM question) GROUP BY kp_id")
def _(v):
    return v.question.select(F.explode("kp_ids").alias("kp_id")).groupBy("kp_id").agg(F.count(F.lit(1)).alias("n"))


@query("a4_relation_count", "SELECT u.upload_id, count(s.staging_id) AS n FROM upload u LEFT JOIN staging s USING (upload_id) GROUP BY u.upload_id")
def _(v):
    counts = v.staging.groupBy("upload_id").agg(F.count(F.lit(1)).alias("c"))
    return v.upload.join(counts, "upload_id", "left").select("upload_id", F.coalesce("c", F.lit(0)).alias("n"))


@query("a5_count_max", "SELECT student_id, primary_kp AS kp_id, count(*) AS n, epoch_us(max(answered_at)) AS last_us FROM graded GROUP BY ALL")
def _(v):
    return v.graded.groupBy("student_id", F.col("primary_kp").alias("kp_id")).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("answered_at")).alias("last_us"))


@query("a6_conditional_counts", f"WITH {ITEMS_SQL} SELECT student_id, count(*) AS unlocked_count, count(*) FILTER (WHERE status <> 'not_started' OR practice_count > 0) AS started_count, count(*) FILTER (WHERE status = 'mastered') AS mastered_count, count(*) FILTER (WHERE {_WORK} OR has_open_mistake) AS needs_work_count FROM items GROUP BY student_id")
def _(v):
    return learning.progress_summary(items(v))


_BAND = "CASE WHEN coalesce(m.mastery_score, 0) < 0.2 THEN 'not_started' WHEN m.mastery_score < 0.5 THEN 'needs_work' WHEN m.mastery_score < 0.85 THEN 'learning' ELSE 'mastered' END"


@query("a7_histogram", "SELECT student_id, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS {b}" for b in ("not_started", "needs_work", "learning", "mastered")) + f" FROM (SELECT u.student_id, {_BAND} AS band FROM unlocked u LEFT JOIN mastery m USING (student_id, kp_id)) GROUP BY student_id")
def _(v):
    bands = v.unlocked.join(learning.mastery(v.graded), ["student_id", "kp_id"], "left").withColumn("band", number.mastery_band(F.coalesce("mastery_score", F.lit(0.0))))
    names = ["not_started", "needs_work", "learning", "mastered"]
    return bands.groupBy("student_id").pivot("band", names).agg(F.count(F.lit(1))).fillna(0, names)


_LABEL = "CASE WHEN chapter_no IS NULL THEN '未分章' ELSE '第 ' || split_part(chapter_no, '.', 1) || ' 章' END"


@query("a8_rollup", f"WITH {ITEMS_SQL} SELECT student_id, {_LABEL} AS label, count(*) AS item_count, count(*) FILTER (WHERE {_WORK} OR has_open_mistake) AS needs_work_count, count(*) FILTER (WHERE status = 'mastered') AS mastered_count, bool_or({_WORK} OR has_open_mistake OR needs_review) AS default_open FROM items GROUP BY ALL")
def _(v):
    return learning.progress_groups(items(v), text.chapter_label(F.col("chapter_no")))


@query("a9_hierarchy", "SELECT kp.subject_id, count(DISTINCT kp.kp_id) AS kp_total, CAST(sum(n) AS BIGINT) AS question_total, max(n) AS question_max FROM kp JOIN (SELECT primary_kp, count(*) AS n FROM question GROUP BY primary_kp) q ON q.primary_kp = kp.kp_id GROUP BY kp.subject_id")
def _(v):
    per = v.question.groupBy(F.col("primary_kp").alias("kp_id")).agg(F.count(F.lit(1)).alias("n"))
    return v.kp.join(per, "kp_id").groupBy("subject_id").agg(F.count_distinct("kp_id").alias("kp_total"), F.sum("n").alias("question_total"), F.max("n").alias("question_max"))


@query("a10_mode", "SELECT kp_id, title FROM (SELECT kp_id, title, row_number() OVER (PARTITION BY kp_id ORDER BY count(*) DESC, min(material_id)) AS n FROM material GROUP BY kp_id, title) WHERE n = 1")
def _(v):
    counted = v.material.groupBy("kp_id", "title").agg(F.count(F.lit(1)).alias("n"), F.min("material_id").alias("first"))
    return counted.groupBy("kp_id").agg(F.max_by("title", F.struct("n", F.negative("first"))).alias("title"))


@query("a11_ratio", "SELECT session_id, CAST(floor(100.0 * count(*) FILTER (WHERE is_correct) / count(*) + 0.5) AS INTEGER) AS accuracy FROM attempt GROUP BY session_id")
def _(v):
    share = F.count_if("is_correct") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return v.attempt.groupBy("session_id").agg(F.coalesce(F.floor(share * 100 + 0.5), F.lit(0)).cast("int").alias("accuracy"))


@query("a12_ordered_groups", "SELECT student_id, array_to_string(list(question_id ORDER BY error_count DESC, last_at DESC, question_id), ',') AS questions FROM mistake WHERE status = 'open' GROUP BY student_id")
def _(v):
    book = learning.mistakes(v.attempt).where("status = 'open'").withColumns({"e": F.negative("error_count"), "t": F.negative(F.unix_micros("last_at"))})
    return book.groupBy("student_id").agg(F.array_join(core.ordered_list(["e", "t", "question_id"], F.col("question_id").cast("string")), ",").alias("questions"))


@query("a13_argmax", "SELECT student_id, question_id, max(attempt_id) AS attempt_id FROM attempt GROUP BY ALL")
def _(v):
    return v.attempt.groupBy("student_id", "question_id").agg(F.max_by("attempt_id", F.struct("answered_at", "attempt_id")).alias("attempt_id"))


@query("a14_sum_and_count", "SELECT q.primary_kp AS kp_id, CAST(sum(error_count) AS BIGINT) AS errors, count(*) FILTER (WHERE status = 'open') AS open FROM mistake JOIN question q USING (question_id) GROUP BY q.primary_kp")
def _(v):
    book = learning.mistakes(v.attempt).join(v.question.select("question_id", F.col("primary_kp").alias("kp_id")), "question_id")
    return book.groupBy("kp_id").agg(F.sum("error_count").alias("errors"), F.count_if(F.col("status") == "open").alias("open"))


STATS_SQL = "placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY attempt_id) - 1 AS place FROM graded), stats AS (SELECT session_id, p.student_id, p.kp_id, count(*) FILTER (WHERE is_correct) AS correct_count, count(*) AS total_count, CAST(min(place) AS INTEGER) AS first_seen FROM (SELECT *, unnest(kp_ids) AS kp_id FROM placed) p JOIN unlocked u ON u.student_id = p.student_id AND u.kp_id = p.kp_id GROUP BY ALL)"


@query("a15_point_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def _(v):
    return learning.point_stats(v.graded, v.unlocked)


@query("a16_ordered_distinct", "SELECT session_id, array_to_string(list(q ORDER BY first), ',') AS questions FROM (SELECT session_id, question_id AS q, min(attempt_id) AS first FROM attempt GROUP BY ALL) GROUP BY session_id")
def _(v):
    return v.session.select("session_id", F.array_join(F.transform(F.array_distinct("question_ids"), lambda x: x.cast("string")), ",").alias("questions"))


@query("a17_dedupe", "SELECT material_id FROM (SELECT *, row_number() OVER (PARTITION BY kp_id, material_type ORDER BY material_id) AS n FROM material) WHERE n = 1")
def _(v):
    return core.dedupe(v.material, ["kp_id", "material_type"], ["material_id"]).select("material_id")


@query("a18_merge_duplicates", "SELECT kp_id, array_to_string(list_sort(list_distinct(list(material_id % 10))), ',') AS pages, min_by(trim(title), material_id) AS title FROM material GROUP BY kp_id")
def _(v):
    pages = F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("material_id") % 10))))), lambda x: x.cast("string")), ",")
    return v.material.groupBy("kp_id").agg(pages.alias("pages"), core.first_by(text.blank_to_null(F.col("title")), F.col("material_id")).alias("title"))


@query("a19_nullable_sum", "SELECT upload_id, CAST(sum(published_id) AS BIGINT) AS total FROM staging GROUP BY upload_id")
def _(v):
    return v.staging.groupBy("upload_id").agg(F.sum("published_id").alias("total"))


@query("a20_all_ok", "SELECT upload_id, bool_and(review_status <> 'rejected') AS ok, max_by(review_status, staging_id) AS last_status, CAST(sum(staging_id) AS BIGINT) AS latency FROM staging GROUP BY upload_id")
def _(v):
    return v.staging.groupBy("upload_id").agg(F.bool_and(F.col("review_status") != "rejected").alias("ok"), F.max_by("review_status", "staging_id").alias("last_status"), F.sum("staging_id").alias("latency"))


@query("a21_logical_files", "SELECT original_name, max(upload_id) AS canonical, max_by(subject_id, upload_id) FILTER (WHERE subject_id IS NOT NULL) AS subject_id, count(*) AS copies FROM upload GROUP BY original_name")
def _(v):
    return v.upload.groupBy("original_name").agg(F.max("upload_id").alias("canonical"), F.max_by("subject_id", F.when(F.col("subject_id").isNotNull(), F.col("upload_id"))).alias("subject_id"), F.count(F.lit(1)).alias("copies"))


@query("a22_preferred_row", "SELECT sha256, upload_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY CASE WHEN status = 'parsed' THEN 0 ELSE 1 END, upload_id) AS n FROM upload) WHERE n = 1")
def _(v):
    return v.upload.groupBy("sha256").agg(F.min_by("upload_id", F.struct((F.col("status") != "parsed"), "upload_id")).alias("upload_id"))


#: Materials and questions with their point, where they come from and how well they match; point 24 is not known.
_THREAD_ITEMS = """mixed AS (SELECT CASE WHEN kp_id < 24 THEN kp_id END AS kp_id, material_type AS kind, material_id AS item_id, 'u' || (material_id % 48) || '/p' || (material_id % 9) AS source_ref, 0.5 + (material_id % 50) / 100.0 AS score FROM material
 UNION ALL SELECT CASE WHEN primary_kp < 24 THEN primary_kp END, 'question', question_id, 'q' || (question_id % 20), 0.9 FROM question),
placed AS (SELECT *, (row_number() OVER (PARTITION BY kp_id ORDER BY list_position(['method_card', 'common_mistake', 'question_type_summary', 'solution_summary', 'concept_explanation', 'textbook_deep_dive', 'exam_trend', 'study_advice', 'question'], kind), item_id) - 1) // 256 AS part FROM mixed WHERE kp_id IS NOT NULL)"""


def _thread_items(v):
    known = lambda c: F.when(F.col(c) < 24, F.col(c).cast("long"))
    m, q = F.col("material_id"), F.col("question_id")
    ref = F.concat(F.lit("u"), (m % 48).cast("string"), F.lit("/p"), (m % 9).cast("string"))
    materials = v.material.select(known("kp_id").alias("kp_id"), F.col("material_type").alias("kind"), m.alias("item_id"), ref.alias("source_ref"), (F.lit(0.5) + (m % 50) / 100.0).alias("score"))
    return materials.unionByName(v.question.select(known("primary_kp").alias("kp_id"), F.lit("question").alias("kind"), q.alias("item_id"), F.concat(F.lit("q"), (q % 20).cast("string")).alias("source_ref"), F.lit(0.9).alias("score")))


_LISTS_SQL = ", ".join(f"coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (WHERE kind = '{k}'), '') AS {name}" for k, name in {**ingest.THREAD_KEYS, "question": "questions"}.items())


@query("a23_thread_assembly", f"WITH {_THREAD_ITEMS} SELECT kp_id, CAST(part AS INTEGER) AS part, {_LISTS_SQL}, array_to_string(list_sort(list(DISTINCT source_ref)), ',') AS source_refs, CAST(max(score) AS DOUBLE) AS match_confidence FROM placed GROUP BY kp_id, part")
def _(v):
    """Threads with all eight lists, questions, sources and confidence."""
    threads = ingest.assemble_threads(_thread_items(v))
    shown = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in (*ingest.THREAD_KEYS.values(), "questions", "source_refs")]
    return threads.select("kp_id", "part", *shown, "match_confidence")


@query("a24_thread_flatten", f"WITH {_THREAD_ITEMS} SELECT CASE WHEN kp_id IS NULL THEN 'knowledge_point' WHEN kind = 'question' THEN 'question' ELSE 'learning_material' END AS entity_kind, kp_id, CASE WHEN kp_id IS NOT NULL AND kind <> 'question' THEN kind END AS material_type, item_id FROM mixed WHERE kp_id IS NOT NULL OR (kind <> 'question' AND item_id % 2 = 0)")
def _(v):
    """Threads taken apart again; of the items without a point every other one is a point itself."""
    items_ = _thread_items(v)
    kind = F.when(F.col("kind") == "question", "question").when(F.col("item_id") % 2 == 0, "knowledge_point").otherwise("learning_material")
    return ingest.flatten_threads(ingest.assemble_threads(items_), items_.where("kp_id IS NULL").select("item_id", kind.alias("item_type")))


@query("a25_type_order", "SELECT kp_id, array_to_string(list(DISTINCT material_type ORDER BY material_type), ',') AS types FROM material GROUP BY kp_id")
def _(v):
    return v.material.groupBy("kp_id").agg(F.array_join(F.array_sort(F.collect_set("material_type")), ",").alias("types"))


@query("a26_batch_counters", "SELECT CAST(sum(len(kp_ids)) AS BIGINT) AS mappings, count(*) AS questions FROM question")
def _(v):
    return v.question.agg(F.sum(F.size("kp_ids")).alias("mappings"), F.count(F.lit(1)).alias("questions"))


@query("a27_dashboard", "SELECT q.primary_kp AS kp_id, CAST(sum(error_count) AS BIGINT) AS mistakes, count(DISTINCT student_id) AS students FROM mistake JOIN question q USING (question_id) GROUP BY q.primary_kp ORDER BY mistakes DESC, kp_id LIMIT 10")
def _(v):
    book = learning.mistakes(v.attempt).join(v.question.select("question_id", F.col("primary_kp").alias("kp_id")), "question_id")
    return book.groupBy("kp_id").agg(F.sum("error_count").alias("mistakes"), F.count_distinct("student_id").alias("students")).orderBy(F.col("mistakes").desc(), "kp_id").limit(10)


@query("a28_quality", "SELECT round(avg(CASE WHEN review_status = 'accepted' THEN 1.0 ELSE 0.0 END), 6) AS accept_rate, quantile_cont(CAST(staging_id AS DOUBLE), 0.95) AS p95 FROM staging")
def _(v):
    return v.staging.agg(F.round(F.avg(F.when(F.col("review_status") == "accepted", 1.0).otherwise(0.0)), 6).alias("accept_rate"), F.percentile(F.col("staging_id").cast("double"), 0.95).alias("p95"))


@query("a29_weighted_mean", "SELECT student_id, round(sum(mastery_score * (1 + kp_id % 3)) / sum(1 + kp_id % 3), 6) AS progress FROM mastery GROUP BY student_id")
def _(v):
    w = F.col("kp_id") % 3 + 1
    return learning.mastery(v.graded).groupBy("student_id").agg(F.round(F.sum(F.col("mastery_score") * w) / F.sum(w), 6).alias("progress"))


@query("a30_page_candidates", "SELECT upload_id, CAST(sum(CASE WHEN staging_id % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS n FROM staging GROUP BY upload_id")
def _(v):
    page = F.when(F.col("staging_id") % 3 == 0, "oops").otherwise('[{"a":1},{"b":2}]')
    return v.staging.groupBy("upload_id").agg(F.sum(F.coalesce(F.json_array_length(page), F.lit(0))).alias("n"))


@query("a31_sections", f"SELECT {_LABEL} AS chapter, array_to_string(list(name ORDER BY kp_id), '|') AS points FROM kp GROUP BY 1")
def _(v):
    return v.kp.groupBy(text.chapter_label(F.col("chapter_no")).alias("chapter")).agg(F.array_join(core.ordered_list(["kp_id"], F.col("name")), "|").alias("points"))


@query("a32_coverage", "SELECT upload_id, CASE WHEN upload_id % 3 = 0 THEN count(*) ELSE NULL END AS inputs, count(DISTINCT published_id) AS points, CASE WHEN upload_id % 4 = 0 THEN (upload_id + 1) || '-' || (upload_id + 9) ELSE '100-180' END AS expected, CASE WHEN upload_id % 2 = 0 THEN 'note ' || upload_id ELSE '' END AS notes FROM staging GROUP BY upload_id")
def _(v):
    """The model's summary of each upload under one spelling or another, or without some of its parts."""
    got = v.staging.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("published_id").alias("points"))
    u = F.col("upload_id")
    parts = [
        F.when(u % 3 == 0, F.concat(F.when(u % 2 == 0, '"input_candidate_count":').otherwise('"inputCandidateCount":'), F.col("n").cast("string"))),
        F.when(u % 4 == 0, F.concat(F.lit('"expectedRange":"'), (u + 1).cast("string"), F.lit("-"), (u + 9).cast("string"), F.lit('"'))),
        F.when(u % 2 == 0, F.concat(F.lit('"coverage_notes":[" note '), u.cast("string"), F.lit('",""]'))),
    ]
    summary = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    c = ingest.coverage(summary, F.col("points"))
    return got.select("upload_id", c.alias("c")).select("upload_id", F.col("c.input_candidate_count").cast("long").alias("inputs"), F.col("c.output_knowledge_point_count").alias("points"), F.col("c.expected_range").alias("expected"), F.array_join("c.coverage_notes", "|").alias("notes"))


_CHECKS_SQL = """checks AS (SELECT 'materials_found' AS name, count(*) > 0 AS passed, count(*) AS detail FROM material
UNION ALL SELECT 'titles_filled', count(*) = 0, count(*) FROM material WHERE title IS NULL OR trim(title) = ''
UNION ALL SELECT 'types_known', count(*) = 0, count(*) FROM material WHERE material_type = 'study_advice'
UNION ALL SELECT 'questions_found', count(*) > 0, count(*) FROM question
UNION ALL SELECT 'stems_filled', count(*) = 0, count(*) FROM question WHERE trim(stem) = ''
UNION ALL SELECT 'levels_in_range', count(*) = 0, count(*) FROM question WHERE difficulty NOT BETWEEN 1 AND 5
UNION ALL SELECT 'points_unique', count(*) = 0, count(*) FROM question WHERE len(kp_ids) <> len(list_distinct(kp_ids))
UNION ALL SELECT 'first_point_listed', count(*) = 0, count(*) FROM question WHERE NOT list_contains(kp_ids, primary_kp)
UNION ALL SELECT 'staged_found', count(*) > 0, count(*) FROM staging
UNION ALL SELECT 'pages_from_one', count(*) = 0, count(*) FROM staging WHERE NOT coalesce(CAST(json_extract_string(payload, '$.page') AS INTEGER) > 0, false)
UNION ALL SELECT 'accepted_published', count(*) = 0, count(*) FROM staging WHERE review_status = 'accepted' AND published_id IS NULL)"""


@query("a33_verification", f"WITH {_CHECKS_SQL} SELECT * FROM checks UNION ALL SELECT 'ok', bool_and(passed), count(*) FILTER (WHERE NOT passed) FROM checks")
def _(v):
    checks = {
        "titles_filled": ("materials", F.trim("title") != ""), "types_known": ("materials", F.col("material_type") != "study_advice"),
        "stems_filled": ("questions", F.trim("stem") != ""), "levels_in_range": ("questions", F.col("difficulty").between(1, 5)), "points_unique": ("questions", F.size("kp_ids") == F.size(F.array_distinct("kp_ids"))), "first_point_listed": ("questions", F.array_contains("kp_ids", F.col("primary_kp"))),
        "pages_from_one": ("staged", F.get_json_object("payload", "$.page").cast("int") > 0), "accepted_published": ("staged", (F.col("review_status") != "accepted") | F.col("published_id").isNotNull()),
    }
    return ingest.verification({"materials": v.material, "questions": v.question, "staged": v.staging}, checks)


@query("a34_dashboard_counts", "SELECT student_id, count(*) AS unlocked, count(*) FILTER (WHERE (SELECT count(*) FROM session s WHERE s.student_id = u.student_id AND s.ended_at >= date_trunc('week', (SELECT now FROM now_at))) > 0) > 0 AS active FROM unlocked u GROUP BY student_id")
def _(v):
    week = v.session.where(F.col("ended_at") >= F.date_trunc("week", v.now)).select("student_id", F.lit(True).alias("a")).distinct()
    return v.unlocked.groupBy("student_id").agg(F.count(F.lit(1)).alias("unlocked")).join(week, "student_id", "left").select("student_id", "unlocked", F.coalesce("a", F.lit(False)).alias("active"))


@query("w1_position", "SELECT attempt_id, row_number() OVER (PARTITION BY session_id ORDER BY answered_at, attempt_id) AS pos FROM attempt")
def _(v):
    return v.attempt.select("attempt_id", F.row_number().over(Window.partitionBy("session_id").orderBy("answered_at", "attempt_id")).alias("pos"))


@query("w2_top_one", "SELECT kp_id, material_id FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY created_at DESC, material_id) AS n FROM material) WHERE n = 1")
def _(v):
    return core.top_k(v.material, ["kp_id"], [F.col("created_at").desc(), "material_id"], 1).select("kp_id", "material_id")


@query("w3_top_k_by_group", "SELECT kp_id, material_id FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY material_id) AS n FROM material) WHERE n <= 1 + kp_id % 3")
def _(v):
    n = F.row_number().over(Window.partitionBy("kp_id").orderBy("material_id"))
    return v.material.withColumn("n", n).where("n <= 1 + kp_id % 3").select("kp_id", "material_id")


@query("w4_backfill", "SELECT kp_id, material_id FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY CASE WHEN n <= 2 AND material_type = 'exam_trend' THEN 0 ELSE 1 END, material_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kp_id, material_type ORDER BY material_id) AS n FROM material)) WHERE place <= 5")
def _(v):
    n = F.row_number().over(Window.partitionBy("kp_id", "material_type").orderBy("material_id"))
    turn = F.when((F.col("n") <= 2) & (F.col("material_type") == "exam_trend"), 0).otherwise(1)
    return core.top_k(v.material.withColumn("n", n).withColumn("turn", turn), ["kp_id"], ["turn", "material_id"], 5).select("kp_id", "material_id")


@query("w5_one_per_key", "SELECT question_id FROM (SELECT *, row_number() OVER (PARTITION BY primary_kp ORDER BY created_at, difficulty, question_id) AS n FROM question) WHERE n = 1 ORDER BY primary_kp LIMIT 8")
def _(v):
    return core.dedupe(v.question, ["primary_kp"], ["created_at", "difficulty", "question_id"]).orderBy("primary_kp").limit(8).select("question_id")


@query("w6_mastery_fold", "SELECT student_id, kp_id, mastery_score, peak_mastery_score, attempts FROM mastery")
def _(v):
    return learning.mastery(v.graded).drop("last_at")


@query("w7_mistake_machine", "SELECT student_id, question_id, error_count, streak, status, epoch_us(resolved_at) AS resolved_us, epoch_us(created_at) AS created_us FROM mistake")
def _(v):
    book = learning.mistakes(v.attempt)
    return book.select("student_id", "question_id", "error_count", "streak", "status", F.unix_micros("resolved_at").alias("resolved_us"), F.unix_micros("created_at").alias("created_us"))


@query("w8_first_seen", "SELECT student_id, primary_kp AS kp_id, min(attempt_id) AS attempt_id FROM graded GROUP BY ALL")
def _(v):
    return core.dedupe(v.graded, ["student_id", "primary_kp"], ["answered_at", "attempt_id"]).select("student_id", F.col("primary_kp").alias("kp_id"), "attempt_id")


_NATURAL = "CASE WHEN chapter_no IS NULL THEN 'zzzz' ELSE lpad(split_part(chapter_no, '.', 1), 10, '0') || '.' || lpad(split_part(chapter_no, '.', 2), 10, '0') END"


@query("w9_sort_order", f"SELECT subject_id, kp_id, coalesce(chapter_no, 'unassigned') AS chapter_no, dense_rank() OVER (PARTITION BY subject_id ORDER BY {_NATURAL}) AS chapter_order, row_number() OVER (PARTITION BY subject_id ORDER BY {_NATURAL}, kp_id) AS sort_order FROM kp")
def _(v):
    return learning.textbook_scope(v.kp)


@query("w10_last_wins", "SELECT published_id, max(staging_id) AS staging_id FROM staging WHERE published_id IS NOT NULL GROUP BY published_id")
def _(v):
    return core.dedupe(v.staging.where("published_id IS NOT NULL"), ["published_id"], [F.col("staging_id").desc()]).select("published_id", "staging_id")


@query("w11_sequential_ids", "SELECT kp_id, title, 'kp-' || row_number() OVER (PARTITION BY kp_id ORDER BY first) AS id FROM (SELECT kp_id, title, min(material_id) AS first FROM material GROUP BY kp_id, title)")
def _(v):
    """Ids run over the distinct names of each document."""
    first = v.material.groupBy("kp_id", "title").agg(F.min("material_id").alias("first"))
    return first.select("kp_id", "title", F.concat(F.lit("kp-"), F.row_number().over(Window.partitionBy("kp_id").orderBy("first")).cast("string")).alias("id"))


@query("o1_multi_key", "SELECT question_id, row_number() OVER (ORDER BY difficulty DESC, question_id) AS place FROM question ORDER BY difficulty DESC, question_id LIMIT 50")
def _(v):
    top = v.question.orderBy(F.col("difficulty").desc(), F.col("question_id").asc_nulls_last()).limit(50)
    return top.select("question_id", F.row_number().over(Window.orderBy(F.col("difficulty").desc(), "question_id")).alias("place"))


@query("o2_limit", "SELECT session_id FROM session ORDER BY ended_at DESC, session_id LIMIT 20")
def _(v):
    return v.session.orderBy(F.col("ended_at").desc(), "session_id").limit(20).select("session_id")


@query("o3_natural_chapters", f"SELECT kp_id, dense_rank() OVER (ORDER BY {_NATURAL}) AS place FROM kp")
def _(v):
    return v.kp.select("kp_id", F.dense_rank().over(Window.orderBy(text.natural_key(F.col("chapter_no")))).alias("place"))


_PRIORITY = "CASE WHEN status = 'regressed' THEN 0 WHEN status = 'needs_work' THEN 1 WHEN needs_review THEN 2 WHEN has_open_mistake THEN 3 WHEN status = 'learning' THEN 4 WHEN status = 'not_started' THEN 5 ELSE 6 END"


@query("o4_progress_priority", f"WITH {ITEMS_SQL} SELECT student_id, kp_id, row_number() OVER (PARTITION BY student_id ORDER BY {_PRIORITY}, {_NATURAL}, kp_id) AS place FROM items")
def _(v):
    order = Window.partitionBy("student_id").orderBy(learning.progress_priority(), text.natural_key(F.col("chapter_no")), "kp_id")
    return items(v).select("student_id", "kp_id", F.row_number().over(order).alias("place"))


@query("o5_material_priority", "SELECT kp_id, material_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY list_position(['common_mistake','method_card','solution_summary','question_type_summary','concept_explanation','textbook_deep_dive','exam_trend','study_advice'], material_type), created_at DESC, material_id) AS n FROM material) WHERE n <= 5")
def _(v):
    place = F.array_position(F.array(*map(F.lit, learning.WORK_ORDER)), F.col("material_type"))
    n = F.row_number().over(Window.partitionBy("kp_id").orderBy(place, F.col("created_at").desc(), "material_id"))
    return v.material.withColumn("place", n).where("place <= 5").select("kp_id", "material_id", "place")


@query("o6_group_priority", f"WITH {STATS_SQL} SELECT session_id, kp_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN correct_count < total_count THEN 0 ELSE 1 END, total_count - correct_count DESC, total_count DESC, first_seen, kp_id) AS place FROM stats")
def _(v):
    wrong = F.col("total_count") - F.col("correct_count")
    order = Window.partitionBy("session_id").orderBy(F.when(wrong > 0, 0).otherwise(1), wrong.desc(), F.col("total_count").desc(), "first_seen", "kp_id")
    return learning.point_stats(v.graded, v.unlocked).select("session_id", "kp_id", F.row_number().over(order).alias("place"))


@query("o7_question_choice", "SELECT primary_kp AS kp_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY primary_kp ORDER BY CASE WHEN difficulty BETWEEN 2 AND 3 THEN 0 ELSE 1 END, abs(difficulty - 2.5), question_id) AS n FROM question) WHERE n = 1")
def _(v):
    key = F.struct(~F.col("difficulty").between(2, 3), F.abs(F.col("difficulty") - 2.5), "question_id")
    return v.question.groupBy(F.col("primary_kp").alias("kp_id")).agg(F.min_by("question_id", key).alias("question_id"))


@query("o8_enum_order", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END AS rank, 1 + n_nationkey % 12 AS grade FROM nation", views=False)
def _(v):
    k = F.col("n_nationkey")
    stage = F.element_at(F.array(*map(F.lit, ("primary", "junior", "senior", "other"))), (k % 4 + 1).cast("int"))
    return v.table("nation").select("n_nationkey", text.stage_rank(stage).alias("rank"), text.grade_number(F.concat(F.lit("g"), (k % 12 + 1).cast("string"))).alias("grade"))


_LABELS_SQL = "CASE material_type WHEN 'common_mistake' THEN '易错提醒' WHEN 'method_card' THEN '解题方法' WHEN 'question_type_summary' THEN '题型总结' WHEN 'solution_summary' THEN '解析总结' WHEN 'concept_explanation' THEN '概念回顾' WHEN 'textbook_deep_dive' THEN '教材深挖' WHEN 'exam_trend' THEN '考情提示' ELSE '学习建议' END"


@query("o9_concat_key", f"SELECT material_id, row_number() OVER (PARTITION BY kp_id ORDER BY (({_LABELS_SQL}) || '|' || (material_id % 10)) COLLATE zh, material_id) AS place FROM material")
def _(v):
    """A point's materials in the order of a Chinese reader: labels by sound, then by number."""
    key = F.concat_ws("|", text.mapped(text.MATERIAL_LABELS, F.col("material_type")), (F.col("material_id") % 10).cast("string"))
    return v.material.select("material_id", F.row_number().over(Window.partitionBy("kp_id").orderBy(text.in_locale(key, "zh"), "material_id")).alias("place"))


@query("u1_union_all", "SELECT attempt_id AS id, 'attempt' AS kind FROM attempt UNION ALL SELECT redo_id, 'redo' FROM redo")
def _(v):
    return v.attempt.select(F.col("attempt_id").alias("id"), F.lit("attempt").alias("kind")).unionByName(v.redo.select(F.col("redo_id").alias("id"), F.lit("redo").alias("kind")))


@query("u2_distinct", "SELECT DISTINCT student_id, question_id FROM attempt")
def _(v):
    return v.attempt.select("student_id", "question_id").distinct()


@query("u3_intersect", "SELECT student_id, question_id FROM attempt WHERE is_correct INTERSECT SELECT student_id, question_id FROM mistake WHERE status = 'resolved'")
def _(v):
    right = v.attempt.where("is_correct").select("student_id", "question_id")
    return right.intersect(learning.mistakes(v.attempt).where("status = 'resolved'").select("student_id", "question_id"))


@query("u4_except", "SELECT student_id, kp_id FROM unlocked EXCEPT SELECT student_id, kp_id FROM mastery")
def _(v):
    return v.unlocked.join(v.graded.select("student_id", F.col("primary_kp").alias("kp_id")), ["student_id", "kp_id"], "left_anti").select("student_id", "kp_id")
