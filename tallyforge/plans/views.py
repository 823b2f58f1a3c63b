"""Learning tables read off the test tables, in Spark and in DuckDB SQL.

Both sides derive the same rows by plain arithmetic; the engine's operators take
DataFrames of these shapes from any source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
TYPES = ("common_mistake", "method_card", "question_type_summary", "solution_summary", "concept_explanation", "textbook_deep_dive", "exam_trend", "study_advice")


class Views:
    """The domain tables as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def subject(self) -> DataFrame:
        return self.table("region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("subject_id"), F.col("r_name").alias("name"))

    @cached_property
    def kp(self) -> DataFrame:
        k = F.col("n_nationkey")
        chapter = F.when(k % 7 != 0, F.concat((k % 5 + 1).cast("string"), F.lit("."), (k + 1).cast("string")))
        return self.table("nation").select(k.alias("kp_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).alias("subject_id"), chapter.alias("chapter_no"))

    @cached_property
    def question(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.table("part").select(
            p.alias("question_id"), (p % 12).cast("int").alias("primary_kp"), F.array_distinct(F.array((p % 12).cast("int"), ((p * 7 + 5) % 25).cast("int"))).alias("kp_ids"),
            (F.col("p_size") % 5 + 1).alias("difficulty"), F.when(p % 2 == 0, "choice").otherwise("fill_in").alias("question_type"),
            (F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval((p % 50).cast("int"))).alias("created_at"), F.col("p_name").alias("stem"),
        )

    @cached_property
    def attempt(self) -> DataFrame:
        e = self.events.where(F.col("event_type").isin("click", "purchase", "error"))
        return e.select(
            F.col("event_id").alias("attempt_id"), F.col("user_id").alias("student_id"), ((F.col("event_id") * 7919) % 25).alias("question_id"), (F.col("event_type") != "error").alias("is_correct"),
            F.col("ts").alias("answered_at"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
        )

    @cached_property
    def graded(self) -> DataFrame:
        """Attempts with their question's point, points and difficulty."""
        q = self.question.select("question_id", "primary_kp", "kp_ids", "difficulty", "question_type")
        return self.attempt.join(q, "question_id")

    @cached_property
    def student(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("student_id"), (F.col("user_id") % 2).cast("int").alias("subject_id")).distinct()

    @cached_property
    def unlocked(self) -> DataFrame:
        return self.student.select("student_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("kp_id")).where("(kp_id + student_id) % 3 <> 0")

    @cached_property
    def session(self) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("attempt_id", "question_id"))), lambda x: x["question_id"])
        return self.attempt.groupBy("session_id", "student_id").agg(F.min("answered_at").alias("started_at"), F.max("answered_at").alias("ended_at"), ordered.alias("question_ids"))

    @cached_property
    def redo(self) -> DataFrame:
        return self.events.where("event_type = 'signup'").select(F.col("event_id").alias("redo_id"), F.col("user_id").alias("student_id"), ((F.col("event_id") * 7919) % 25).alias("question_id"), (F.col("event_id") % 3 != 0).alias("is_correct"), F.col("ts").alias("answered_at"))

    @cached_property
    def material(self) -> DataFrame:
        d = F.col("doc_id")
        kind = F.element_at(F.array(*map(F.lit, TYPES)), (d % 8 + 1).cast("int"))
        return self.table("documents").select(d.alias("material_id"), (d % 25).cast("int").alias("kp_id"), kind.alias("material_type"), F.col("text").alias("title"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (d % 1000).cast("int"))).alias("created_at"))

    @cached_property
    def upload(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(d.alias("upload_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat(F.col("source"), F.lit(".pdf")).alias("original_name"), F.when(d % 4 != 0, (d % 2).cast("int")).alias("subject_id"), F.element_at(F.array(*map(F.lit, ("queued", "running", "parsed", "failed"))), (d % 4 + 1).cast("int")).alias("status"))

    @cached_property
    def staging(self) -> DataFrame:
        """Parsed items of uploads: a JSON payload, its kind and review state."""
        d = F.col("doc_id")
        # the text as a JSON string, without the object around it
        name = F.when(F.col("text").isNotNull(), F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)"))
        payload = F.concat(F.lit('{"name":'), name, F.lit(',"_subject_id":"'), (d % 2).cast("string"), F.lit('","page":'), (d % 9).cast("string"), F.lit(',"difficulty":'), F.when(d % 5 == 0, "null").otherwise((d % 6).cast("string")), F.lit("}"))
        kind = F.element_at(F.array(*map(F.lit, ("source_document", "learning_material", "question", "knowledge_point"))), (d % 4 + 1).cast("int"))
        state = F.element_at(F.array(*map(F.lit, ("pending", "accepted", "rejected"))), (d % 3 + 1).cast("int"))
        return self.table("documents").select(d.alias("staging_id"), (d % 48).alias("upload_id"), kind.alias("entity_kind"), state.alias("review_status"), payload.alias("payload"), F.when(d % 3 == 1, d % 25).alias("published_id"))


#: The same tables as DuckDB CTEs; queries put them in front of their own SQL.
VIEWS_SQL = f"""WITH subject AS (SELECT r_regionkey AS subject_id, r_name AS name FROM region WHERE r_regionkey < 2),
kp AS (SELECT n_nationkey AS kp_id, n_name AS name, n_regionkey % 2 AS subject_id, CASE WHEN n_nationkey % 7 <> 0 THEN (n_nationkey % 5 + 1) || '.' || (n_nationkey + 1) END AS chapter_no FROM nation),
question AS (SELECT p_partkey AS question_id, p_partkey % 12 AS primary_kp, CASE WHEN p_partkey % 12 = (p_partkey * 7 + 5) % 25 THEN [p_partkey % 12] ELSE [p_partkey % 12, (p_partkey * 7 + 5) % 25] END AS kp_ids,
 p_size % 5 + 1 AS difficulty, CASE WHEN p_partkey % 2 = 0 THEN 'choice' ELSE 'fill_in' END AS question_type, TIMESTAMP '2023-01-01' + to_days(CAST(p_partkey % 50 AS INTEGER)) AS created_at, p_name AS stem FROM part),
attempt AS (SELECT event_id AS attempt_id, user_id AS student_id, (event_id * 7919) % 25 AS question_id, event_type <> 'error' AS is_correct, ts AS answered_at, user_id * 100 + day(ts) AS session_id FROM events WHERE event_type IN ('click', 'purchase', 'error')),
graded AS (SELECT a.*, q.primary_kp, q.kp_ids, q.difficulty, q.question_type FROM attempt a JOIN question q USING (question_id)),
student AS (SELECT DISTINCT user_id AS student_id, user_id % 2 AS subject_id FROM events),
unlocked AS (SELECT student_id, kp_id FROM student, (SELECT unnest(range(25)) AS kp_id) WHERE (kp_id + student_id) % 3 <> 0),
session AS (SELECT session_id, student_id, min(answered_at) AS started_at, max(answered_at) AS ended_at, list(question_id ORDER BY attempt_id) AS question_ids FROM attempt GROUP BY ALL),
redo AS (SELECT event_id AS redo_id, user_id AS student_id, (event_id * 7919) % 25 AS question_id, event_id % 3 <> 0 AS is_correct, ts AS answered_at FROM events WHERE event_type = 'signup'),
material AS (SELECT doc_id AS material_id, doc_id % 25 AS kp_id, {list(TYPES)}[CAST(doc_id % 8 + 1 AS INTEGER)] AS material_type, text AS title, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1000 AS INTEGER)) AS created_at FROM documents),
upload AS (SELECT doc_id AS upload_id, sha256(text) AS sha256, source || '.pdf' AS original_name, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 2 END AS subject_id, ['queued', 'running', 'parsed', 'failed'][CAST(doc_id % 4 + 1 AS INTEGER)] AS status FROM documents),
staging AS (SELECT doc_id AS staging_id, doc_id % 48 AS upload_id, ['source_document', 'learning_material', 'question', 'knowledge_point'][CAST(doc_id % 4 + 1 AS INTEGER)] AS entity_kind, ['pending', 'accepted', 'rejected'][CAST(doc_id % 3 + 1 AS INTEGER)] AS review_status,
 '{{"name":' || CAST(to_json(text) AS VARCHAR) || ',"_subject_id":"' || (doc_id % 2) || '","page":' || (doc_id % 9) || ',"difficulty":' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE CAST(doc_id % 6 AS VARCHAR) END || '}}' AS payload, CASE WHEN doc_id % 3 = 1 THEN doc_id % 25 END AS published_id FROM documents),
step AS (SELECT *, CASE WHEN difficulty <= 2 THEN CASE WHEN is_correct THEN 5 ELSE -15 END WHEN difficulty = 3 THEN CASE WHEN is_correct THEN 10 ELSE -8 END ELSE CASE WHEN is_correct THEN 15 ELSE -3 END END AS delta FROM graded),
mastery AS (SELECT student_id, kp_id, s.c / 100.0 AS mastery_score, s.p / 100.0 AS peak_mastery_score, n AS attempts, last_at FROM (SELECT student_id, primary_kp AS kp_id, count(*) AS n, max(answered_at) AS last_at,
 list_reduce(list({{'c': CAST(delta AS INTEGER), 'p': 0}} ORDER BY answered_at, attempt_id), lambda a, x: {{'c': greatest(0, least(100, a.c + x.c)), 'p': greatest(a.p, greatest(0, least(100, a.c + x.c)))}}, {{'c': 0, 'p': 0}}) AS s FROM step GROUP BY ALL)),
wrong AS (SELECT student_id, question_id, max(CASE WHEN NOT is_correct THEN attempt_id END) AS last_wrong, count(*) FILTER (WHERE NOT is_correct) AS error_count, min(CASE WHEN NOT is_correct THEN answered_at END) AS created_at, max(answered_at) AS last_at FROM attempt GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_correct) > 0),
mistake AS (SELECT w.student_id, w.question_id, w.error_count, least(2, count(a.attempt_id)) AS streak, CASE WHEN count(a.attempt_id) >= 2 THEN 'resolved' ELSE 'open' END AS status, list_sort(list(a.answered_at) FILTER (WHERE a.attempt_id IS NOT NULL))[2] AS resolved_at, any_value(w.created_at) AS created_at, any_value(w.last_at) AS last_at
 FROM wrong w LEFT JOIN attempt a ON a.student_id = w.student_id AND a.question_id = w.question_id AND a.is_correct AND a.attempt_id > w.last_wrong GROUP BY w.student_id, w.question_id, w.error_count),
review AS (SELECT student_id, primary_kp AS kp_id, greatest(min(answered_at), max(CASE WHEN NOT is_correct THEN answered_at END)) + INTERVAL 24 HOUR AS next_review_at FROM graded GROUP BY ALL),
now_at AS (SELECT TIMESTAMP '{NOW}' AS now)
"""
