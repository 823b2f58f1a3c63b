"""Ingestion runs of uploads as steps that are written one after another and taken up again where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import jsonx, number
from tallyforge.sources import model_calls
from tallyforge.sources.scheduling import Schedule

from . import ingest

NO_POINTS = "no knowledge points"


class Run:
    """Jobs (job_id, upload_id) over their pages (upload_id, page, prompt), step by step under a shared folder.

    running: all jobs begin. parsed: pages have been asked and their answers
    parsed, bad pages with the reason. staged: points by name, the first page
    of a name counts, as rows for review. done: jobs are 'succeeded' or, without
    a point, 'failed', and uploads 'parsed' or 'failed'. A step is a table; one
    that is whole isn't made again, so a run that was killed asks no page twice.
    """

    STEPS = ("running", "parsed", "staged", "done")

    def __init__(self, jobs: DataFrame, pages: DataFrame, cache: DataFrame, client: Callable[[str], dict], path: str, schedule: Schedule = Schedule()):
        self.spark: SparkSession = jobs.sparkSession
        self.jobs, self.pages, self.cache, self.client, self.path, self.schedule = jobs, pages, cache, client, path.rstrip("/"), schedule

    def is_done(self, step: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{step}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{step}")

    def run(self, until: str = "done") -> DataFrame:
        """The table of the step that is asked for, after all steps up to it."""
        for step in self.STEPS[: self.STEPS.index(until) + 1]:
            if not self.is_done(step):
                getattr(self, f"_{step}")().write.mode("overwrite").parquet(f"{self.path}/{step}")
        return self.table(until)

    def _running(self) -> DataFrame:
        count = self.pages.groupBy("upload_id").agg(F.count(F.lit(1)).alias("pages"))
        return self.jobs.select("job_id", "upload_id").join(count, "upload_id", "left").select("job_id", "upload_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.lit("running").alias("status"), F.lit("preparing").alias("phase"))

    def _parsed(self) -> DataFrame:
        mine = self.pages.join(self.table("running").select("upload_id", "job_id"), "upload_id")
        asked, _ = model_calls.page_map(mine, self.cache, self.client, self.schedule)
        parsed = asked.withColumn("_p", jsonx.tolerant(F.col("text")))
        names = F.transform(jsonx.elements(F.col("_p.value"), "knowledge_points", "knowledgePoints"), lambda m: jsonx.text_field(m, "name", "title", default=""))
        reason = F.when(~F.col("ok"), "call").when(F.col("_p.error").isNotNull() | F.col("_p.value").isNull(), "parse")
        return parsed.select("job_id", "upload_id", "page", reason.alias("reason"), F.when(reason.isNull(), F.filter(names, lambda n: n != "")).alias("names"), "tries", "cached")

    def _staged(self) -> DataFrame:
        rows = self.table("parsed").where("reason IS NULL").select("job_id", "upload_id", "page", F.posexplode("names").alias("pos", "name"))
        first = rows.groupBy("job_id", "upload_id", "name").agg(F.min(F.struct("page", "pos")).alias("at"))
        order = Window.partitionBy("job_id").orderBy("at", "name")
        return first.select("job_id", "upload_id", F.row_number().over(order).alias("position"), "name", F.col("at.page").alias("page"), F.lit("knowledge_point").alias("entity_kind"), F.lit("pending").alias("review_status"))

    def _done(self) -> DataFrame:
        last = self.progress()
        failed = F.col("points") == 0
        error = F.when(failed, F.when(F.col("pages") == 0, "no pages").when(F.col("pages_failed") == F.col("pages"), "all pages failed").otherwise(NO_POINTS))
        return last.select("job_id", "upload_id", F.when(failed, "failed").otherwise("succeeded").alias("status"), F.when(failed, "failed").otherwise("finished").alias("phase"), "pages", "pages_done", "pages_failed", "points", "percent", error.alias("error"), F.when(failed, "failed").otherwise("parsed").alias("upload_status"))

    def progress(self) -> DataFrame:
        """Each job with pages done and failed, points and percent, as far as its steps have come."""
        jobs = self.table("running")
        none = F.lit(0).cast("long")
        if not self.is_done("parsed"):
            return jobs.select("job_id", "upload_id", "pages", none.alias("pages_done"), none.alias("pages_failed"), none.alias("points"), number.page_progress(none, F.col("pages")).alias("percent"))
        seen = self.table("parsed").groupBy("job_id").agg(F.count_if(F.col("reason").isNull()).alias("pages_done"), F.count_if(F.col("reason").isNotNull()).alias("pages_failed"))
        out = jobs.join(seen, "job_id", "left")
        if self.is_done("staged"):
            out = out.join(self.table("staged").groupBy("job_id").agg(F.count(F.lit(1)).alias("points")), "job_id", "left")
        else:
            out = out.withColumn("points", F.lit(None).cast("long"))
        whole = lambda c: F.coalesce(c, none).alias(c)
        percent: Column = number.page_progress(F.coalesce("pages_done", none) + F.coalesce("pages_failed", none), F.col("pages"))
        return out.select("job_id", "upload_id", "pages", whole("pages_done"), whole("pages_failed"), whole("points"), percent.alias("percent"))


def analysis_results(run: Run, files: DataFrame) -> DataFrame:
    """One result a job of a run, with files (upload_id, name): status, source, coverage and diagnostics.

    failed without a point, partial with a bad page, else ok. Coverage counts
    the names that pages gave and the points that are left of them. Diagnostics
    count bad pages by reason and name the first of each.
    """
    found = run.table("parsed")
    bad = lambda reason: F.count_if(F.col("reason") == reason)
    first = lambda reason: F.min(F.when(F.col("reason") == reason, F.col("page")))
    seen = found.groupBy("job_id").agg(F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("candidates"), bad("call").alias("call_failures"), bad("parse").alias("parse_failures"), first("call").alias("first_call_failure"), first("parse").alias("first_parse_failure"))
    done = run.table("done").join(files.select("upload_id", "name"), "upload_id", "left").join(seen, "job_id", "left")
    suffix = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), "\\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix.isin("doc", "docx"), "word").when(suffix.isin("png", "jpg", "jpeg", "webp"), "image").otherwise("other")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.select(
        "job_id", F.when(F.col("points") == 0, "failed").when(F.col("pages_failed") > 0, "partial").otherwise("ok").alias("status"),
        kind.alias("source_type"), F.col("name").alias("source_name"), F.col("pages").alias("page_count"), none("candidates"), F.col("points").alias("output_points"),
        none("call_failures"), none("parse_failures"), "first_call_failure", "first_parse_failure", F.col("error").alias("parse_error"),
    )


def text_pages(uploads: DataFrame, content: Column) -> DataFrame:
    """(upload_id, page, prompt): the lines of a text that hold something, by their number."""
    lines = uploads.select("upload_id", F.posexplode(F.split(content, "\n")).alias("pos", "prompt"))
    return lines.where("prompt <> ''").select("upload_id", (F.col("pos") + 1).alias("page"), "prompt")


def stub_points(prompt: str) -> dict:
    """A client without a network: two points named by a digest; some pages fail, some answers are no JSON."""
    import hashlib
    import json

    d = hashlib.sha256(prompt.encode()).hexdigest()
    if int(d[:2], 16) % 10 == 0:
        return {"ok": False, "http_status": 503, "text": ""}
    text = "nothing found" if d[2] == "0" else "Points: " + json.dumps({"knowledge_points": [{"name": d[:6]}, {"title": d[6:12]}]}) + " end"
    return {"ok": True, "http_status": 200, "text": text}


#: The same in SQL: pages with their fate, and points by their first page.
RUN_SQL = """lines AS (SELECT doc_id AS upload_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
paged AS (SELECT *, sha256(line) AS d FROM lines WHERE line <> ''),
fate AS (SELECT *, CASE WHEN ((instr('0123456789abcdef', substr(d, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d, 2, 1)) - 1) % 10 = 0 THEN 'call' WHEN substr(d, 3, 1) = '0' THEN 'parse' END AS reason FROM paged),
named AS (SELECT upload_id, name, min(page * 2 + pos) AS spot FROM (SELECT upload_id, page, substr(d, 1, 6) AS name, 0 AS pos FROM fate WHERE reason IS NULL UNION ALL SELECT upload_id, page, substr(d, 7, 6), 1 FROM fate WHERE reason IS NULL) GROUP BY ALL)"""
