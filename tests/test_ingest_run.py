"""Ingestion runs: states, failures, and a run that is killed between its steps."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import ingest_run
from tallyforge.sources import scheduling


@pytest.fixture
def made(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    log = str(calls)

    def client(prompt):
        import time

        with open(f"{log}/{time.time_ns()}-{abs(hash(prompt))}", "w") as f:
            f.write(prompt)
        if prompt.startswith("down"):
            return {"ok": False, "http_status": 400, "text": ""}
        return {"ok": True, "http_status": 200, "text": "no JSON" if prompt.startswith("bad") else json.dumps({"knowledge_points": [{"name": n} for n in prompt.split()]})}

    uploads = spark.createDataFrame([(1, "a b\nb c\n\nbad\ndown 1"), (2, "down 2\ndown 3"), (3, None), (4, "bad 2"), (5, "  x")], "upload_id int, text string")
    jobs = uploads.select((F.col("upload_id") * 10).alias("job_id"), "upload_id")
    none = spark.createDataFrame([], "key string, text string")
    make = lambda: ingest_run.Run(jobs, ingest_run.text_pages(uploads, F.col("text")), none, client, f"file://{tmp_path}/run", scheduling.Schedule(sleep=scheduling.no_wait))
    return make, calls


def test_jobs_end_with_their_pages_and_points(made):
    run = made[0]()
    done = {r["job_id"]: r for r in run.run().collect()}
    show = lambda r: (r["status"], r["upload_status"], r["pages"], r["pages_done"], r["pages_failed"], r["points"], r["error"])
    assert {k: show(r) for k, r in done.items()} == {
        10: ("succeeded", "parsed", 4, 2, 2, 3, None),
        20: ("failed", "failed", 2, 0, 2, 0, "all pages failed"),
        30: ("failed", "failed", 0, 0, 0, 0, "no pages"),
        40: ("failed", "failed", 1, 0, 1, 0, "all pages failed"),
        50: ("succeeded", "parsed", 1, 1, 0, 1, None),
    }
    staged = [tuple(r) for r in run.table("staged").where("job_id = 10").orderBy("position").select("position", "name", "page", "review_status").collect()]
    assert staged == [(1, "a", 1, "pending"), (2, "b", 1, "pending"), (3, "c", 2, "pending")]


def test_a_killed_run_goes_on_where_it_stopped(made):
    make, calls = made
    first = make()
    first.run("running")
    assert {r["percent"] for r in first.progress().collect()} == {30}
    first._staged = lambda: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        first.run()
    asked = len(list(calls.iterdir()))
    second = make()
    assert {r["job_id"]: (r["pages_done"], r["points"], r["percent"]) for r in second.progress().collect()}[10] == (2, 0, 85)
    assert second.run().count() == 5 and second.run().count() == 5
    assert len(list(calls.iterdir())) == asked == 8


def test_results_say_what_went_wrong(spark, made):
    run = made[0]()
    run.run()
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.Docx"), (4, "c"), (5, None)], "upload_id int, name string")
    got = {r["job_id"]: r for r in ingest_run.analysis_results(run, files).collect()}
    assert {k: (r["status"], r["source_type"], r["page_count"]) for k, r in got.items()} == {10: ("partial", "pdf", 4), 20: ("failed", "word", 2), 30: ("failed", "other", 0), 40: ("failed", "other", 1), 50: ("ok", "other", 1)}
    r = got[10]
    assert (r["candidates"], r["output_points"], r["call_failures"], r["parse_failures"], r["first_call_failure"], r["first_parse_failure"]) == (4, 3, 1, 1, 5, 4)
