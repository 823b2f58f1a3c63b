"""Retries of model calls: waits by header, by words, by doubling; bounded calls; cached page maps."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import number
from tallyforge.plans import ingest
from tallyforge.sources import model_calls, scheduling

GOOD = {"ok": True, "http_status": 200, "text": "ok"}
NOON = 1_700_000_000.0


def run(answers, retries=2):
    """(last answer, waits) of a client that gives these answers one after another."""
    waits, left = [], list(answers)

    def client(prompt):
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    schedule = scheduling.Schedule(retries=retries, clock=lambda: NOON, sleep=waits.append)
    return scheduling.tried(client, "p", schedule), waits


@pytest.mark.parametrize(
    "answer,wait",
    [
        ({"http_status": 429, "headers": {"retry-after": "2"}, "raw": {"detail": "rate limited"}}, 2000),
        ({"http_status": 429, "headers": {"Retry-After": "1.0004"}}, 1001),
        ({"http_status": 429, "headers": {}, "raw": {"detail": "Rate limit exceeded. retry after 33.70 seconds."}}, 34000),
        ({"http_status": 429, "raw": {"error": {"message": "Retry after 3"}}}, 3000),
        ({"http_status": 500, "headers": {}, "raw": {"detail": "temporary failure"}}, 10000),
        ({"http_status": None, "text": ""}, 10000),
        ({"http_status": 503, "headers": {"retry-after": "Tue, 14 Nov 2023 22:13:50 GMT"}}, 30000),
        ({"http_status": 503, "headers": {"retry-after": "soon"}, "text": "retry after ..."}, 10000),
    ],
)
def test_one_wait(answer, wait):
    found, waits = run([{"ok": False, "text": "", **answer}, GOOD])
    assert waits == [wait] and found["ok"] and found["tries"] == 2 and found["waited_ms"] == wait


def test_a_date_that_has_passed_needs_no_wait():
    found, waits = run([{"ok": False, "http_status": 503, "headers": {"retry-after": "Tue, 14 Nov 2023 22:00:00 GMT"}}, GOOD])
    assert waits == [] and found["tries"] == 2 and found["waited_ms"] == 0


def test_waits_double_up_to_a_minute_and_calls_end():
    found, waits = run([{"ok": False, "http_status": 500, "text": "down"}] * 6, retries=5)
    assert waits == [10_000, 20_000, 40_000, 60_000, 60_000] and not found["ok"] and found["tries"] == 6


def test_other_failures_are_final_and_exceptions_are_answers():
    found, waits = run([{"ok": False, "http_status": 400, "text": "bad request"}])
    assert waits == [] and found["tries"] == 1
    found, waits = run([RuntimeError("no route"), GOOD])
    assert waits == [10_000] and found["ok"]
    found, _ = run([RuntimeError("retry after 4 s")] * 3)
    assert found["error_message"] == "retry after 4 s" and found["waited_ms"] == 8000


def test_calls_at_once_are_bounded_and_order_stays():
    lock, now, most = threading.Lock(), [0], [0]

    def client(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(random.Random(prompt).random() / 50)
        with lock:
            now[0] -= 1
        return {**GOOD, "text": prompt}

    prompts = [str(k) for k in range(60)]
    got = list(scheduling.all_tried(client, prompts, scheduling.Schedule(at_once=3)))
    assert [x["text"] for x in got] == prompts and most[0] == 3


def test_the_column_waits_as_the_scheduler_does(spark):
    said = ["2", "1.0004", "Tue, 14 Nov 2023 22:13:50 GMT", "Tue, 14 Nov 2023 22:00:00 GMT", "soon", "-3", "", None, "nan"]
    texts = ["", "retry after 33.70 seconds", "Please Retry After 2s", "retry after ...", None]
    rows = [(h, t, a) for h in said for t in texts for a in range(4)]
    df = spark.createDataFrame(rows, "h string, t string, a int")
    got = [r["ms"] for r in df.select(number.retry_delay_ms(F.col("h"), F.col("t"), F.col("a"), F.timestamp_seconds(F.lit(int(NOON)))).alias("ms")).collect()]
    schedule = scheduling.Schedule(clock=lambda: NOON)
    assert got == [scheduling.wait_before({"headers": {"retry-after": h}, "text": t}, a, schedule)[0] for h, t, a in rows]


def test_pages_are_asked_once_and_good_answers_go_to_the_cache(spark, tmp_path):
    log = str(tmp_path)

    def client(prompt):
        with open(f"{log}/{abs(hash(prompt))}-{time.time_ns()}", "w") as f:
            f.write(prompt)
        return {"ok": prompt != "bad", "http_status": 200 if prompt != "bad" else 500, "text": f"<{prompt}>"}

    pages = spark.createDataFrame([(1, k, p) for k, p in enumerate(["a", "b", "a", "bad", "c", "known"])], "doc int, page int, prompt string").repartition(3)
    cache = spark.createDataFrame([("known",)], "p string").select(F.sha2("p", 256).alias("key"), F.lit("from the cache").alias("text"))
    found, fresh = model_calls.page_map(pages, cache, client, scheduling.Schedule(retries=1, sleep=scheduling.no_wait))
    parts = ingest.ordered_parts(found, "doc", "page", F.col("text"), "|", 4).orderBy("part").collect()
    assert [(r["part"], r["text"], r["pages"]) for r in parts] == [(0, "<a>|<b>|<a>", 4), (1, "<c>|from the cache", 2)]
    assert {r["page"]: (r["ok"], r["cached"], r["tries"]) for r in found.collect()} == {0: (True, False, 1), 1: (True, False, 1), 2: (True, False, 1), 3: (False, False, 2), 4: (True, False, 1), 5: (True, True, 0)}
    assert fresh.count() == 3
    made = sorted((tmp_path / n.name).read_text() for n in tmp_path.iterdir())
    assert made == ["a", "b", "bad", "bad", "c"]


def test_a_very_long_document_is_in_parts(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("doc"), F.col("id").alias("page"), F.concat(F.lit("p"), F.col("id")).alias("t"))
    parts = ingest.ordered_parts(rows, "doc", "page", F.col("t"), " ")
    assert parts.agg(F.max("pages")).first()[0] == 64 and parts.count() == -(-300_000 // 64)
    assert parts.where("part = 1000").first()["text"].split()[:2] == ["p64000", "p64001"]


def test_prompts_are_worked_on_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(model_calls, "PROMPT_BYTES", 10)
    texts = ["aaaa", "bbbb", "cccc", None, "d" * 30, "", "e"]
    parts = list(model_calls._slices(pa.RecordBatch.from_pydict({"k": range(7), "p": texts}), 1))
    assert [p.column(1).to_pylist() for p in parts] == [["aaaa", "bbbb"], ["cccc", None], ["d" * 30], ["", "e"]]
    rows = spark.createDataFrame(list(enumerate(texts[:3])), "k long, p string").coalesce(1)
    out = model_calls.call(rows, "p", lambda p: {"ok": True, "http_status": 200, "text": p.upper()}).collect()
    assert [(x["k"], x["p"], x["text"], x["prompt_tokens"]) for x in out] == [(0, "aaaa", "AAAA", None), (1, "bbbb", "BBBB", None), (2, "cccc", "CCCC", None)]
