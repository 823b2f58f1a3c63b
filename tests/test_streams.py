"""Keyed state over many frames, review timers, and the sink under a killed batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import q_domain
from tallyforge.streaming import attempts, sink

START = datetime.datetime(2024, 1, 1)


class Over:
    """What q_domain._stream needs of a Views object."""

    def __init__(self, spark):
        self.spark = spark


@pytest.fixture
def small_frames(spark):
    """Frames of 200 rows, so that one key's batch comes in many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    yield
    spark.conf.set(key, before)


def test_a_hot_learner_in_one_batch(spark, small_frames):
    r = random.Random(1)
    rows = [(1 if r.random() < 0.9 else 2, k, START + datetime.timedelta(seconds=r.randint(0, 400_000)), r.randint(0, 3), r.randint(0, 40), r.randint(1, 5), r.random() < 0.7) for k in range(20_000)]
    df = spark.createDataFrame(rows, "student_id long, attempt_id long, answered_at timestamp, primary_kp int, question_id long, difficulty int, is_correct boolean").repartition(4)
    got = q_domain._stream(Over(spark), [df], attempts.learner_states).collect()
    scores, book = {}, {}
    for s, _, _, kp, q, d, right in sorted(rows, key=lambda x: (x[2], x[1])):
        now, peak = scores.get((s, kp), (0, 0))
        now = max(0, min(100, now + attempts.change(d, right)))
        scores[s, kp] = (now, max(peak, now))
        errors, streak = book.get((s, q), (0, 0))
        book[s, q] = (errors + 1, 0) if not right else (errors, min(2, streak + 1) if errors else 0)
    assert {(x["student_id"], x["question_id"]): (x["errors"], x["streak"]) for x in got} == book
    assert all((x["score"], x["peak"]) == scores[x["student_id"], x["kp_id"]] for x in got)


def test_serial_writes_of_a_hot_key(spark, small_frames):
    r = random.Random(2)
    rows = [(7, k, START + datetime.timedelta(seconds=r.randint(0, 90_000))) for k in range(5000)]
    df = spark.createDataFrame(rows, "key long, write_id long, ts timestamp").repartition(3)
    got = {x["write_id"]: x["number"] for x in q_domain._stream(Over(spark), [df], attempts.serial_writes, "append").collect()}
    assert got == {k: n for n, (_, k, _) in enumerate(sorted(rows, key=lambda x: (x[2], x[1])), 1)}


def test_reviews_fall_due_and_are_put_off(spark, small_frames):
    at = lambda h: START + datetime.timedelta(hours=h)
    kind = "student_id long, kp_id int, ts timestamp, is_correct boolean"
    batches = [
        [(1, 5, at(0), True), (2, 5, at(1), False), (3, 5, at(2), True)],
        [(2, 5, at(20), False), (9, 9, at(30), True)],  # learner 2 is wrong again before the review; the clock passes learner 1 and 3
        [(1, 5, at(31), False), (3, 5, at(3), False), (9, 9, at(60), True)],  # learner 1 is put off after it was due; learner 3's answer is too late
    ]
    out = q_domain._stream(Over(spark), [spark.createDataFrame(b, kind) for b in batches], lambda s: attempts.due_reviews(s, late="1 hour"))
    micros = lambda h: int((at(h) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    said = {}
    for x in out.where("student_id < 9").orderBy("batch", "due_us", F.col("status").desc()).collect():
        said.setdefault(x["student_id"], []).append((x["status"], x["due_us"]))
    assert said[1] == [("waiting", micros(24)), ("due", micros(24)), ("waiting", micros(55)), ("due", micros(55))]
    assert said[2] == [("waiting", micros(25)), ("waiting", micros(44)), ("due", micros(44))]
    assert said[3] == [("waiting", micros(26)), ("due", micros(26))]


@pytest.mark.parametrize("name", [lambda s: s * 29 - 3000, lambda s: 2**60 + s, lambda s: f"s{s}"])
def test_reviews_of_many_learners(spark, small_frames, name):
    r = random.Random(3)
    kind = "student_id string" if isinstance(name(0), str) else "student_id long"
    rows = [(name(r.randint(0, 150)), r.randint(0, 3), START + datetime.timedelta(seconds=r.randint(0, 90_000) + 90_000 * b), r.random() < 0.5) for b in range(3) for _ in range(1500)]
    ends = [START + datetime.timedelta(seconds=90_000 * b) for b in (1, 2, 3)]
    df = spark.createDataFrame(rows, f"{kind}, kp_id int, ts timestamp, is_correct boolean").repartition(4)
    # answers of a batch are as late as they like within the batch
    batches = [df.where((F.col("ts") < F.lit(e)) & (F.col("ts") >= F.lit(e - datetime.timedelta(seconds=90_000)))) for e in ends]
    got = q_domain._stream(Over(spark), batches, lambda s: attempts.due_reviews(s, late="1 hour")).collect()
    micros = lambda t: (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    clock, waiting, fallen, seen = None, set(), set(), {}
    for e in ends:
        mine = [x for x in rows if e - datetime.timedelta(seconds=90_000) <= x[2] < e]
        before = {k: max(t for t in v if t) for k, v in seen.items()}
        for s, kp, t, right in mine:
            first, wrong = seen.get((s, kp), (t, None))
            seen[s, kp] = (min(first, t), wrong if right else max(wrong or t, t))
        after = {k: max(t for t in v if t) for k, v in seen.items()}
        waiting |= {(*k, micros(t) + 86_400_000_000) for k, t in after.items() if before.get(k) != t}
        clock = micros(max(x[2] for x in mine)) // 1000 - 3_600_000
        fallen |= {(*k, micros(t) + 86_400_000_000) for k, t in after.items() if -(-(micros(t) + 86_400_000_000) // 1000) <= clock}
    told = [(x["status"], x["student_id"], x["kp_id"], x["due_us"]) for x in got]
    assert len(told) == len(set(told))
    assert {x[1:] for x in told if x[0] == "waiting"} == waiting
    assert {x[1:] for x in told if x[0] == "due"} == fallen and fallen


@pytest.mark.parametrize("apart, pages", [(1, None), (100_000, 2)])
def test_reviews_of_neighbours_share_state_and_timers(spark, tmp_path, apart, pages):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ids = spark.range(1024).select((F.col("id") % 128 * apart).alias("student_id"), F.col("id").alias("kp_id"), F.timestamp_seconds(F.col("id") + 1_704_067_200).alias("ts"), F.lit(True).alias("is_correct"))
        ids.write.parquet(f"{tmp_path}/in")
        due = attempts.due_reviews(spark.readStream.schema(ids.schema).parquet(f"{tmp_path}/in"), **({} if pages is None else {"pages": pages}))
        running = due.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("update").start()
        running.awaitTermination()
        metrics = [p["stateOperators"][0]["customMetrics"] for p in running.recentProgress if p["stateOperators"]]
        # 1,024 reviews of two pages of learners
        assert sum(m["numRegisteredTimers"] for m in metrics) == 2
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_a_job_fails_only_after_the_quiet_time(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    kind = "job_id long, ts timestamp, status string"
    # the clock ends ten minutes behind 2,000 s: jobs that spoke before 800 s are late, job 2 spoke just then
    batches = [[(1, at(799), "running"), (2, at(800), "queued"), (3, at(801), "running"), (4, at(1400), "parsed"), (9, at(1450), "parsed")], [(4, at(1350), "running"), (9, at(2000), "parsed")]]
    out = q_domain._stream(Over(spark), [spark.createDataFrame(b, kind) for b in batches], attempts.reap_jobs)
    said = {}
    for x in out.orderBy("batch").collect():
        said.setdefault(x["job_id"], []).append(x["status"])
    # an older event of job 4 that comes after its newest one says nothing
    assert said == {1: ["running", "failed"], 2: ["queued"], 3: ["running"], 4: ["parsed"], 9: ["parsed", "parsed"]}


def test_a_batch_that_is_killed_and_replayed_is_there_once(spark, tmp_path):
    place = str(tmp_path)
    spark.range(100).withColumn("part", F.lit(0)).write.parquet(f"{place}/in")

    class Dying(sink.BatchSink):
        dies = True

        def mark(self, batch):
            if self.dies:
                raise RuntimeError("killed between the rows and the mark")
            super().mark(batch)

    out = Dying(spark, f"{place}/out")

    def run(put):
        stream = spark.readStream.schema("id long, part int").parquet(f"{place}/in")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(out.write)
    assert out.batches() == [] and out.read("id long, part int").count() == 0
    out.dies = False
    run(out.write)
    assert sorted(x["id"] for x in out.read("id long, part int").collect()) == list(range(100))
    # the mark is there, the stream's own commit is not: the batch comes again and changes nothing
    out.write(spark.range(5).withColumn("part", F.lit(1)), 0)
    assert out.read("id long, part int").count() == 100 and out.batches() == [0]


def test_a_learner_costs_a_few_calls_to_the_state():
    import pandas as pd

    said, calls = {}, []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def run(*key):
                calls.append((self.name, call))
                if call in ("update", "updateValue"):
                    said[(self.name, *key[:-1])] = key[-1]
                    return None
                return (self.name, *key) in said if call in ("exists", "containsKey") else said.get((self.name, *key))

            return run

    class Handle:
        def getMapState(self, name, *_):
            return State(name)

        getValueState = getMapState

    work = attempts.LearnerState()
    work.init(Handle())
    frame = pd.DataFrame({"answered_at": pd.date_range("2024-01-01", periods=120, freq="min"), "attempt_id": range(120), "primary_kp": [k % 12 for k in range(120)], "question_id": [k % 40 for k in range(120)], "difficulty": 3, "is_correct": [k < 80 for k in range(120)]})
    for _ in range(2):
        out = pd.concat(work.handleInputRows((1,), iter([frame]), None))
    assert len(calls) <= 12, len(calls)
    assert out["errors"].eq(2).all()
