"""Threads of all lists and back, and slots by mode as columns."""

from pyspark.sql import functions as F

from tallyforge.functions import number
from tallyforge.plans import ingest


def test_threads_hold_everything_and_come_apart_again(spark):
    kinds = [*ingest.THREAD_KEYS, "question", "a type nobody knows"]
    rows = [(k % 3 if k % 7 else None, kinds[k % len(kinds)], k, f"ref{k % 4}", k / 1000) for k in range(700)]
    items = spark.createDataFrame(rows, "kp_id int, kind string, item_id int, source_ref string, score double")
    threads = ingest.assemble_threads(items, width=50)
    mapped = [r for r in rows if r[0] is not None]
    got = threads.collect()
    assert max(sum(len(t[c]) for c in (*ingest.THREAD_KEYS.values(), "questions")) for t in got) == 50
    assert {t["kp_id"]: 0 for t in got}.keys() == {0, 1, 2}
    for k in range(3):
        mine = [t for t in got if t["kp_id"] == k]
        assert sorted(t["part"] for t in mine) == list(range(len(mine)))
        assert max(t["match_confidence"] for t in mine) == max(r[4] for r in mapped if r[0] == k)
        assert set().union(*(t["source_refs"] for t in mine)) == {r[3] for r in mapped if r[0] == k}
    unmapped = items.where("kp_id IS NULL").select("item_id", F.when(F.col("kind") == "question", "question").otherwise("knowledge_point").alias("item_type"))
    flat = {(r["entity_kind"], r["kp_id"], r["material_type"], r["item_id"]) for r in ingest.flatten_threads(threads, unmapped).collect()}
    type_of = lambda k: k if k in ingest.THREAD_KEYS else "concept_explanation"
    want = {("question", r[0], None, r[2]) if r[1] == "question" else ("learning_material", r[0], type_of(r[1]), r[2]) for r in mapped}
    want |= {("knowledge_point", None, None, r[2]) for r in rows if r[0] is None and r[1] != "question"}
    assert flat == want


def test_slots_by_mode_equal_the_plain_function(spark):
    rows = [(n, m) for n in range(0, 60) for m in (*number.MODE_WEIGHTS, "unknown")]
    got = spark.createDataFrame(rows, "n int, m string").select("n", "m", number.mode_slots(F.col("n"), F.col("m")).alias("b")).collect()
    for r in got:
        want = number.mode_budgets(r["n"], r["m"]) if r["m"] in number.MODE_WEIGHTS else None
        assert (r["b"].asDict() if r["b"] else None) == want


def test_slots_by_mode_in_known_cases():
    cases = [(1, "daily_mixed", 1, 0, 0), (4, "daily_mixed", 2, 1, 1), (8, "daily_mixed", 4, 2, 2), (15, "daily_mixed", 7, 4, 4), (8, "chapter_focus", 6, 0, 2), (12, "chapter_focus", 9, 1, 2), (8, "mistake_focus", 0, 6, 2), (15, "mistake_focus", 1, 11, 3)]
    for n, mode, *want in cases:
        assert list(number.mode_budgets(n, mode).values()) == want
