"""The mergeable mastery fold against the plain fold."""

import random

from pyspark.sql import functions as F

from tallyforge.plans import learning

CHANGES = (5, -15, 10, -8, 15, -3)


def plain(changes, score=0):
    peak = 0
    for c in changes:
        score = max(0, min(100, score + c))
        peak = max(peak, score)
    return score, peak


def test_folds_equal_the_plain_fold_however_they_are_cut(spark):
    r = random.Random(4)
    rows, want = [], {}
    for k in range(300):
        ups = r.random()
        changes = [r.choice(CHANGES[::2] if r.random() < ups else CHANGES[1::2]) for _ in range(r.randint(1, 60))]
        want[k] = (changes, len(changes))
        rows += [(k, i, i // r.randint(1, 20), c) for i, c in enumerate(changes)]
    # a slot is a range of the order, so it must not fall
    rows = [(k, i, sum(1 for _ in range(i)) // 7, c) for k, i, _, c in rows]
    df = spark.createDataFrame(rows, "k int, i int, s int, c int").repartition(5)
    for width in (1, 3, 1024):
        got = learning.folded(df, ["k"], ["i"], F.col("s"), F.col("c"), width).select("k", "n", "last", "fold.*").collect()
        for x in got:
            changes, n = want[x["k"]]
            assert x["n"] == n and x["last"] == n - 1
            for start in (0, 1, 40, 77, 100):
                score, peak = plain(changes, start)
                assert min(x["high"], max(x["low"], start + x["shift"])) == score
                assert max(x["top"], min(100, start + x["rise"])) == peak


def test_a_hot_learner_and_point(spark):
    r = random.Random(9)
    changes = [r.choice(CHANGES) for _ in range(30_000)]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(changes)], "k int, i int, c int").repartition(4)
    # all in one slot, and over many
    for slot in (F.lit(0), F.floor(F.col("i") / 500)):
        x = learning.folded(df, ["k"], ["i"], slot, F.col("c")).select("fold.*").first()
        assert (min(x["high"], max(x["low"], x["shift"])), x["top"]) == plain(changes)
