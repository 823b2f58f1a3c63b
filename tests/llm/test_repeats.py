"""Repeated windows on adverse texts, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import factors, repeats
from tests.llm.test_operators import by_id, expected_bytes, expected_words

KIND = "doc_id long, text string"


def check(spark, rows, parts=3, hot=repeats.HOT):
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    got = by_id(repeats.removals(df, repeats.WORDS, False, hot))
    assert {d: v[0] for d, v in got.items()} == expected_words(rows)
    got = by_id(repeats.removals(df, repeats.BYTES, True, hot))
    assert {d: v[0] for d, v in got.items()} == expected_bytes(rows)


def thue_morse(n, swap):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_words_that_share_a_name_are_told_apart(spark):
    # polynomials modulo 2 ** 64 can't tell these two words apart
    words = " ".join(f"w{i}" for i in range(34))
    x, y = thue_morse(2048, 0), thue_morse(2048, 1)
    rows = [(1, f"{words} {x}"), (2, f"{words} {y}"), (3, f"{words} other"), (4, f"{words} other")]
    got = by_id(repeats.removals(spark.createDataFrame(rows, KIND), repeats.WORDS, False), "doc_id", "n_removed")
    assert {d: v[0][1] for d, v in got.items()} == {1: 0, 2: 0, 3: 35, 4: 35}
    check(spark, rows)


def test_documents_that_share_an_id(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = " ".join(word() for _ in range(55))
    one, two = f"{common} {word()} {word()}", f"{word()} {common}"
    df = spark.createDataFrame([(7, one), (7, two), (8, "x"), (8, "x")], KIND)
    got = [(x["doc_id"], x["n_removed"]) for x in repeats.removals(df, repeats.WORDS, False).collect()]
    assert sorted(got) == [(7, 55), (7, 55), (8, 0), (8, 0)]
    same = spark.createDataFrame([(7, one), (7, one)], KIND).repartition(2)
    assert [x["n_removed"] for x in repeats.removals(same, repeats.WORDS, False).collect()] == [0, 0]
    assert [x["n_removed"] for x in repeats.removals(same, repeats.BYTES, True).collect()] == [0, 0]
    # of different texts under one id one is the earlier
    removed = sorted(x["n_removed"] for x in repeats.removals(df, repeats.BYTES, True).collect())
    assert removed == [0, 0, 0, len(common) + 1] or removed == [0, 0, 0, len(common)]
    nulls = spark.createDataFrame([(None, one), (None, two), (None, one), (9, common)], KIND).repartition(2)
    got = sorted(((x["doc_id"] or 0), x["n_removed"]) for x in repeats.removals(nulls, repeats.WORDS, False).collect())
    assert got == [(0, 55), (0, 55), (0, 55), (9, 55)]


def test_very_long_periodic_and_hot_texts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    long = " ".join(word() for _ in range(260_000))
    assert len(long) > 1 << 20
    passage = " ".join(word() for _ in range(60))
    rows = [(0, long), (1, long[500_000:520_000] + " " + passage), (2, "ab " * 400), (3, "z" * 3000), (4, "a b " * 300)]
    rows += [(10 + k, f"{word()} {passage} {word()} {word()}") for k in range(500)]
    check(spark, rows, hot=64)
    check(spark, rows)


def test_windows_of_a_hundred_words(spark):
    r = random.Random(9)
    words = [f"w{r.randint(0, 4000)}" for _ in range(150)]
    bodies = pa.array([" ".join(words), "x " + " ".join(words[:120]), "y " + " ".join(words[60:130])], pa.binary())
    found = factors.repeated_windows(bodies, 100, np.zeros(3), np.zeros(3))
    assert np.flatnonzero(found).tolist() == [*range(21), *range(52, 73)]


def test_many_texts_under_one_id_meet_their_own_anchors_only(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    common = [" ".join(word() for _ in range(40)) for _ in range(50)]
    rows = [(7, f"{word()} {common[k % 50]} {word()}") for k in range(3000)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = [x["n_removed"] for x in repeats.removals(df, repeats.WORDS, False).collect()]
    assert got == [40] * 3000
    asked = repeats.keyed(df)
    held = repeats.with_removals(asked, repeats.WORDS, False).selectExpr("max(size(marks)) AS most").first()["most"]
    assert held <= 3


def test_empty_table_and_short_texts(spark):
    none = spark.createDataFrame([], KIND)
    assert repeats.removals(none, repeats.WORDS, False).count() == repeats.removals(none, repeats.BYTES, True).count() == 0
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one two")], 1)


@pytest.mark.parametrize("letters", [1, 2, 6])
def test_factors_are_greedy_and_find_all_windows(letters):
    r = random.Random(letters)
    for _ in range(60):
        bodies = [[r.choice("abcdef"[:letters]) for _ in range(r.randint(1, 40))] for _ in range(r.randint(1, 6))]
        flat = pa.array([" ".join(b) for b in bodies], pa.binary())
        length = r.randint(1, 12)
        words = np.array([ord(w) for b in bodies for w in b])
        block = factors.Reference(words, np.array([len(b) for b in bodies]), 6)
        text = [(w, None) if w else (None, k) for k, b in enumerate(bodies) for w in [*b, None]]
        longest = [max([next((m for m in range(64) if max(i, j) + m >= len(text) or text[i + m] != text[j + m]), 63) for j in range(len(text)) if j != i], default=0) for i in range(len(text))]
        assert block.match(np.arange(len(text))).tolist() == longest
        want = {}
        for b in bodies:
            for i in range(len(b) - length + 1):
                want[tuple(b[i : i + length])] = want.get(tuple(b[i : i + length]), 0) + 1
        got = factors.repeated_windows(flat, length, np.zeros(len(bodies)), np.zeros(len(bodies)))
        assert got.tolist() == [want[tuple(b[i : i + length])] > 1 for b in bodies for i in range(len(b) - length + 1)]
