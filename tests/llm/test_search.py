"""Byte-level pairs, hard negatives and lexical search against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tallyforge.llm import byte_pairs, lexical, negatives, orc_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"


def encoded(texts):
    out = []
    for _, ids, ends in byte_pairs.encode_rows(pa.array(texts, pa.string()), BYTES):
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


def same_as_library(texts):
    library = orc_tokens.load_tokenizer(BYTES)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(texts) == want
    return want


def test_byte_pairs_equal_the_library_on_every_code_point():
    points = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    same_as_library(["".join(map(chr, points[a : a + 64])) for a in range(0, len(points), 64)])
    same_as_library(["".join(chr(c) + " " for c in points[a : a + 64]) + " x" for a in range(0, len(points), 64)])


def test_byte_pairs_equal_the_library_on_mixtures_of_spaces_marks_and_words():
    r = random.Random(3)
    letters = [*" \t\n\r\x0b\x0c\x1c\x1f\x7f\x85  ᠎  　​’—,.:;!?019abcdeABCsStdmlveräßéЖщ文あ①½²\U0001f600", MARK, MARK[:-1], "'re", "'ll", " the", "tion", "  ", "   "]
    texts = ["", MARK, f"a {MARK} b", f"  {MARK}  ", *("".join(r.choice(letters) for _ in range(r.randint(1, 25))) for _ in range(8000))]
    library = orc_tokens.load_tokenizer(BYTES)
    model = byte_pairs.byte_pairs(BYTES)
    for ids in same_as_library(texts):
        assert model.decode(np.array(ids, np.int64)).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" * 300_000, "\n" * 200_000, "ab" * 100_000])
def test_byte_pairs_of_one_very_long_word(text):
    same_as_library([text])


def test_shared_prefixes_are_walked_once():
    model = byte_pairs.byte_pairs(BYTES)
    words = sorted(f" {w}".encode() for w in ("inter", "internal", "international", "internationally", "interval"))
    whole = model.encode_sorted(words)
    assert whole == [model.encode_sorted([w])[0] for w in words]
    assert [np.frombuffer(x, np.uint32).tolist() for x in whole] == [orc_tokens.load_tokenizer(BYTES).encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_byte_pairs_of_a_table(spark):
    long = " ".join(random.Random(1).choice(["alpha", "Beta,", "gämma", "12"]) for _ in range(300_000))
    rows = [(1, "one two"), (2, None), (3, ""), (None, " \n "), (5, "same"), (5, "same"), (-6, f"x{MARK}"), (7, long)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, ids string, exact int").repartition(2)
    library = orc_tokens.load_tokenizer(BYTES)
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), True] += 1
    assert Counter(map(tuple, byte_pairs.round_trip(docs, BYTES).collect())) == want
    assert byte_pairs.round_trip(docs.limit(0), BYTES).count() == 0
    back = byte_pairs.decode(byte_pairs.encode(docs, BYTES), BYTES)
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in rows)
    odd = spark.createDataFrame([(1, [0, 60000, -4]), (2, None), (3, [188])], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in byte_pairs.decode(odd, BYTES).collect()} == {1: "!", 2: "", 3: library.decode([188], skip_special_tokens=False)}


# hard negatives


def brute_negatives(rows):
    """By all pairs in Python integers; rows: (vec_id, vector, label)."""
    items = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        items.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    out = Counter()
    for a in (x for x in items if x[0] % 50 == 0):
        # rows of one id are told apart, so an item is left out by itself only
        scored = sorted(((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b) for b in items if b != a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for s, i, _ in [x for x in scored if x[2][1] == a[1]][:5]:
            fit = [(t, j) for t, j, b in scored if b[1] != a[1] and 50 * -s <= 100 * -t <= 95 * -s]
            for rank, (t, j) in enumerate(fit[:3], 1):
                out[a[0], i, rank, j, -s, -t] += 1
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(*x, "clash", 0) for x in rows], "vec_id long, embedding array<double>, label int, units string, score int").repartition(3)


@pytest.mark.parametrize("values,anchor_values", [(negatives.ROW_VALUES, negatives.ANCHOR_VALUES), (16 * 40, 16 * 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, values, anchor_values):
    monkeypatch.setattr(negatives, "ROW_VALUES", values)
    monkeypatch.setattr(negatives, "ANCHOR_VALUES", anchor_values)
    r = np.random.default_rng(4)
    centres = r.normal(size=(10, 16)) * np.linspace(3, 0.1, 16)
    rows = [(int(i), (centres[i % 10] * 0.3 + r.normal(size=16) * 0.2).tolist(), int(i % 10)) for i in range(600)]
    hot = rows[50][1]
    rows += [(1000 + i, hot, i % 2) for i in range(300)]  # ties: a third of all rows is one vector
    rows += [rows[3], rows[3], rows[100]]  # repeated rows
    rows += [(2000, None, 1), (2001, [0.5] * 16, None), (2050, [float("nan")] * 16, 3), (2100, [None] * 16, 3), (None, [0.1] * 16, 2), (2150, [0.0] * 16, 5), (2151, [0.0] * 16, 5), (2152, [0.0] * 16, 6), (2200, [1.0, 2.0], 1), (2201, [1.0, 2.0], 1), (2202, [0.8, 1.5], 3), (2250, [], 4), (2251, [], 4), (2252, [], 5), (-50, (-centres[1]).tolist(), 1)]
    got = Counter(map(tuple, negatives.hard_negatives(vectors_of(spark, rows)).collect()))
    assert got == brute_negatives(rows) and len(got) > 200


def test_hard_negatives_of_long_vectors_and_of_nothing(spark):
    rows = [(50, [3e4, -2e4], 1), (51, [2.9e4, -2e4], 1), (52, [2e4, -1e4], 2), (53, [1e300, 1.0], 1)]
    found = negatives.hard_negatives(vectors_of(spark, rows))
    assert Counter(map(tuple, found.collect())) == brute_negatives(rows[:3])
    assert negatives.hard_negatives(vectors_of(spark, rows).limit(0)).count() == 0


def test_most_pairs_are_discarded_before_they_are_multiplied_out():
    r = np.random.default_rng(5)
    x = np.floor(256 * r.normal(size=(4000, 64)) * 0.8 ** np.arange(64) @ np.linalg.qr(r.normal(size=(64, 64)))[0]).astype(np.int64)
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.int64()))
    rows = pa.table({"dim": pa.array([64] * 4000, pa.int32()), "vec_id": range(4000), "twin": [0] * 4000, "label": [1] * 4000, "units": lists(x)})
    anchors = pa.table({"anchor_id": range(32), "anchor_twin": [0] * 32, "anchor_label": [1] * 32, "anchor_units": lists(x[:32])})
    meeting = negatives.Meeting(rows, anchors)
    p, q = meeting.survivors(0, 32, meeting.others(0, 32), lambda m, low, high: m & (high >= negatives._kth_largest(np.where(m, low, -np.inf), 5)))
    assert len(p) < 0.05 * 32 * 4000
    exact = x[:32] @ x.T
    exact[np.arange(32), np.arange(32)] = -(1 << 60)
    for k in range(32):
        assert set(np.argsort(-exact[k], kind="stable")[:5]) <= set(q[p == k])


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c, n in counted:
            m = 75 + 25 * n * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    words = [*("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(300)), "The", "THE", "Ärger", "ÄRGER", "文字", "x1", "don't", "a_b", "é"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randint(0, 60))) for k in range(400)]
    docs += [(900, "the " * 50_000), (901, None), (902, ""), (903, "-- !! \n"), (None, text(20)), (None, text(20)), (904, text(150_000))]
    docs += [(1000 + k, docs[7][1]) for k in range(60)] + [docs[9]]  # ties beyond the last place, a repeated row
    items = [(k, text(r.randint(1, 25))) for k in range(30)] + [(77, None), (78, ""), (79, "zzzz"), (None, "the ab"), (5, "the the THE"), (5, "the the THE"), (80, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("per_pass,block", [(lexical.PASS_TERMS, lexical.BLOCK_POSTINGS), (60, 200)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, per_pass, block):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    rows, asked = corpus
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n long, terms string").repartition(3)
    items = spark.createDataFrame([(*x, 0) for x in asked], "item_id long, text string, rank int")
    assert Counter(map(tuple, lexical.search(docs, items, pass_terms=per_pass).collect())) == brute_search(rows, asked)


def test_search_in_and_for_nothing(spark, corpus):
    rows, asked = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id = 903"), items).count() == 0


def test_item_terms_keep_multiplicity(spark):
    items = spark.createDataFrame([(1, "b a B"), (1, "b a B"), (1, "c a")], "item_id long, text string")
    got = {(r["item_id"], bytes(r["term"]).decode()): r["times"] for r in lexical.item_terms(items).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1}
    assert lexical.NO_TERM.sum() == 128 - 62
