"""The pipeline's stages, each on its own input, against plain Python; and run() as their chain."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tallyforge.llm import mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(160):
        bad = r.random() < 0.25
        w = [r.choice(words) for _ in range(r.randint(3, 140))]
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vilex", "gromp"]))
        t = " ".join(w)
        if i % 9 == 0 and docs:
            t = docs[-1][1]
        elif i % 11 == 0:
            t = f"{t} é{passage}é {t[:40]}"
        docs.append((i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", None]), None if t is None else len(t)))
        labels.append((i, int(any(x in (t or "") for x in ("vilex", "gromp")))))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (3, docs[3][1], "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, labels


def toxic_stage(rows, labels):
    """Words one by one through the field, by the plain recursions."""
    texts = {d: t for d, t, *_ in rows}
    train = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 and d in texts and texts[d]]
    marks = dict(labels)
    fold = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 5]
    rate = (sum(marks[d] for d in fold) + 0.5) / (len(fold) + 1)
    known = {}
    for d in sorted(train):
        known[texts[d]] = max(known.get(texts[d], 0), marks[d])
    model = toxicity.fit(list(known), list(known.values()), rate)
    a, b, c = np.exp(model.moves)
    keep = []
    for row in rows:
        words = re.findall(r"[^ \t-\r]+", row[1] or "")
        own = [sum(model.weights.get(x, 0.0) for x in toxicity.features(w)) for w in words]
        mark = [0, *[x != 0 for x in own], 0]
        near = lambda k: np.array([mark[k], mark[k + 2], mark[k + 1] and len(words[k]) > 1 and words[k].isupper(), mark[k + 1] and words[k].endswith("!")], dtype=float) @ model.context
        e = [float(np.exp(min(20.0, max(-20.0, x + near(k) + model.bias)))) for k, x in enumerate(own)]
        forward, back, p = [], 1.0, [0.0] * len(e)
        for x in e:
            forward.append(x * a if not forward else x * (a + forward[-1] * c) / (1 + forward[-1] * b))
        for k in range(len(e) - 1, -1, -1):
            p[k] = forward[k] * back / (1 + forward[k] * back)
            back = (b + c * e[k] * back) / (1 + a * e[k] * back)
        total = sum(p)
        z = model.curve @ [1.0, np.log1p(total), max(p, default=0.0), min(20 * total / max(len(p), 1), 2.0)]
        if z < 0:
            keep.append((row[0], row[1] or "", *row[2:]))
    return keep


def simhash_stage(rows):
    prints = {}
    for d, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    least = {d: d for d in prints}
    for _ in range(8):
        for x in prints:
            for y in prints:
                if (prints[x] ^ prints[y]).bit_count() <= 2:
                    least[x] = least[y] = min(least[x], least[y])
    first = {}
    for row in sorted(rows, key=lambda x: (x[0], x[1] or "", str(x[2:]))):
        first.setdefault(least[row[0]], row)
    return list(first.values())


def suffix_stage(rows):
    seen, out = set(), []
    for d, t, lang, source, _ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        at, kept = 0, ""
        for ch in t or "":
            n = len(ch.encode())
            if not all(gone[at : at + n]):
                kept += ch
            at += n
        out.append((d, kept, lang, source, len(kept)))
    return out


def mixing_stage(rows):
    count = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    kind = lambda t: "table" if " | " in t else "code" if "{" in t or ' = "' in t else "long" if count(t) >= 1000 else "prose" if count(t) >= 100 else "short"
    cell = {k: (r[3] or "(none)", r[2] or "(none)", kind(r[1] or "")) for k, r in enumerate(rows)}
    tokens = collections.Counter()
    for k, r in enumerate(rows):
        tokens[cell[k]] += count(r[1])
    total, f = sum(tokens.values()), dict.fromkeys(tokens, 1.0)
    goals = []
    for dim in range(3):
        mass = collections.Counter()
        for c, n in tokens.items():
            mass[c[dim]] += n
        powered = {v: n**mixing.TEMPER for v, n in mass.items()}
        goals.append({v: x / sum(powered.values()) for v, x in powered.items()})
    for _ in range(mixing.SWEEPS):
        for dim in range(3):
            mass = collections.Counter()
            for c, n in tokens.items():
                mass[c[dim]] += n * f[c]
            f = {c: f[c] * goals[dim][c[dim]] * total / mass[c[dim]] if mass[c[dim]] else 0.0 for c in f}
    # by bisection: the documents that occur hold MIX_RATE of the tokens
    low, high = 0.0, 1e9
    for _ in range(200):
        scale = (low + high) / 2
        over = sum(n * min(1.0, f[c] * scale) for c, n in tokens.items()) > corpus_pipeline.MIX_RATE * total
        low, high = (low, scale) if over else (scale, high)
    draw = lambda d: int(hashlib.md5(f"{mixing.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / (1 << 52)
    copies = lambda k, r: int(f[cell[k]] * scale) + (draw(r[0]) < f[cell[k]] * scale % 1)
    return [r for k, r in enumerate(rows) for _ in range(copies(k, r))]


def pieces_stage(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d, t, lang, source, _ in rows:
        ids, raw = model.encode(t or ""), (t or "").encode()
        out.append((d, lang, source, len(raw), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(raw).hexdigest(), True, t or ""))
    return out


def test_stages_and_run_equal_plain_python(spark, tables, tmp_path):
    path, labels = tables
    brute = [lambda r: toxic_stage(r, labels), simhash_stage, suffix_stage, mixing_stage, pieces_stage]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        stage(spark, docs.withColumn("score", docs.doc_id).withColumn("d", docs.text), path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert order(docs.collect()) == order(brute[k](rows)), name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] != sizes[4] > 0
    assert order(corpus_pipeline.run(spark, path).collect()) == order(docs.collect())


def test_stages_take_empty_tables(spark, tables):
    path, _ = tables
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_near_copies_go_by_row(spark, tables):
    path, _ = tables
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven eight"
    rows = [(3, one), (5, one), (5, two), (None, two + " nine"), (None, one), (None, "quite another text that stands alone here"), (7, None)]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, path).collect()
    got = {(x["doc_id"], x["text"]) for x in kept}
    assert {(3, one), (5, two), (None, "quite another text that stands alone here"), (7, "")} <= got
    assert (5, one) not in got and (None, one) not in got and len(kept) == len(got)


def test_the_driver_keeps_nothing_of_the_training_sample(spark, monkeypatch):
    """While the model is fitted the driver holds the texts once, and hands their memory back after that."""
    import gc

    import pyarrow as pa
    from pyspark.sql import Row

    said, fit = [], toxicity.fit

    def watched(texts, *more):
        said.append((isinstance(texts, pa.Array), sum(type(x) is Row and "text" in x for x in gc.get_objects())))
        return fit(texts, *more)

    monkeypatch.setattr(toxicity, "fit", watched)
    monkeypatch.setattr(toxicity, "give_back", lambda: said.append("given back"), raising=False)
    toxicity.train(*(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels")))
    assert said[0] == (True, 0) and said[-1] == "given back"
