"""Each operator against brute force, a public library or an exact round trip."""

import collections
import hashlib
import random
import struct
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from tallyforge.llm import bpe_counts, mixing, orc_tokens, pieces, repeats, simhash, suffixes, tiff, toxicity, vectors
from tallyforge.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, d string, key string"


def corpus(seed=11, n=90, nulls=True):
    """Copied passages, periodic, empty, null and clashing columns."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij é") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(n):
        k = r.random()
        if k < 0.1:
            t = r.choice(["a", "ab ", "abc é"]) * r.randint(1, 200)
        elif k < 0.2:
            t = r.choice(["", " ", "x" * 99, "y" * 100, None])
        else:
            t = ""
            for _ in range(r.randint(1, 4)):
                b, x = r.choice(base), r.randint(0, 200)
                t += b[x : x + r.randint(50, 200)]
                if r.random() < 0.5:
                    t += "".join(r.choice("klm nop") for _ in range(r.randint(1, 90)))
        rows.append((i, t, r.choice(["en", None]), r.choice(["s0", "s0", "s1", None]), None, 7, "x", "y"))
    if nulls:
        rows += [(None, "free text without an id", None, None, None, 1, "x", "y")]
        rows += [rows[3], rows[3]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row[0], []).append(tuple(row)[1:] if not columns else tuple(row[c] for c in columns))
    return out


def expected_bytes(rows, length=100):
    seen, out = {}, {}
    docs = {d: (t or "").encode() for d, t, *_ in rows}
    for d in sorted(docs, key=lambda x: (x is not None, x)):
        b = docs[d]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.setdefault(w, d)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def expected_words(rows, length=35):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t, *_ in rows}
    count = collections.Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 0, 3])
def test_repeats_equal_brute_force(docs, hot):
    rows = corpus()
    got = by_id(repeats.removals(docs, repeats.BYTES, True, hot))
    want = expected_bytes(rows)
    assert sum(v[1] for v in want.values()) > 5000
    assert {d: v[0] for d, v in got.items()} == want and len(got[3]) == 3
    got = by_id(repeats.removals(docs, repeats.WORDS, False, hot))
    want = expected_words(rows)
    assert sum(v[1] for v in want.values()) > 500
    assert {d: v[0] for d, v in got.items()} == want


def test_repeats_keep_whole_characters_and_columns(docs):
    for row in repeats.removals(docs, repeats.BYTES, True, text=True, keep=("lang", "n_words")).collect():
        assert row["kept"].encode().decode() == row["kept"] and row["n_words"] in (1, 7)
        assert len(row["kept"].encode()) >= row["n_units"] - row["n_removed"]


def test_suffix_order_and_window_classes():
    r = random.Random(3)
    for _ in range(300):
        n, k = r.randint(1, 60), r.choice([1, 2, 3, 20])
        t = np.array([r.randint(1, k) for _ in range(n)])
        assert suffixes.suffix_order(t, 10).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        length = r.randint(1, min(n, 12))
        starts = np.arange(n - length + 1)
        names = suffixes.equal_windows(t, starts, length).tolist()
        windows = [tuple(t[i : i + length]) for i in starts]
        assert len(set(zip(names, windows))) == len(set(names)) == len(set(windows))


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_equals_brute_force(spark):
    r = random.Random(9)
    base = [" ".join("".join(r.choice("abcdeABC") for _ in range(4)) for _ in range(200)) for _ in range(4)]
    texts = [None, "", " \t", "one", "one two", "ONE TWO", "Straße Ä ä"]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    rows = [(i, t, None, None, None, 1, "x", "y") for i, t in enumerate(texts)] + [(3, "one", None, None, None, 1, "x", "y")]
    prints = {}
    for d, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {d: d for d in prints}
    for _ in range(20):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, DOCS)))
    assert {d: v[0] for d, v in got.items()} == {d: (f"{prints[d]:016x}", least[d]) for d in prints}
    assert len(set(least.values())) < len(set(prints.values())) < len(prints)


def test_simhash_tiles_do_not_change_links(spark):
    r = random.Random(2)
    seed = r.getrandbits(64)
    values = sorted({seed ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for _ in range(150)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp long, rep long")
    want = {(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2}
    for tile in (1024, 7):
        got = [(max(x["u"], x["v"]), min(x["u"], x["v"])) for x in simhash.links(prints, 2, tile).collect()]
        assert set(got) == want and len(got) == len(want)
        whole = {x["node"]: x["component"] for x in components(simhash.links(prints, 2, tile)).collect()}
        stars = simhash.links(prints, 2, tile, stars=True)
        assert {x["node"]: x["component"] for x in components(stars).collect()} == whole and stars.count() <= len(got)


@pytest.mark.parametrize("tile", [2048, 5])
def test_vector_links_equal_brute_force(spark, tile):
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, 8))
    rows = []
    for i in range(120):
        v = (centre[i % 6] + r.normal(size=8) * r.choice([0.05, 0.2, 0.4])).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(i % 2), "x"))
    rows += [(200 + k, rows[5][1], 1, "x") for k in range(5)]
    rows += [(300, None, 0, "x"), (301, [0.0] * 8, 0, "x"), (302, [1.0, None] + [0.0] * 6, 0, "x"), (303, [float("nan")] * 8, 0, "x"), (304, [], 0, "x"), (305, rows[0][1], None, "x"), (306, rows[0][1][:7], 0, "x"), (307, [float("inf")] + [0.0] * 7, 0, "x"), (None, rows[0][1], 0, "x")]
    sound = [x for x in rows if x[0] is not None and x[0] < 300]
    x = np.array([v for _, v, _, _ in sound], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k, _ in sound])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = np.array([i for i, *_ in sound])
    least = ids.copy()
    for _ in range(len(ids)):
        least = np.array([min([least[i], *least[near[i]]]) for i in range(len(ids))])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = by_id(vectors.near_duplicate_vectors(df, cells=4, tile=tile))
    want = {int(i): (int(near[k].sum()), int(least[k]), bool(least[k] == i)) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i in range(300, 308)} | {None: (0, None, False)}
    assert near.sum() > 200 and {d: v[0] for d, v in got.items()} == want
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


def strange_texts(n=400):
    r = random.Random(8)
    letters = "aeiouAbBсΣσςİıßﬁÀÅé'stremvldSTM0123456789.,!?-<|>\x1c\x85 　文字ｱ𝔸🙂_ͅ \t\n▁"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*texts, "", "  ", " a", "a  ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaa", "!!!!!!!!", "<s>", "<0x0A>", "▁▁ ▁", "word " * 3000]


def test_token_counts_equal_the_library(spark, none):
    texts = strange_texts()
    want = [len(e.ids) for e in orc_tokens.load_tokenizer(word_path()).encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "a"), (-2, "a")], "doc_id long, text string")
    got = by_id(bpe_counts.token_counts(df, word_path()))
    assert [got[i][0] for i in range(len(texts))] == [(len(t.encode()), n, n > 2048) for t, n in zip(texts, want)]
    assert got[-1] == [(0, 0, False)] and len(got[-2]) == 2
    assert bpe_counts.token_counts(none, word_path()).count() == 0


def test_orc_files_give_the_ids_back(spark, none, tmp_path):
    texts = strange_texts()
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)] + [(None, "first"), (None, None), (10**6, "z"), (10**6, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/ids"
    got = orc_tokens.token_file_report(df, word_path(), path=path).collect()
    library = orc_tokens.load_tokenizer(word_path())
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start, want = 0, []
    for d, t in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    import pyarrow.orc

    one = next(p for p in (tmp_path / "ids").glob("*.orc"))
    assert "ids" in pyarrow.orc.ORCFile(str(one)).schema.names
    assert spark.read.orc(path).where("doc_id = -47").count() == 1
    assert orc_tokens.token_file_report(none, word_path()).count() == 0


def test_pieces_equal_the_library_and_decode(spark, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = strange_texts()
    got = [ids[a:b].tolist() for _, ids, ends in pieces.encode_rows(pa.array(texts), path) for a, b in zip(ends, ends[1:])]
    assert got == library.encode(texts)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(-1, None, 0)], "doc_id long, text string, n_pieces int")
    found = {x["doc_id"]: x for x in pieces.round_trip(df, path, text=True).collect()}
    assert all(found[i]["exact"] and found[i]["text"] == t.replace("▁", " ") for i, t in enumerate(texts)) and found[-1]["n_pieces"] == 0
    back = by_id(pieces.decode(pieces.encode(df, path), path))
    assert all(back[i][0][0] == t.replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.round_trip(none, path, keep=("n_words",)).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    r = np.random.default_rng(1)
    for page in (r.integers(0, 256, (90, 192), dtype=np.uint8), np.repeat(r.integers(0, 4, (300, 64), dtype=np.uint8), 3, axis=1), np.zeros((1, 192), np.uint8)):
        back = list(tiff.read_tiff(tiff.write_tiff([page, page[:1]], compression, predictor, tile=tile)))
        assert (back[0][:, :, 0] == page).all() and (back[1][:, :, 0] == page[:1]).all()


def test_tiff_reads_big_endian_planes():
    import struct

    data = b"MM\0*\0\0\0\x08"
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (277, 3, 1), (278, 3, 2), (279, 4, 4)]
    body_at = 8 + 2 + 12 * (len(tags) + 1) + 4
    entries = sorted([*tags, (273, 4, body_at)])
    data += struct.pack(">H", len(entries))
    for tag, kind, value in entries:
        data += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    data += b"\0\0\0\0" + bytes([1, 2, 3, 4])
    assert next(tiff.read_tiff(data))[:, :, 0].tolist() == [[1, 2], [3, 4]]


def test_tiff_pages_and_media(spark, docs, none):
    page = np.arange(192, dtype=np.uint8).reshape(1, -1)
    files = spark.createDataFrame([("a", bytearray(tiff.write_tiff([page, page]))), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    rows = tiff.tiff_pages(files).collect()
    assert [(x["path"], x["page"]) for x in sorted(rows, key=lambda x: (x["path"], x["page"] or 0))] == [("a", 0), ("a", 1), ("b", None), ("c", None)]
    assert all((x["pixels"] is None) == (x["error"] is not None) for x in rows)
    texts = {d: t for d, t, *_ in corpus()}
    for x in tiff.media_report(docs).collect():
        raw = (texts[x["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert tiff.media_report(none).count() == 0


def test_chain_marginals_equal_enumeration():
    import itertools

    r = np.random.default_rng(0)
    lengths = [5, 1, 0, 7, 3, *[2] * 12]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    u, moves = r.normal(size=offsets[-1]) * 2, np.array([-1.0, 0.5, 0.7])
    got = toxicity.marginals(u, offsets, moves)
    for a, b in zip(offsets, offsets[1:]):
        total, on = 0.0, np.zeros(b - a)
        for path in itertools.product([0, 1], repeat=int(b - a)):
            score, before = 0.0, 0
            for k, s in enumerate(path):
                score += u[a + k] * s + {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[before, s]
                before = s
            total += np.exp(score)
            on += np.array(path) * np.exp(score)
        assert np.allclose(got[a:b], on / total)


def test_field_gradient_equals_differences():
    r = np.random.default_rng(5)
    lengths = [6, 1, 9, 2]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = int(offsets[-1])
    rows, cols = r.integers(0, n, 25), r.integers(0, 4, 25)
    data = toxicity.Sequences(rows, cols, 4, r.normal(size=(n, 4)), offsets, r.integers(0, 2, n).astype(float), np.repeat([1.0, 5.0, 1.0, 5.0], lengths))
    at = [r.normal(size=4), r.normal(size=4) * 0.3, -0.7, r.normal(size=3)]
    value, gradient = toxicity.likelihood(data, *at)
    assert value < 0
    for part in range(4):
        for k in range(np.size(at[part])):
            shifted = []
            for d in (1e-6, -1e-6):
                moved = [np.array(x, dtype=float, copy=True) for x in at]
                moved[part].reshape(-1)[k] += d
                moved[2] = float(moved[2])
                shifted.append(toxicity.likelihood(data, *moved)[0])
            assert np.isclose((shifted[0] - shifted[1]) / 2e-6, np.reshape(gradient[part], -1)[k], rtol=1e-4, atol=1e-5), (part, k)


def test_toxicity_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    truth = {x["doc_id"]: x["toxic"] for x in labels.where("toxic IS NOT NULL").collect()}
    held = [d for d in truth if d in got and got[d]["held_out"]]
    found = sum(truth[d] == 1 == got[d]["predicted"] for d in held)
    toxic, flagged = sum(truth[d] for d in held), sum(got[d]["predicted"] for d in held)
    print(f"held out: {len(held)}, toxic {toxic}, recall {found / toxic:.3f}, precision {found / flagged:.3f}")
    assert toxic >= 50 and found / toxic >= 0.9 and found / flagged >= 0.95


def toxic_corpus(n=600):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["vilex", "Vilex,", "gromp!", "nastik"]))
        docs.append((i, " ".join(w)))
        if r.random() < 0.8:
            labels.append((i, None, int(bad)))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (3, docs[3][1])]
    return docs, [*labels, (None, 1, 1), (5, 1, None), (10**7, 1, 1)]


def test_toxicity_held_out_accuracy(spark, none):
    rows, marks = toxic_corpus()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}
    truth = {d: t for d, _, t in marks if t is not None}
    texts = dict(rows)
    held = [d for d in truth if d in got and d is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) >= 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[600]["predicted"] == 0 and got[601]["predicted"] == 0
    spans = [(d, texts[d].encode()[s["start"] : s["stop"]].decode()) for d in truth if d in got for s in got[d]["spans"]]
    assert spans and np.mean([bool(re.search("(?i)vilex|gromp|nastik", s)) for _, s in spans]) > 0.9
    assert toxicity.toxicity(none, labels).count() == 0
    assert {x["predicted"] for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_mixing_meets_targets(spark, docs, none):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(1, 150), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), 1, 1, "x", "y") for i in range(600)]
    big = spark.createDataFrame([*rows, rows[0]], DOCS)
    cells = mixing.describe(big).groupBy("source", "lang", "topic").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens")
    target = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("(none)", 0.3)], "source string, share double")
    fitted = mixing.rake(cells, {"source": target}, sweeps=20).toPandas()
    mass = (fitted.tokens * fitted.f).groupby(fitted.source).sum()
    assert np.allclose(mass / mass.sum(), [{"a": 0.2, "b": 0.5, "(none)": 0.3}[s] for s in mass.index], atol=0.01)
    got = mixing.mix(big).toPandas()
    assert len(got) == 601 and got.p.between(0, 1).all() and abs((got.p * got.n_tokens).sum() / got.n_tokens.sum() - 0.9) < 0.02
    assert got[got.doc_id == 0].sampled.nunique() == 1 and ((got.copies > 0) == got.sampled).all()
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0
    plan = mixing.mix(big)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_meet_targets(spark):
    r = random.Random(8)
    big = spark.createDataFrame([(i, "w " * r.randint(1, 60), r.choice(["en"] * 9 + ["de"]), r.choice(["a"] * 6 + ["b"]), 1, 1, "x", "y") for i in range(4000)], DOCS)
    target = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "source string, share double")
    got = mixing.mix(big, {"source": target}).toPandas()
    share = lambda times: (got.n_tokens * times).groupby(got.source).sum()["b"] / (got.n_tokens * times).sum()
    assert abs(share(got.copies) - 0.6) < 0.02 and share(got.sampled) < 0.3
    assert ((got.copies > 0) == got.sampled).all() and got.copies.max() > 1


def test_sample_meets_targets_on_the_tables(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    for dim in mixing.DIMENSIONS:
        observed = got.n_tokens.groupby(got[dim]).sum()
        target = (observed**mixing.TEMPER) / (observed**mixing.TEMPER).sum()
        for times, most in ((got.weight, 0.001), (got.copies, 0.02)):
            mass = (got.n_tokens * times).groupby(got[dim]).sum()
            assert (mass / mass.sum() - target).abs().max() < most, dim
    assert abs((got.n_tokens * got.p).sum() / got.n_tokens.sum() - mixing.RATE) < 1e-4


def test_targets_that_conflict_warn_and_end(spark):
    rows = [(i, "w " * 5, "en" if i < 30 else "de", "a" if i < 30 else "b", 1, 1, "x", "y") for i in range(40)]
    target = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double")
    with pytest.warns(UserWarning, match="missed"):
        got = mixing.mix(spark.createDataFrame(rows, DOCS), {"source": target}).toPandas()
    assert len(got) == 40 and got.p.between(0, 1).all()


def test_token_counts_equal_the_library_on_all_characters(spark):
    r = random.Random(12)
    ranges = [range(1, 0x250), range(0x250, 0x3000), range(0x3000, 0xD800), range(0xE000, 0x11000), range(0x11000, 0x20000), range(0x20000, 0x110000)]
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200))]
    pairs = ["".join(chr(r.choice(r.choice(ranges))) for _ in range(r.randint(2, 4))) for _ in range(60_000)]
    mixed = ["".join(r.choice(["a", "1", "'", "é", "я", chr(r.choice(r.choice(ranges)))]) for _ in range(4)) for _ in range(40_000)]
    words = [*every, *pairs, *mixed, "\u0130\u0558", "\u200d\U00018f68", "\u0441\U00018d13", "\ua7cb", "\ua7dc", "<|endoftext|>\u0130<|startoftext|>"]
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["n_tokens"] for x in bpe_counts.token_counts(df, word_path()).collect()}
    want = [len(e.ids) for e in orc_tokens.load_tokenizer(word_path()).encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
    # op8 writes the same ids and one more
    some = df.where("doc_id % 20 = 0")
    stored = {x["doc_id"]: x["n_tokens"] for x in orc_tokens.token_file_report(some, word_path()).collect()}
    assert stored == {i: n + 1 for i, n in got.items() if i % 20 == 0}


def test_double_vectors_at_the_threshold(spark):
    import math

    near = lambda cosine: [cosine, math.sqrt(1 - cosine * cosine), 0.0]
    rows = [(1, [2.0, 0.0, 0.0], 1), (2, near(0.93 + 1e-10), 1), (3, [1.0, 0.0, 0.0], 2), (4, near(0.93 - 1e-10), 2), (5, [1e-200, 0.0, 0.0], 3), (6, [3e200, 1e190, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_duplicate_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_vectors_spread_evenly(spark):
    """Directions all over, where cells spare nothing: a vector is copied once a tile at most."""
    r = np.random.default_rng(3)
    x = r.normal(size=(50_000, 16)).astype(np.float32)
    x[1::100] = x[0::100] + r.normal(size=(500, 16)).astype(np.float32) * 0.02
    df = spark.createDataFrame(zip(range(len(x)), x.tolist()), "rep long, vec array<float>").selectExpr("7L as label", "16 as dim", "rep", "1L as n", "vec")
    links = vectors.vector_links(df).cache()
    got = {y["u"]: y["m"] for y in links.groupBy("u").sum("m").withColumnRenamed("sum(m)", "m").collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for at in range(0, len(x), 2000):
        near = (unit[at : at + 2000] @ unit.T >= 0.93).sum(axis=1) - 1
        want |= {at + int(k): int(near[k]) for k in np.flatnonzero(near)}
    assert got == want and len(want) >= 1000
    rows = vectors._sized(df, vectors.BLOCK, None)
    packed = vectors.materialize(vectors._tiled(rows, vectors.materialize(vectors._seeds(rows)), vectors.TILE))
    tiles = {t for y in packed.collect() for t in range(y["tile"], y["tile"] + 2 * y["slots"], 2)}
    copies = vectors._placed(rows, packed, 0.4, "array<float>").count()
    assert len(tiles) <= 8 and copies <= len(x) * len(tiles)


def test_tiff_damage_leaves_good_pages(spark):
    page = np.arange(192, dtype=np.uint8).reshape(1, -1)
    good = tiff.write_tiff([page, page], tiff.NONE, 1)
    pages = list(tiff._directories(good))
    bits = bytearray(good).replace(struct.pack("<HHIHH", 258, 3, 1, 8, 0), struct.pack("<HHIHH", 258, 3, 1, 1, 0))
    at = pages[1][1][tiff.STRIP_OFFSETS][0]
    short = bytearray(good).replace(struct.pack("<HHII", tiff.STRIP_OFFSETS, 4, 1, at), struct.pack("<HHII", tiff.STRIP_OFFSETS, 4, 1, len(good) - 5))
    assert bits != good and short != good
    files = spark.createDataFrame([("bits", bits), ("short", short)], "path string, content binary")
    rows = sorted((x["path"], x["page"] is None, x["error"] is not None) for x in tiff.tiff_pages(files).collect())
    assert rows == [("bits", True, True), ("short", False, False), ("short", True, True)]
