"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyforge.llm import bpe_counts, common, mixing, orc_tokens, pieces, repeats, simhash, tiff, toxicity

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside, as columns of the input.
CLASHES = "score double, n_tokens string, fp long, d long, q int, h long, marks string, topic int, start long, ids string, part int, _0 string, held_out string, n string, component_id string"


def long_text(r, size):
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    out, n = [], 0
    while n < size:
        out.append(r.choice(words))
        n += len(out[-1]) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    # one text beyond a chunk of 1 MB, one beyond a slice of 8 MB
    return [(1, "one two three"), (2, None), (3, ""), (4, " \t\n"), (None, "no id here"), (None, None), (7, "first text"), (7, "second text"), (8, "same"), (8, "same"), (-5, "é ß я 文"), (9, long_text(r, 1_300_000)), (10, "x" * 400_000), (11, long_text(r, 8_600_000))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashes = [None] * len(CLASHES.split(","))
    full = [(d, t, "en" if d else None, "s" if d else None, None, *clashes) for d, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")


def operators(labels):
    return {
        "mixing": mixing.mix,
        "words": lambda d: repeats.removals(d, repeats.WORDS, False),
        "bytes": lambda d: repeats.removals(d, repeats.BYTES, True),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "bpe": lambda d: bpe_counts.token_counts(d, WORDS),
        "tiff": tiff.media_report,
        "orc": lambda d: orc_tokens.token_file_report(d, WORDS),
        "pieces": lambda d: pieces.round_trip(d, PIECES),
        "simhash": simhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["mixing", "words", "bytes", "toxicity", "bpe", "tiff", "orc", "pieces", "simhash"])
def test_every_row_comes_back(spark, docs, labels, rows, name):
    run = operators(labels)[name]
    got = [x["doc_id"] for x in run(docs).select("doc_id").collect()]
    key = lambda d: (d is not None, d)
    assert sorted(got, key=key) == sorted((d for d, _ in rows), key=key)
    assert run(docs.limit(0)).count() == 0


def test_long_texts_are_worked_on_whole(docs, rows):
    texts = {d: t for d, t in rows if d in (9, 10, 11)}
    library = orc_tokens.load_tokenizer(WORDS)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    long = docs.where("doc_id IN (9, 10, 11)")
    assert {x["doc_id"]: x["n_tokens"] for x in bpe_counts.token_counts(long, WORDS).collect()} == {d: len(x) for d, x in want.items()}
    stored = {x["doc_id"]: (x["n_tokens"], x["ids_crc32"]) for x in orc_tokens.token_file_report(long, WORDS).collect()}
    assert stored == {d: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for d, x in want.items()}
    media = {x["doc_id"]: x["payload_sha256"] for x in tiff.media_report(long).collect()}
    padded = lambda b: b.ljust(-(-len(b) // 192) * 192, b" ")
    assert media == {d: hashlib.sha256(padded(t.encode())).hexdigest() for d, t in texts.items()}
    back = {x["doc_id"]: (x["exact"], x["text"] == texts[x["doc_id"]]) for x in pieces.round_trip(long, PIECES, text=True).collect()}
    assert set(back.values()) == {(True, True)}
    left = {x["doc_id"]: (x["n_units"], x["n_removed"]) for x in repeats.removals(long, repeats.WORDS, False).collect()}
    assert left[9] == (len(texts[9].split()), 0) and left[10] == (1, 0)


def test_marginals_of_a_long_sequence_equal_the_plain_recursion():
    r = np.random.default_rng(2)
    u = np.concatenate([r.normal(size=5), r.normal(size=70_000) * 3, r.normal(size=3)])
    offsets = np.array([0, 5, 70_005, 70_008])
    moves = np.array([-2.0, 0.3, 0.8])
    got = toxicity.marginals(u, offsets, moves)
    a, b, c = np.exp(moves)
    for lo, hi in zip(offsets, offsets[1:]):
        e = np.exp(u[lo:hi])
        forward, back, p = [], 1.0, np.zeros(hi - lo)
        for x in e:
            forward.append(x * a if not forward else x * (a + forward[-1] * c) / (1 + forward[-1] * b))
        for k in range(hi - lo - 1, -1, -1):
            p[k] = forward[k] * back / (1 + forward[k] * back)
            back = (b + c * e[k] * back) / (1 + a * e[k] * back)
        assert np.allclose(got[lo:hi], p)


def test_pieces_decode_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).count() == 0


def test_token_files_have_indexes_and_are_pruned(spark, tmp_path):
    """Stripes hold Bloom filters, row indexes and run-length streams, and a lookup reads a part of the row groups."""
    path = f"file://{tmp_path}/ids"
    docs = spark.range(0, 60_000, 2).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        orc_tokens.write_token_ids(docs, path, WORDS)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        (part,) = (p for p in (tmp_path / "ids").glob("*.orc"))
        jvm = spark._jvm
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(part)), options)
        assert reader.getRowIndexStride() == 10_000 and reader.getNumberOfRows() == 30_000
        footer = reader.rows().readStripeFooter(reader.getStripes()[0])
        streams = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        assert (1, "BLOOM_FILTER_UTF8") in streams and {(c, "ROW_INDEX") for c in range(1, 6)} <= streams
        encodings = [c.getKind().toString() for c in footer.getColumnsList()]
        assert encodings[1:5] == ["DIRECT_V2"] * 4
        read = {}
        for what, where in (("there", "doc_id = 40002"), ("between", "doc_id = 40001"), ("all", "doc_id IS NOT NULL")):
            found = spark.read.orc(path).where(where).select("doc_id")
            plan = found._jdf.queryExecution().executedPlan()
            read[what] = (plan.execute().count(), plan.collectLeaves().head().metrics().apply("numOutputRows").value())
        assert read["there"] == (1, 10_000) and read["between"] == (0, 0) and read["all"] == (30_000, 30_000)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session)


def test_tiff_codecs_on_the_published_examples():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(packed) == plain and tiff.unpack_bits(tiff.pack_bits(plain)) == plain
    # nine-bit codes, high bit first: clear, 7, 258, 8, 8, 258, 6, 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    coded = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(coded) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def plain_reader(media):
    """Pages of a little-endian TIFF of deflated strips with horizontal differences, by the format's text alone."""
    assert media[:4] == b"II*\0"
    (at,) = struct.unpack_from("<I", media, 4)
    while at:
        (n,) = struct.unpack_from("<H", media, at)
        tags = {}
        for k in range(n):
            tag, kind, count, place = struct.unpack_from("<HHII", media, at + 2 + 12 * k)
            size = {3: 2, 4: 4}[kind] * count
            where = at + 2 + 12 * k + 8 if size <= 4 else place
            tags[tag] = struct.unpack_from(f"<{count}{'H' if kind == 3 else 'I'}", media, where)
        assert tags[259] == (8,) and tags[258] == (8,) and tags[317] == (2,)
        rows = b"".join(zlib.decompress(media[p : p + c]) for p, c in zip(tags[273], tags[279]))
        out = bytearray()
        for k, x in enumerate(rows):
            out.append((x + (out[-1] if k % tags[256][0] else 0)) & 255)
        assert len(out) == tags[256][0] * tags[257][0]
        yield bytes(out)
        (at,) = struct.unpack_from("<I", media, at + 2 + 12 * n)


def test_tiff_media_by_an_independent_reader(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "z" * 700), (5, "é\n" * 5000), (6, "x" * 192 * 4097)]
    for x in tiff.media_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        raw = (dict(rows)[x["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        media = tiff.write_tiff(tiff.payload_pages(payload), tiff.DEFLATE, 2)
        pages = list(plain_reader(media))
        assert b"".join(pages) == payload and x["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (x["media_bytes"], x["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = count[count > 0] / len(payload)
        want = f"pages={len(pages)};rows={len(payload) // 192};mean={sum(payload) / len(payload):.4f};levels={len(set(payload))};entropy={-(share * np.log2(share)).sum():.4f}"
        assert x["feature"] == want


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 100_001 + "b", "  x   y    z" * 3000])
def test_runs_of_spaces_equal_the_library(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = [i for _, ids, _ in pieces.encode_rows(pa.array([text]), PIECES) for i in ids.tolist()]
    assert got == library.encode(text)


def test_words_are_parted_alike_in_training_and_scoring():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    for space in ("\u3000", "\u00a0"):
        bad = f"x{space}zzgrumble"
        texts = [" ".join([*(word() for _ in range(30)), *([bad] if k % 4 == 0 else [])]) for k in range(400)]
        model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(400)])
        words, codes, first = common.split_words(pa.array([f"one two {bad}", "one two three"]))
        score = model.score(toxicity.marginals(model.emissions(words.to_pylist(), codes, first), first, model.moves), first)
        assert score[0] > 0.9 and score[1] < 0.1


def _float_page(values, order=">"):
    """A one-strip page of 32-bit floats under the floating-point predictor, by plain loops."""
    height, width = values.shape
    out = bytearray()
    for row in values:
        cells = [struct.pack(">f", v) for v in row]
        flat = [cells[x][byte] for byte in range(4) for x in range(width)]
        out += bytes([flat[0], *((b - a) % 256 for a, b in zip(flat, flat[1:]))])
    data = zlib.compress(bytes(out))
    fields = [(256, 4, width), (257, 4, height), (258, 3, 32), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data)), (317, 3, 3), (339, 3, 3)]
    body = b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(fields))
    for tag, kind, value in fields:
        body += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    return body + b"\0\0\0\0"


def test_floating_point_predictor_is_undone():
    values = np.random.default_rng(3).normal(size=(5, 7)).astype(np.float32)
    (page,) = tiff.read_tiff(_float_page(values))
    assert (page[:, :, 0].view(np.float32) == values).all()


def test_any_bytes_give_pages_or_a_tiff_error():
    r = np.random.default_rng(6)
    grid = r.integers(0, 255, (40, 64), dtype=np.uint8)
    files = [tiff.write_tiff([grid, grid[:9]], c, p, 16) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2)]
    files += [tiff.write_tiff([grid], tiff.DEFLATE, 1, tile=(16, 16)), _float_page(grid.astype(np.float32))]
    refused = 0
    for data in files:
        for _ in range(400):
            bad = bytearray(data)
            for at in r.integers(0, len(bad), r.integers(1, 4)):
                bad[at] = r.integers(0, 256)
            try:
                pages = list(tiff.read_tiff(bytes(bad[: r.integers(1, len(bad) + 1)] if r.random() < 0.2 else bad)))
            except tiff.TiffError:
                refused += 1
            else:
                assert sum(p.nbytes for p in pages) <= 5000 * len(data)
    assert refused > 300
    # sizes of nothing and of a quarter of a terabyte in a small file
    for tag, value in ((256, 0), (257, 0), (278, 0), (256, 1 << 31), (257, 1 << 31), (317, 9)):
        bad = bytearray(files[0])
        at = bad.find(struct.pack("<HH", tag, 3 if tag == 317 else 4), 8)
        bad[at + 8 : at + 12] = struct.pack("<I", value)
        with pytest.raises(tiff.TiffError):
            list(tiff.read_tiff(bytes(bad)))
