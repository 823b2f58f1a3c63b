"""Byte-level BPE encoding and decoding over a prefix-sharing trie of distinct words.

The distinct words of a batch, sorted, are a trie's nodes in depth-first order:
the walk keeps one state for every prefix on its path, and a word adds states
only below the prefix that it shares with the word before. A prefix's state is
the last token of its encoding. Exactly one token can be that: one that ends the
prefix, and that stays apart from the last token of what is left in front of it
when the two tokens' bytes are merged by rank. So a word's ids are read off the
path backwards, and no prefix is encoded twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_counts import _byte_letters
from .common import SPACE, doc_columns, ragged_take, row_chunks, text_bytes, text_slices
from .orc_tokens import load_tokenizer

#: Words whose ids a worker keeps between batches, and pairs of tokens that it remembers.
CACHED_WORDS, KNOWN_PAIRS = 200_000, 4_000_000
GATHER_BYTES = 4 << 20
_LOADED: dict = {}
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space, printable ASCII, Latin letters and basic Cyrillic: every version of Unicode classes them alike.
_COMMON = regex.compile("[\t-\r -~À-ÖØ-öø-ɏА-я]*").fullmatch
#: First two bytes of the three-byte characters among which Unicode has white space.
_WIDE_SPACE = np.zeros(1 << 16, dtype=bool)
_WIDE_SPACE[[0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = True


class BytePairs:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or spec.get("normalizer") or spec["pre_tokenizer"] != {**spec["pre_tokenizer"], "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{path} is no byte-level BPE file of the kind that is read here")
        self.library = load_tokenizer(path)
        self.pattern = regex.compile(PATTERN)
        letters = _byte_letters()
        self.back = {ord(c): b for b, c in enumerate(letters)}
        raw = lambda token: token.translate(self.back).encode("latin-1")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            shown[k] = raw(token)
        for token, k in self.special.items():
            shown[k] = token.encode()
        self.bytes_of = shown
        self.shown_size = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.byte_ids = [vocab[c] for c in letters]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        # a trie of the tokens' bytes from their ends: (node << 8 | byte) to node, and the token of a node
        self.step: dict[int, int] = {}
        self.token = [-1]
        for k in vocab.values():
            if self.merge(shown[k]) != [k]:
                continue
            node = 0
            for b in reversed(shown[k]):
                after = self.step.get(node << 8 | b)
                if after is None:
                    after = self.step[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = after
            self.token[node] = k
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of a few bytes by the plain procedure: join the pair of least rank, leftmost first, while any joins."""
        ids, ranks = [self.byte_ids[b] for b in data], self.ranks
        while len(ids) > 1:
            found = [(r[0], k) for k in range(len(ids) - 1) if (r := ranks.get(ids[k] << 20 | ids[k + 1])) is not None]
            if not found:
                break
            _, k = min(found)
            ids[k : k + 2] = [ranks[ids[k] << 20 | ids[k + 1]][1]]
        return ids

    def stay_apart(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes, merged, give these two tokens."""
        if len(self.apart) >= KNOWN_PAIRS:
            self.apart.clear()
        known = self.apart[before << 20 | token] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def encode_sorted(self, words: list[bytes]) -> list[bytes]:
        """Ids (32-bit, as bytes) of each of the sorted words."""
        out: list[bytes] = []
        state: list[int] = [-1]  # last token of every prefix on the path; the empty prefix has none
        step, token, sizes, apart = self.step, self.token, self.shown_size.tolist(), self.apart
        previous = b""
        for word in words:
            n, shared, most = len(word), 0, min(len(previous), len(word))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del state[shared + 1 :]
            for i in range(shared, n):
                node, k, found = 0, i, -1
                while k >= 0:
                    node = step.get(node << 8 | word[k])
                    if node is None:
                        break
                    last = token[node]
                    if last >= 0:
                        if k == 0:
                            found = last
                            break
                        before = state[k]
                        good = apart.get(before << 20 | last)
                        if good is None:
                            good = self.stay_apart(before, last)
                        if good:
                            found = last
                            break
                    k -= 1
                if found < 0:
                    raise ValueError(f"no token ends {word[: i + 1]!r}")
                state.append(found)
            previous = word
            ids: list[int] = []
            i = n
            while i:
                ids.append(state[i])
                i -= sizes[state[i]]
            out.append(np.array(ids[::-1], dtype=np.uint32).tobytes())
        return out

    def pretokens(self, piece: str) -> list[bytes]:
        """Pre-tokens of a piece without special strings; beyond common characters the library itself splits."""
        if _COMMON(piece):
            return [m.encode() for m in self.pattern.findall(piece)]
        return [token.translate(self.back).encode("latin-1") for token, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def parts(self, segment: str) -> list[bytes | int]:
        """Pre-tokens of a segment, and ids for the special strings in it."""
        for mark, k in self.special.items():
            if mark in segment:
                out: list[bytes | int] = []
                for piece in segment.split(mark):
                    out += [*self.parts(piece), k]
                return out[:-1]
        if segment.isascii() and segment.lstrip(" ").isalpha() and segment[1:2] != " ":
            return [segment.encode()]
        return self.pretokens(segment) if segment else []

    def segment_ids(self, segments: list[str]) -> list[bytes]:
        """Ids of each distinct segment; segments met before come from the worker's cache."""
        got = list(map(self.cache.get, segments))
        new = [k for k, x in enumerate(got) if x is None]
        split = [self.parts(segments[k]) for k in new]
        words = sorted({p for parts in split for p in parts if type(p) is bytes})
        known: dict[bytes | int, bytes] = dict(zip(words, self.encode_sorted(words)))
        known.update({k: np.array([k], np.uint32).tobytes() for k in self.special.values()})
        for k, parts in zip(new, split):
            got[k] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        room = CACHED_WORDS - len(self.cache)
        if room > 0:
            self.cache.update((segments[k], got[k]) for k in new[:room] if len(segments[k]) < 100)
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a whole document's ids; numbers that are no ids are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.shown_size))]
        return self.shown[ragged_take(self.shown_start[ids], self.shown_size[ids])].tobytes()


def byte_pairs(path: str) -> BytePairs:
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _segments(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments, the code of each segment, and segment offsets by row.

    A text is cut in front of white space that follows a character which is
    surely none. Pre-tokens don't cross such a place, and how white space is
    split depends on what comes after it alone.
    """
    data, offsets = text_bytes(text)
    white = SPACE[data]
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    before = data[at - 1]
    sure = (before > 0x20) & (before != 0x7F)
    two = np.where(at > 1, data[at - 2], 0)
    three = np.where(at > 2, data[at - 3], 0).astype(np.int64)
    at = at[sure & ((before < 0x80) | ((two != 0xC2) & ~_WIDE_SPACE[three << 8 | two]))]
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[at] = marks[offsets] = True
    cuts = np.flatnonzero(marks)
    if len(cuts) < 2:
        return [], np.zeros(0, np.int64), np.zeros(len(text) + 1, np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(cuts, offsets)


def encode_rows(text: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) pieces of a text column."""
    names, codes, first = _segments(text)
    made = byte_pairs(path).segment_ids(names)
    flat = np.frombuffer(b"".join(made), dtype=np.uint32)
    length = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
    start = np.cumsum(length) - length
    for a, b in row_chunks(first * 6, GATHER_BYTES):
        own = codes[first[a] : first[b]]
        n = length[own]
        ends = np.concatenate([[0], np.cumsum(n)])[first[a : b + 1] - first[a]]
        yield b - a, flat[ragged_take(start[own], n)], ends


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            at = 0
            for rows, ids, ends in encode_rows(batch.column(1), path):
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), lists], ["doc_id", "ids"])
                at += rows

    return doc_columns(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), special tokens shown. Null or no ids give an empty text; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            texts = [model.decode(flat[a:b]).decode(errors="replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact) of every whole text, encoded and decoded again.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the decoded text in UTF-8; exact says that this is the
    text. Special strings in a text are special tokens, as by the library's
    default. Null and empty texts have no tokens. Rows are kept as they come,
    repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path)
        for batch in text_slices(batches):
            at = 0
            for rows, ids, ends in encode_rows(batch.column(1), path):
                data, offsets = text_bytes(batch.column(1).slice(at, rows))
                view, own = memoryview(ids.astype("<u4", copy=False)).cast("B"), memoryview(data).cast("B") if len(data) else memoryview(b"")
                places, out = offsets.tolist(), ([], [], [])
                cuts = ends.tolist()
                for k in range(rows):
                    a, b = cuts[k], cuts[k + 1]
                    back = model.decode(ids[a:b])
                    same = back == own[places[k] : places[k + 1]]
                    # the text itself is UTF-8; other bytes are shown as the library shows them
                    shown = back if same else back.decode(errors="replace").encode()
                    out[0].append(hashlib.sha256(view[4 * a : 4 * b]).hexdigest())
                    out[1].append(hashlib.sha256(shown).hexdigest())
                    out[2].append(same)
                columns = [batch.column(0).slice(at, rows), pa.array(np.diff(ends)), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
                at += rows

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
