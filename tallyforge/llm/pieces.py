"""SentencePiece encoding and decoding over a trie of sorted, marked words.

Words carry the white-space mark in front and are sorted, so neighbours share
prefixes; walking the sorted list is a depth-first walk of their trie, and the
forward states of a shared prefix are kept from word to word. A position's
state is the last piece of the best segmentation of the prefix up to it. The
public model at hand is a merge model, whose best segmentation is not the one of
greatest summed score; a piece can follow a state when encoding the two pieces'
text gives back these two pieces, and exactly one piece can end each prefix.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, ragged_take, row_chunks, text_slices

MARK = "▁"
#: Words whose ids a worker keeps between batches.
CACHED_WORDS = 200_000
GATHER_BYTES = 4 << 20

_LOADED: dict = {}
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class PieceModel:
    """Pieces and scores of a SentencePiece merge model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.names: list[str] = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        shown: list[bytes] = []
        self.ends: dict = {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                shown.append(bytes((int(name[3:5], 16),)))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                shown.append(b"")
            else:
                self.ids[name], self.score[name] = i, model.get_score(i)
                shown.append(name.replace(MARK, " ").encode())
                node = self.ends
                for c in reversed(name):
                    node = node.setdefault(c, {})
                node[""] = i
        self.shown_size = np.fromiter(map(len, shown), dtype=np.int64, count=n)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The model's own procedure: join the best-scored neighbours, leftmost first, while any joins."""
        parts, score = list(text), self.score
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # neighbours wait by score and place, first ones in a list and new ones in a heap; what has been joined since is passed over
        first = sorted((-s, k) for k in range(n - 1) if (s := score.get(parts[k] + parts[k + 1])) is not None)
        first.reverse()
        new: list[tuple[float, int]] = []
        while first or new:
            s, k = first.pop() if first and (not new or first[-1] < new[0]) else heapq.heappop(new)
            j = after[k]
            if not parts[k] or j >= n or score.get(both := parts[k] + parts[j]) != -s:
                continue
            parts[k], parts[j] = both, ""
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (s := score.get(both + parts[j])) is not None:
                    heapq.heappush(new, (-s, k))
            i = before[k]
            if i >= 0 and (s := score.get(parts[i] + both)) is not None:
                heapq.heappush(new, (-s, i))
        return [p for p in parts if p]

    def _stands(self, piece: int) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.merge(self.names[piece])) == 1
        return known

    def _follow(self, before: int, piece: int) -> bool:
        key = before << 20 | piece
        known = self.follows.get(key)
        if known is None:
            a, b = self.names[before], self.names[piece]
            known = self.follows[key] = self.merge(a + b) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit, as bytes) of each of the sorted, marked words."""
        out: list[bytes] = []
        state: list[int] = [-1]  # last piece of each prefix; -1 at the start and after a character without a piece
        size: list[int] = [0]  # its characters
        previous, ends, follows = "", self.ends, self.follows
        for word in words:
            if MARK * 2 in word:
                # marks in a row all have one score, so their order decides: the plain procedure
                out.append(self._ids(self.merge(word)))
                continue
            n, shared, most = len(word), 0, min(len(previous), len(word))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del state[shared + 1 :], size[shared + 1 :]
            for i in range(shared, n):
                node, k, found = ends, i, -1
                while k >= 0:
                    node = node.get(word[k])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        before = state[k]
                        if before < 0:
                            good = self._stands(piece)
                        else:
                            good = follows.get(before << 20 | piece)
                            if good is None:
                                good = self._follow(before, piece)
                        if good:
                            found = piece
                            break
                    k -= 1
                state.append(found)
                size.append(i - k + 1 if found >= 0 else 1)
            previous = word
            ids: list[int] = []
            i = n
            while i:
                piece = state[i]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(word[i - 1].encode()))
                i -= size[i]
            out.append(np.array(ids[::-1], dtype=np.uint32).tobytes())
        return out

    def _ids(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for part in parts:
            known = self.ids.get(part)
            ids.extend([known] if known is not None else [self.byte_ids[b] for b in part.encode()])
        return np.array(ids, dtype=np.uint32).tobytes()

    def words_of(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct marked word; words met before come from the worker's cache."""
        got = list(map(self.cache.get, words))
        new = sorted((words[k], k) for k, x in enumerate(got) if x is None)
        made = self.encode_sorted([w for w, _ in new])
        for (_, k), ids in zip(new, made):
            got[k] = ids
        room = CACHED_WORDS - len(self.cache)
        if room > 0:
            self.cache.update((words[k], got[k]) for _, k in sorted(new, key=lambda x: x[1])[:room])
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        """Text bytes of a whole document's ids; the space put before the text is taken off."""
        return self.shown[ragged_take(self.shown_start[ids], self.shown_size[ids])].tobytes()[1:]


def piece_model(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _marked(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words, the code of each word, and word offsets by row."""
    import pyarrow.compute as pc

    text = text.cast(pa.large_string())
    odd = pc.or_(pc.match_substring_regex(text, f"  |^ | $|{MARK}"), pc.equal(pc.binary_length(text), 0))
    even_rows = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(text.take(pa.array(even_rows)), " ")
    flat = lists.flatten().dictionary_encode()
    names = [MARK + w for w in flat.dictionary.to_pylist()]
    index = {w: k for k, w in enumerate(names)}
    counts = np.zeros(len(text), dtype=np.int64)
    counts[even_rows] = lists.value_lengths().to_numpy(zero_copy_only=False)
    special = {}
    for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        value = text[row].as_py()
        words = _RUNS.findall(MARK + value.replace(" ", MARK)) if value else []
        for w in words:
            if w not in index:
                index[w] = len(names)
                names.append(w)
        special[row] = np.array([index[w] for w in words], dtype=np.int64)
        counts[row] = len(words)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    codes = np.empty(int(offsets[-1]), dtype=np.int64)
    codes[ragged_take(offsets[:-1][even_rows], counts[even_rows])] = flat.indices.to_numpy(zero_copy_only=False)
    for row, own in special.items():
        codes[offsets[row] : offsets[row + 1]] = own
    return names, codes, offsets


def encode_rows(text: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) pieces of a text column."""
    model = piece_model(path)
    names, codes, first = _marked(text)
    made = model.words_of(names)
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
    """(doc_id, text) of (doc_id, ids). Null or no ids give an empty text; ids that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                own = np.array(ids.as_py() or [], dtype=np.int64)
                texts.append(model.decode(own).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Columns: doc_id, the kept columns, n_bytes, n_pieces, ids_crc32 (of the ids
    as little-endian 32-bit integers), decoded_sha256, exact (the decoded text
    is the text, its marks U+2581 read as spaces), and with text the decoded text.
    Null and empty texts have no pieces. Rows are kept as they come.
    """
    more = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(["doc_id long", *more, "n_bytes long", "n_pieces long", "ids_crc32 long", "decoded_sha256 string", "exact boolean", *(["text string"] if text else [])])
    names = ["doc_id", *keep, "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "exact", *(["text"] if text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in text_slices(batches):
            at = 0
            for rows, ids, ends in encode_rows(batch.column(1), path):
                texts = batch.column(1).slice(at, rows).to_pylist()
                out = []
                for value, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
                    raw, back = value.encode(), model.decode(ids[a:b])
                    same = raw == back or value.replace(MARK, " ").encode() == back
                    out.append((len(raw), b - a, zlib.crc32(ids[a:b].tobytes()), hashlib.sha256(back).hexdigest(), same, back.decode(errors="replace") if text else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
                held = [batch.column(0).slice(at, rows), *(batch.column(2 + k).slice(at, rows) for k in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(held + columns[: len(names) - len(held)], names)
                at += rows

    return doc_columns(docs, *[docs[c].alias(f"_{k}") for k, c in enumerate(keep)]).mapInArrow(run, schema)
