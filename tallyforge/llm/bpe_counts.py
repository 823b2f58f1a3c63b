"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_columns, split_words, text_slices
from .orc_tokens import load_tokenizer

_LOADED: dict = {}
#: Printable ASCII, Latin letters (but for one whose lower case is more than a letter) and
#: basic Cyrillic: characters that every version of Unicode lower-cases and classes alike.
_COMMON = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0410-\u044f]*").fullmatch
#: Distinct pre-tokens merged in one ragged array.
BATCH = 50_000


class RankMerger:
    """Merge table of a word-end BPE file, and the count of tokens of byte strings."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.suffix = suffix
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.library = load_tokenizer(path)
        letters = _byte_letters()
        self.back = {ord(c): b for b, c in enumerate(letters)}
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], dtype=np.int64)
        pairs, made = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(vocab[a] << 20 | vocab[b])
            made.append(vocab[a + b])
        keys = np.array(pairs, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, dtype=np.int64)
        self.none = len(keys)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; none where there is no merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each non-empty byte string data[offsets[i]:offsets[i + 1]]."""
        n = len(offsets) - 1
        out = np.diff(offsets)
        ids = self.inner[data]
        last = offsets[1:] - 1
        ids[last] = self.final[data[last]]
        row = np.repeat(np.arange(n), out)
        while len(ids) > 1:
            # ranks of neighbours in one sequence
            rank = np.full(len(ids), self.none, dtype=np.int64)
            same = np.flatnonzero(row[:-1] == row[1:])
            rank[same] = self.lookup(ids[same], ids[same + 1])
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.concatenate([heads, [len(ids)]]))
            live = least < self.none
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < self.none))
            if not len(hit):
                break
            # overlapping hits (aaa) merge from the left: every second one of a run
            run = np.concatenate([[True], np.diff(hit) != 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.repeat(live, sizes)
            keep[hit + 1] = False
            out[row[heads]] = sizes - np.bincount(np.searchsorted(heads, hit, side="right") - 1, minlength=len(heads))
            ids, row = ids[keep], row[keep]
        return out

    def pretokens(self, piece: str) -> list[bytes]:
        """The pre-tokens of a part of a word without special strings.

        Beyond common characters the library itself normalises and splits, since
        what is a letter, a digit or a lower case depends on its Unicode tables.
        """
        if _COMMON(piece):
            return [m.encode() for m in self.pattern.findall(piece.lower()) if m]
        text = self.library.normalizer.normalize_str(piece)
        return [token.translate(self.back).encode("latin-1") for token, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if token]

    def word_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (no ASCII white space in it)."""
        total = np.zeros(len(words), dtype=np.int64)
        owner: list[int] = []
        pieces: list[bytes] = []
        for i, word in enumerate(words):
            parts = [word]
            if "<|" in word:
                for mark in self.special:
                    split = [p.split(mark) for p in parts]
                    total[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            for part in parts:
                if part.isascii() and part.isalpha():
                    owner.append(i)
                    pieces.append(part.lower().encode())
                    continue
                for token in self.pretokens(part):
                    owner.append(i)
                    pieces.append(token)
        for at in range(0, len(pieces), BATCH):
            some = pieces[at : at + BATCH]
            lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            np.add.at(total, owner[at : at + BATCH], self.counts(np.frombuffer(b"".join(some), np.uint8), offsets))
        return total


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for 256 and up.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def merger(path: str) -> RankMerger:
    if path not in _LOADED:
        _LOADED[path] = RankMerger(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; a null text is empty.

    Each batch's distinct white-space words are merged once; a text's count is
    the sum over its words. Rows are kept as they come, repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        own = merger(path)
        for batch in text_slices(batches):
            words, codes, first = split_words(batch.column(1))
            per_word = own.word_counts(words.to_pylist())
            sums = np.concatenate([[0], np.cumsum(per_word[codes])])[first]
            n = np.diff(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
