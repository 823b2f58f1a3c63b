"""Toxic spans by a linear-chain conditional random field over words.

Labels mark documents, so the training words are labelled first: a word of a
toxic document is toxic when its form or a stem of it is far and significantly
commoner in toxic than in clean documents of the sample. The field, with the
word's features, its neighbours' and its shape, is fitted to those labels by the
gradient of its log-likelihood (forward-backward); then words that the field
doesn't believe lose their label, and it is fitted again. Scoring takes the
marginals of every word of the whole text; a logistic curve over their sum,
maximum and density gives the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, give_back, ragged_take, row_chunks, split_words, text_bytes, text_slices, word_spans

#: Bounds of the training sample: documents of each label, and bytes of one text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 2000, 1 << 15
#: A feature marks toxic words from this many toxic documents, this odds ratio and this likelihood-ratio statistic on.
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE = 3, 8.0, 12.0
#: Times that the field is fitted and the words' labels are estimated from it.
ROUNDS = 2
#: One quiet segment in so many enters training, with so many times its weight.
QUIET = 5
STEMS = range(5, 10)
FOLDS = 5
SEGMENT, STEPS, RATE, DECAY = 128, 60, 0.2, 1e-3
CLIP = 20.0
#: Bytes of text that are tagged at once.
TAG_BYTES = 4 << 20
_EDGES = re.compile(r"^\W+|\W+$")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def features(word: str) -> list[str]:
    """The lower-cased form without outer punctuation, and its stems."""
    form = _EDGES.sub("", word.lower())
    return [f"={form}", *(form[:n] for n in STEMS if len(form) >= n)] if form else []


def _shape(words: list[str]) -> np.ndarray:
    """For each word, whether it is in capitals, and whether it ends in an exclamation mark."""
    return np.array([(len(w) > 1 and w.isupper(), w.endswith("!")) for w in words], dtype=np.float64).reshape(len(words), 2)


def _context(marked: np.ndarray, shape: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Columns of each word: the word before it is marked, that behind it is, and for marked words their shape."""
    before, after = np.zeros(len(marked)), np.zeros(len(marked))
    before[1:], after[:-1] = marked[:-1], marked[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = 0.0
    after[offsets[1:][np.diff(offsets) > 0] - 1] = 0.0
    return np.column_stack([before, after, shape * marked[:, None]])


@dataclass
class Model:
    """Emission weights of the toxic state by feature and context, transition potentials, and the document curve."""

    weights: dict[str, float] = field(default_factory=dict)
    context: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -CLIP
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))  # clean-toxic, toxic-clean, toxic-toxic
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def emissions(self, words: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Emission of every word of the sequences in offsets, whose words are numbered by codes."""
        get = self.weights.get
        raw = np.fromiter((sum(get(f, 0.0) for f in features(w)) for w in words), dtype=np.float64, count=len(words))
        own = raw[codes]
        # only words beside or at a marked one have context
        near = np.flatnonzero((raw != 0)[codes]) if self.context.any() else np.zeros(0, np.int64)
        if len(near):
            row = np.searchsorted(offsets, near, side="right")
            behind, ahead = near[near + 1 < offsets[row]], near[near > offsets[row - 1]]
            own[behind + 1] += self.context[0]
            own[ahead - 1] += self.context[1]
            own[near] += _shape([words[k] for k in codes[near].tolist()]) @ self.context[2:]
        return np.clip(own + self.bias, -CLIP, CLIP)

    def score(self, marginals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each document from its words' marginals; wordless documents get the curve's floor."""
        z = _summary(marginals, offsets) @ self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _summary(marginals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    sums = np.concatenate([[0.0], np.cumsum(marginals)])[offsets]
    total = np.maximum(np.diff(sums), 0.0)
    most = np.zeros(len(n))
    some = n > 0
    if some.any():
        most[some] = np.maximum.reduceat(marginals, offsets[:-1][some])
    return np.stack([np.ones(len(n)), np.log1p(total), most, np.minimum(20.0 * total / np.maximum(n, 1), 2.0)], axis=1)


def chain(unary: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal odds pieces of every word: forward and backward state ratios, and exp(unary).

    Words are laid out step by step over the sequences, longest first, so one
    numpy step moves all sequences that are still running; the few longest
    sequences' ends run as plain loops.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    running = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")
    base = np.concatenate([[0], np.cumsum(running)])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    place = base[ragged_take(np.zeros(len(lengths), np.int64), lengths)] + np.repeat(rank, lengths)
    e = np.empty(len(unary))
    e[place] = np.exp(unary)
    a, b, c = np.exp(moves)
    forward, backward = np.empty(len(e)), np.empty(len(e))
    wide = int(np.searchsorted(-running, -8, side="right"))
    for t in range(wide):
        at = e[base[t] : base[t + 1]]
        if t == 0:
            forward[: base[1]] = at * a
        else:
            r = forward[base[t - 1] : base[t - 1] + running[t]]
            forward[base[t] : base[t + 1]] = at * (a + r * c) / (1.0 + r * b)
    tail = [(k, int(lengths[order[k]])) for k in range(int(running[wide]) if wide < longest else 0)]
    kept = {}
    for k, n in tail:
        index = base[wide:n] + k
        r = float(forward[base[wide - 1] + k]) if wide else None
        got = []
        for x in e[index].tolist():
            r = x * a if r is None else x * (a + r * c) / (1.0 + r * b)
            got.append(r)
        forward[index] = got
        g, back = 1.0, []
        for x in e[index].tolist()[::-1]:
            back.append(g)
            g = (b + c * x * g) / (1.0 + a * x * g)
        backward[index] = back[::-1]
        kept[k] = g
    for t in range(wide - 1, -1, -1):
        g = backward[base[t] : base[t + 1]]
        g[:] = 1.0
        if t + 1 < wide:
            after = running[t + 1]
            y = e[base[t + 1] : base[t + 1] + after] * backward[base[t + 1] : base[t + 1] + after]
            g[:after] = (b + c * y) / (1.0 + a * y)
        else:
            for k, x in kept.items():
                g[k] = x
    return forward[place], backward[place], e[place]


def marginals(unary: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of every word of the sequences in offsets."""
    if not len(unary):
        return np.zeros(0)
    forward, backward, _ = chain(unary, offsets, moves)
    odds = forward * backward
    return odds / (1.0 + odds)


def _marks(docs: list[np.ndarray], y: np.ndarray, forms: list[str]) -> list[str]:
    """The features that mark toxic words, by one rule for samples of every size; a small table of counts thins them out first."""
    size = 1 << 21
    cells = np.zeros(size, dtype=np.int32)
    slot = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % size
    for d in (d for d, toxic in zip(docs, y) if toxic):
        cells[np.unique([slot(f) for k in np.unique(d) for f in features(forms[k])]).astype(np.int64)] += 1
    seen: dict[str, list[int]] = {}
    for toxic in (1, 0):
        for d in (d for d, t in zip(docs, y) if t == toxic):
            for f in {f for k in np.unique(d) for f in features(forms[k])}:
                if f in seen:
                    seen[f][toxic] += 1
                elif toxic and cells[slot(f)] >= LEAST_DOCS:
                    seen[f] = [0, 1]
    clean, bad = int((y == 0).sum()), int((y == 1).sum())

    def evidence(n0: int, n1: int) -> float:
        """Likelihood-ratio statistic of the table of documents with and without the feature."""
        total, having = clean + bad, n0 + n1
        table = [(n1, bad, having), (n0, clean, having), (bad - n1, bad, total - having), (clean - n0, clean, total - having)]
        return 2 * sum(n * math.log(n * total / (row * column)) for n, row, column in table if n)

    ratio = lambda n0, n1: (n1 + 0.1) / (bad + 0.2) * (clean + 0.2) / (n0 + 0.1)
    return sorted(f for f, (n0, n1) in seen.items() if n1 >= LEAST_DOCS and ratio(n0, n1) >= LEAST_RATIO and evidence(n0, n1) >= LEAST_EVIDENCE)


@dataclass
class Sequences:
    """Training sequences: (row, col) of the words' features, context, offsets, labels and weights of the words."""

    rows: np.ndarray
    cols: np.ndarray
    size: int
    context: np.ndarray
    offsets: np.ndarray
    truth: np.ndarray
    weight: np.ndarray

    def unary(self, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
        return np.clip(bias + np.bincount(self.rows, weights=w[self.cols], minlength=len(self.truth)) + self.context @ v, -CLIP, CLIP)


def likelihood(data: Sequences, w: np.ndarray, v: np.ndarray, bias: float, moves: np.ndarray) -> tuple[float, list]:
    """The weighted log-likelihood of the labels and its gradient by w, v, bias and moves.

    With the clean state's potentials at 1, the clean path's share of the
    partition sum grows by 1 + forward * exp(moves[1]) a word.
    """
    u = data.unary(w, v, bias)
    f, g, e = chain(u, data.offsets, moves)
    a, b, c = np.exp(moves)
    n = len(u)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = np.diff(data.offsets) > 0
    first[data.offsets[:-1][some]] = True
    last[data.offsets[1:][some] - 1] = True
    before, prior = np.concatenate([[0.0], f[:-1]]), np.concatenate([[0.0], data.truth[:-1]])
    before[first], prior[first] = 0.0, 0.0
    pairs = np.stack([(1 - prior) * data.truth, prior * (1 - data.truth), prior * data.truth])
    # the pair's four states: clean-clean, clean-toxic, toxic-clean, toxic-toxic
    four = np.stack([np.ones(n), a * e * g, before * b, before * c * e * g])
    four /= four.sum(axis=0)
    miss = (data.truth - f * g / (1.0 + f * g)) * data.weight
    value = float((data.weight * (data.truth * u + moves @ pairs - np.log1p(before * b) - np.where(last, np.log1p(f), 0.0))).sum())
    inside = np.abs(u) < CLIP
    miss = np.where(inside, miss, 0.0)
    return value, [np.bincount(data.cols, weights=miss[data.rows], minlength=data.size), data.context.T @ miss, float(miss.sum()), ((pairs - four[1:]) * data.weight).sum(axis=1)]


def _climb(data: Sequences) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Parameters after STEPS steps of scaled gradient ascent with momentum."""
    w, v, bias, moves = np.zeros(data.size), np.zeros(data.context.shape[1]), -3.0, np.zeros(3)
    prior = np.concatenate([[0.0], data.truth[:-1]])
    prior[data.offsets[:-1][np.diff(data.offsets) > 0]] = 0.0
    real = np.array([((1 - prior) * data.truth).sum(), (prior * (1 - data.truth)).sum(), (prior * data.truth).sum()])
    scale = [np.bincount(data.cols, minlength=data.size) + 1.0, np.abs(data.context).sum(axis=0) + 10.0, float(data.weight.sum()) + 1.0, np.maximum(real, 1.0) + 10.0]
    speed = [np.zeros_like(w), np.zeros_like(v), 0.0, np.zeros(3)]
    for _ in range(STEPS if len(data.truth) else 0):
        _, gradient = likelihood(data, w, v, bias, moves)
        for k, value in enumerate((w, v, bias, moves)):
            speed[k] = 0.7 * speed[k] + gradient[k] / scale[k] - DECAY * value
        w, v = np.clip(w + 8 * RATE * speed[0], -4.0, 8.0), np.clip(v + RATE * speed[1], -2.0, 2.0)
        bias, moves = float(np.clip(bias + 8 * RATE * speed[2], -8.0, 0.0)), np.clip(moves + RATE * speed[3], -4, 4)
    return w, v, bias, moves


def fit(texts: list[str] | pa.Array, toxic: list[int], rate: float | None = None) -> Model:
    """A model from whole texts and their labels; rate is the toxic share outside the sample.

    Without documents of both labels the model scores every text alike, by rate.
    """
    y = np.asarray(toxic, dtype=np.int64)
    share = float(np.mean(y)) if rate is None and len(y) else (rate or 0.0)
    floor = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(y) or y.min() == y.max():
        return Model(curve=np.array([floor, 0.0, 0.0, 0.0]))
    # the words that tag() scores: only ASCII white space parts them
    words, codes, first = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    del texts
    forms = words.to_pylist()
    docs = [codes[a:b].astype(np.int32) for a, b in zip(first, first[1:])]
    names = _marks(docs, y, forms)
    give_back()
    index = {f: k for k, f in enumerate(names)}
    is_marked = {k: own for k, w in enumerate(forms) if (own := [index[f] for f in features(w) if f in index])}
    flat = np.concatenate(docs)
    n = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), n)
    del docs, codes
    known = np.zeros(len(forms), dtype=bool)
    known[list(is_marked)] = True
    hits = known[flat]
    label = hits & np.repeat(y == 1, n)
    # sequences are cut to segments; of those without a marked word one in QUIET stands for all
    within = ragged_take(np.zeros(len(n), np.int64), n) // SEGMENT
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(within) != 0)])) if len(flat) else np.zeros(0, np.int64)
    bounds = np.concatenate([starts, [len(flat)]])
    busy = np.add.reduceat(hits, starts) > 0 if len(starts) else np.zeros(0, bool)
    keep = busy | (np.arange(len(starts)) % QUIET == 0)
    lengths = np.diff(bounds)[keep]
    take = ragged_take(bounds[:-1][keep], lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    rows, cols = [], []
    for at, k in enumerate(flat[take].tolist()):
        for f in is_marked.get(k, ()):
            rows.append(at)
            cols.append(f)
    shape = _shape(forms)[flat[take]] if len(forms) else np.zeros((0, 2))
    context = _context(hits[take].astype(np.float64), shape, offsets)
    data = Sequences(np.array(rows, np.int64), np.array(cols, np.int64), len(names), context, offsets, label[take].astype(np.float64), np.repeat(np.where(busy, 1.0, float(QUIET))[keep], lengths))
    for turn in range(ROUNDS):
        w, v, bias, moves = _climb(data)
        if turn < ROUNDS - 1:
            # a word keeps its label where the field believes it, or believes no other word of its segment more
            p = marginals(data.unary(w, v, bias), offsets, moves)
            most = np.maximum.reduceat(p, offsets[:-1][lengths > 0]) if len(p) else p
            data.truth = data.truth * ((p >= 0.5) | (p >= np.repeat(most, lengths[lengths > 0])))
    model = Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, v, bias, moves)
    ends = np.concatenate([[0], np.cumsum(n)])
    x = _summary(marginals(model.emissions(forms, flat, ends), ends, moves), ends)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    curve = np.zeros(4)
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ curve, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.02, 0.02, 0.02])
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - np.array([1e-3, 0.02, 0.02, 0.02]) * curve)
        curve = curve + np.clip(step, -3, 3)
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    The sample is the first SAMPLE_TOXIC and SAMPLE_CLEAN labelled ids by a hash,
    of texts of SAMPLE_BYTES at most; the toxic share is counted over all labels
    of the fold. A document labelled twice is toxic if any of its labels says so.
    Of the sample's segments without a marked word one in QUIET is trained on,
    with the weight of QUIET; the score's curve is fitted on whole texts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    own = doc_columns(docs).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    some = own.select("doc_id").join(marks, "doc_id").distinct()
    ordered = lambda toxic, most: some.where((F.col("toxic") > 0) == F.lit(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = ordered(True, SAMPLE_TOXIC).unionByName(ordered(False, SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids; copies of a text count once
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    total = sum(counts.values())
    known: dict[str, int] = {}
    rows.reverse()
    while rows:
        text, toxic = rows.pop()[1:]
        known[text] = max(known.get(text, 0), int(toxic > 0))
    marked = list(known.values())
    # the driver holds one copy of the sample while it fits, and nothing of it afterwards
    texts = pa.array(list(known), pa.string())
    del known
    model = fit(texts, marked, (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.0)
    del texts
    give_back()
    return model


SCORES = "held_out boolean, score double, predicted int, n_toxic_words int, spans array<struct<start:int,stop:int,marginal:double>>"


def tag(docs: DataFrame, model: Model, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text and give the offending spans, beside doc_id and the columns in keep.

    spans are byte ranges in the UTF-8 text of neighbouring words whose marginal
    is 0.5 or more, with the greatest marginal. Null and wordless texts have no
    spans and the score of a text without toxic words. held_out of a null id is
    false. Rows are kept as they come, repeats included.
    """

    others = [c for c in keep if c != "text"]
    held = [1 if c == "text" else 3 + others.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=TAG_BYTES):
            words, codes, first = split_words(batch.column(1))
            unary = model.emissions(words.to_pylist(), codes, first)
            p = np.concatenate([marginals(unary[first[a] : first[b]], first[a : b + 1] - first[a], model.moves) for a, b in row_chunks(first * 6, 8 << 20)] or [np.zeros(0)])
            score = model.score(p, first)
            flagged = p >= threshold
            n = np.diff(np.concatenate([[0], np.cumsum(flagged)])[first])
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            data, offsets = text_bytes(batch.column(1))
            for row in np.flatnonzero(n).tolist():
                begin, end, _ = word_spans(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))
                own = p[first[row] : first[row + 1]]
                hit = np.flatnonzero(own >= threshold)
                for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    spans[row].append({"start": int(begin[part[0]]), "stop": int(end[part[-1]]), "marginal": float(own[part].max())})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
            columns = [batch.column(0), *(batch.column(k) for k in held), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "held_out", "score", "predicted", "n_toxic_words", "spans"])

    own = doc_columns(docs, F.coalesce(held_out(F.col("doc_id").cast("long")), F.lit(False)).alias("_held_out"), *[F.col(c).alias(f"_{c}") for c in keep if c != "text"])
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCORES])
    return own.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return tag(docs, train(docs, labels))
