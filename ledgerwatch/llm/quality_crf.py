"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line of a text is a place of the chain, labelled good or bad. Its features are measures of the line and of
its neighbours, each cut into bins at quantiles. Lines of a training document carry the document's label. The marginals
of forward-backward are averaged by length in bytes into the document's quality, and a logistic curve fitted on the training
documents turns that into a probability.

The model is fitted on the driver from features of at most ``sample`` labelled documents, chosen by hash of their id;
it is small, and every text of the table is scored with it, whole.

Defined results: null and empty texts, and texts of white space, have no line and get the rate of label 1 among such
training documents, or 0 if there are none. A null id counts as '' in the split. Without any label every score is 0.5.
Nothing but the text enters a score; order and repetition of rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column, free_name
from .text import SPACE, slices, sums_by, words_in

BINS = 8
MEASURES = 20


def byte_classes() -> list[np.ndarray]:
    code = np.arange(256)
    char = lambda s: np.isin(code, list(s.encode()))
    return [(code >= 65) & (code <= 90), (code >= 97) & (code <= 122), (code >= 48) & (code <= 57), code >= 128,
            char(".,;:"), char("!?"), char("|"), char("#$%&*+=<>@^_~\\/{}[]"), char("'\"()-")]


CLASSES = byte_classes()


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


@dataclass
class Lines:
    """Measures (lines x MEASURES), weights in bytes, and each text's first line."""

    measures: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    words = words_in(texts)
    n_texts = len(words.first) - 1
    # Line ends are white space, so they are found in the texts and told to the words behind them.
    line = line_numbers(texts, words.n)
    text = words.text_of()
    new = np.ones(words.n, bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    bounds = np.append(begin, words.n)
    n = np.diff(bounds)
    first = np.searchsorted(begin, words.first)
    if not len(begin):
        return Lines(np.zeros((0, MEASURES)), np.zeros(0), np.zeros(n_texts + 1, np.int64))
    start = words.start[begin]
    stop = np.append(start[1:], len(words.flat))
    size = (stop - start).astype(float)
    counts = [np.add.reduceat(c[words.flat], start, dtype=np.int64) for c in CLASSES]
    sums = words.byte_sums()
    h = words.span_hashes(sums, words.start, words.end)
    of_line = np.repeat(np.arange(len(n)), n)
    same1, same2 = np.zeros(words.n, np.int64), np.zeros(words.n, np.int64)
    same1[1:] = (h[1:] == h[:-1]) & (of_line[1:] == of_line[:-1])
    same2[2:] = (h[2:] == h[:-2]) & (of_line[2:] == of_line[:-2])
    order = np.lexsort((h, of_line))
    fresh = np.ones(words.n, np.int64)
    fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (of_line[order[1:]] != of_line[order[:-1]])
    per_line = lambda values: sums_by(values, bounds)
    length = words.end - words.start
    odd_end = np.isin(words.flat[words.end - 1], np.frombuffer(b"#$%&*+=<>@^_~|!/", np.uint8)).astype(np.int64)
    alone = ((length == 1) & ~CLASSES[1][words.flat[words.start]]).astype(np.int64)
    whole = words.span_hashes(sums, start, stop - 1)
    of_text = text[begin]
    order = np.lexsort((whole, of_text))
    twin = np.zeros(len(n))
    equal = (whole[order[1:]] == whole[order[:-1]]) & (of_text[order[1:]] == of_text[order[:-1]])
    twin[order[1:]] += equal
    twin[order[:-1]] += equal
    lines_in = np.diff(first)
    measures = np.stack([
        np.log1p(size), np.log1p(n), size / n, shares(per_line(same1), n - 1), shares(per_line(same2), n - 2),
        shares(np.add.reduceat(fresh, begin), n), shares(per_line(odd_end), n), shares(per_line(alone), n),
        shares(per_line((length > 14).astype(np.int64)), n), shares(per_line((length <= 3).astype(np.int64)), n), np.minimum(twin, 2),
        *[c / size for c in counts]], axis=1)
    measures = measures[:, :MEASURES]
    assert measures.shape[1] == MEASURES and len(lines_in) == n_texts
    return Lines(measures, size, first)


def line_numbers(texts: pa.Array, n_words: int) -> np.ndarray:
    """Line ends before each word, counted through all texts."""
    import pyarrow.compute as pc

    from .text import buffer_of, whole

    empty, end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    flat, _ = buffer_of(pc.binary_join_element_wise(whole(texts), empty, end))
    space = SPACE[flat]
    begin = ~space
    begin[1:] &= space[:-1]
    at = np.flatnonzero(begin)
    assert len(at) == n_words
    return np.searchsorted(np.flatnonzero(flat == 10), at)


class Steps:
    """The chains of some texts, taken place by place: the lines at place t of all texts that have one."""

    def __init__(self, first: np.ndarray):
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        self.lines = [begin[:a] + t for t, a in enumerate(active.tolist())]
        self.n = int(first[-1])

    def forward_backward(self, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good given what comes before and at a line, and of what comes after."""
        a, b = e.copy(), np.zeros(self.n)
        for before, at in zip(self.lines, self.lines[1:]):
            x = a[before[: len(at)]]
            a[at] += np.logaddexp(x + w[3], w[1]) - np.logaddexp(x + w[2], w[0])
        for before, at in zip(self.lines[-2::-1], self.lines[:0:-1]):
            y = e[at] + b[at]
            b[before[: len(at)]] = np.logaddexp(w[3] + y, w[2]) - np.logaddexp(w[1] + y, w[0])
        return a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Crf:
    """cuts: bin limits per measure. emission: weights of the bins of a line, the one before and the one behind.
    w: transition weights bad-bad, bad-good, good-bad, good-good. curve: slope and offset of the logistic curve."""

    cuts: np.ndarray
    emission: np.ndarray
    w: np.ndarray
    curve: np.ndarray
    blank: float

    def bins(self, lines: Lines) -> np.ndarray:
        """Places in the weights: own bins, then those of the neighbours; the last weight of a block is for none."""
        own = np.stack([np.searchsorted(c, m, side="right") for c, m in zip(self.cuts, lines.measures.T)], axis=1)
        own += np.arange(MEASURES) * BINS
        width = MEASURES * BINS + 1
        none = np.full_like(own, width - 1)
        before, behind = none.copy(), none.copy()
        first, last = lines.first[:-1], lines.first[1:] - 1
        inner = np.ones(len(own), bool)
        inner[first[first <= last]] = False
        at = np.flatnonzero(inner)
        before[at] = own[at - 1]
        behind[at - 1] = own[at]
        return np.concatenate([own, before + width, behind + 2 * width], axis=1)

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the marginals of every text; nan without lines."""
        e = self.emission[self.bins(lines)].sum(axis=1) if len(lines.weight) else np.zeros(0)
        a, b = Steps(lines.first).forward_backward(e, self.w)
        good = sigmoid(a + b) * lines.weight
        total = np.concatenate([[0.0], np.cumsum(lines.weight)])[lines.first]
        mass = np.concatenate([[0.0], np.cumsum(good)])[lines.first]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.diff(mass) / np.diff(total)

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw = self.raw(lines_of(texts))
        odds = np.clip(np.nan_to_num(raw, nan=0.5), 1e-6, 1 - 1e-6)
        out = sigmoid(self.curve[0] * np.log(odds / (1 - odds)) + self.curve[1])
        return np.where(np.isnan(raw), self.blank, out)


def adam(weights: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        g = gradient(weights)
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        step = rate * (1 - 0.9 * t / rounds)
        weights = weights - step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def fit(lines: Lines, label: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Crf:
    size = np.diff(lines.first)
    blank = float(label[size == 0].mean()) if (size == 0).any() else 0.0
    quantiles = np.arange(1, BINS) / BINS
    cuts = np.quantile(lines.measures, quantiles, axis=0).T if len(lines.weight) else np.zeros((MEASURES, BINS - 1))
    model = Crf(cuts, np.zeros(3 * (MEASURES * BINS + 1)), np.zeros(4), np.array([1.0, 0.0]), blank)
    if not len(lines.weight):
        return model
    bins, steps = model.bins(lines), Steps(lines.first)
    y = np.repeat(label, size).astype(float)
    pairs = [(before[: len(at)], at) for before, at in zip(steps.lines, steps.lines[1:])]
    prev = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.int64)
    here = np.concatenate([h for _, h in pairs]) if pairs else np.zeros(0, np.int64)
    seen = np.bincount((2 * y[prev] + y[here]).astype(int), minlength=4)
    n, k = len(y), len(model.emission)

    def gradient(weights: np.ndarray) -> np.ndarray:
        emission, w = weights[:k], weights[k:]
        e = emission[bins].sum(axis=1)
        a, b = steps.forward_backward(e, w)
        rest = sigmoid(a + b) - y
        g = np.bincount(bins.ravel(), weights=np.repeat(rest, bins.shape[1]), minlength=k)
        x, z = a[prev], (e + b)[here]
        logit = np.stack([w[0] + 0 * x, w[1] + z, w[2] + x, w[3] + x + z])
        p = np.exp(logit - logit.max(axis=0))
        p = (p / p.sum(axis=0)).sum(axis=1)
        return np.concatenate([g, p - seen]) / n + penalty * weights

    weights = adam(np.concatenate([model.emission, model.w]), gradient, rounds, 0.05)
    model.emission, model.w = weights[:k], weights[k:]
    raw = model.raw(lines)
    some = ~np.isnan(raw)
    odds = np.clip(raw[some], 1e-6, 1 - 1e-6)
    x, target = np.log(odds / (1 - odds)), label[some]

    def slope(c: np.ndarray) -> np.ndarray:
        rest = sigmoid(c[0] * x + c[1]) - target
        return np.array([(rest * x).mean(), rest.mean()]) + 1e-4 * c

    model.curve = adam(np.array([1.0, 0.0]), slope, 400, 0.05)
    model.curve[0] = max(model.curve[0], 1e-3)
    return model


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = 6000, key: str = "doc_id") -> Crf | None:
    """A model from at most ``sample`` labelled documents outside the held-out fifth; None without labels.

    Of a document with several labels the lowest counts. The chosen ids are few, so they go to every executor."""
    known = labels.where(F.col("quality").isNotNull() & column(key).isNotNull() & ~held_out(column(key)))
    known = known.groupBy(column(key).alias("_labelled")).agg((F.min("quality") > 0).cast("int").alias("_good"))
    known = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    rows = docs.select(column(key).alias("_id"), "text").join(F.broadcast(known), F.col("_id") == F.col("_labelled"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = lines_of(part.column("text"))
                cuts = list(zip(lines.first.tolist(), lines.first[1:].tolist()))
                yield pa.record_batch({
                    "id": part.column("_id").cast(pa.int64()), "good": part.column("_good"),
                    "measures": pa.array([lines.measures[a:b].astype(np.float32).tobytes() for a, b in cuts], pa.binary()),
                    "weight": pa.array([lines.weight[a:b].tobytes() for a, b in cuts], pa.binary())})

    found = rows.select("_id", "_good", "text").mapInArrow(measured, "id bigint, good int, measures binary, weight binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.id, bytes(r.measures)))
    weight = [np.frombuffer(r.weight, float) for r in found]
    lines = Lines(
        np.concatenate([np.frombuffer(r.measures, np.float32) for r in found]).reshape(-1, MEASURES).astype(float),
        np.concatenate(weight), np.concatenate([[0], np.cumsum([len(w) for w in weight])]).astype(np.int64))
    return fit(lines, np.array([r.good for r in found], float))


def scored(docs: DataFrame, model: Crf | None, score: str, least: float | None = None) -> DataFrame:
    """``docs`` with a score column, or only its rows of at least ``least`` without it; one pass, no shuffle."""
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = model.scores(part.column("text")) if model else np.full(part.num_rows, 0.5)
                if least is None:
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in fields] + [pa.array(values)], names=[*fields, score])
                else:
                    yield part.filter(pa.array(values >= least))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + (f", `{score}` double" if least is None else ""))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", least: float = 0.3, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``least``) of every row of ``docs``."""
    found = scored(docs.select(key, "text"), trained(docs, labels, sample, key), "score")
    return found.select(key, held_out(column(key)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", least: float = 0.3, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``; same columns."""
    return scored(docs, trained(docs, labels, sample, key), free_name(docs, "score"), least)
