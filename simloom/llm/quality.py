"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting visits one feature
after another and adds a small step of a shallow tree (at most three leaves) over
its bins to that feature's lookup table. Pairs of features that explain most of
what is left get a table over coarser bins, boosted with trees of four leaves.
A score is the sum of one table entry per feature and pair, through a logistic.

The model is fitted on a bounded sample of labelled rows (parameter
``sample_rows``) outside the held-out fold. Features come from the whole text
and from nothing else.

Results for odd input: a null or empty text has all features 0 and gets a score
like any other; labels that are null are not learned from; without labels of
both kinds the score is the share of label 1 (0.5 with none at all); an id with
both labels is learned with both; of rows that share an id the least text is
learned from; of cuts and pairs that tie the first is taken; repeated rows get
equal results; a very long text has the features of the whole; an empty table
gives no rows. Extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.shared import map_arrow, slices, text_buffer
from simloom.llm.words import NOT_BLANK, hash_spans, word_spans

FEATURES = (
    "log_bytes",
    "log_words",
    "log_lines",
    "upper",
    "lower",
    "digit",
    "symbol",
    "beyond_ascii",
    "blank",
    "sentence_marks",
    "bars",
    "word_bytes",
    "word_bytes_spread",
    "distinct_words",
    "top_word",
    "same_as_before",
    "loud_words",
    "marked_words",
    "long_words",
    "distinct_lines",
    "line_words",
    "brackets",
)
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, STEP, LEAST_ROWS = 120, 40, 0.1, 20

_KIND = np.zeros((256, 8), np.float64)
for _k, _chars in enumerate(
    (range(65, 91), range(97, 123), range(48, 58), b"!\"#$%&'*+-/:;<=>?@\\^_`~", range(128, 256), b" \t\n\r\x0b\x0c", b".,;:?", b"|")
):
    _KIND[list(_chars), _k] = 1
_BRACKET = np.isin(np.arange(256), list(b"()[]{}<>"))


def text_features(column: pa.Array) -> np.ndarray:
    """A row of features per text, from all its bytes and words."""
    data, offsets = text_buffer(column)
    n = len(column)
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    counts = np.zeros((n, 9))
    breaks = np.zeros(n)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        histogram = np.bincount(data[a:b], minlength=256)
        counts[i, :8] = histogram @ _KIND
        counts[i, 8] = histogram @ _BRACKET
        breaks[i] = histogram[10]
    starts, ends = word_spans(data, offsets, NOT_BLANK)
    hashes = hash_spans(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    length = (ends - starts).astype(np.float64)
    lead, last = data[starts], data[ends - 1]
    loud = (lead >= 65) & (lead <= 90) & (length > 1)
    loud[loud] &= (data[starts[loud] + 1] >= 65) & (data[starts[loud] + 1] <= 90)
    marked = _KIND[last, 3] > 0
    before = np.zeros(len(hashes), bool)
    before[1:] = hashes[1:] == hashes[:-1]
    line_starts, line_ends = word_spans(data, offsets, _NOT_BREAK)
    lines = hash_spans(data, line_starts, line_ends)
    line_first = np.searchsorted(line_starts, offsets)
    out = np.zeros((n, len(FEATURES)))
    for i, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_first[:-1].tolist(), line_first[1:].tolist())):
        w = b - a
        if w == 0:
            continue
        _, times = np.unique(hashes[a:b], return_counts=True)
        here = length[a:b]
        out[i, 1] = np.log1p(w)
        out[i, 11:19] = (
            here.mean(), here.std(), len(times) / w, times.max() / w, before[a + 1 : b].sum() / w,
            loud[a:b].sum() / w, marked[a:b].sum() / w, (here > 20).sum() / w,
        )
        out[i, 19] = len(np.unique(lines[c:d])) / max(d - c, 1)
        out[i, 20] = w / max(d - c, 1)
    out[:, 0] = np.log1p(size)
    out[:, 2] = np.log1p(breaks)
    out[:, 3:11] = counts[:, :8] / some[:, None]
    out[:, 21] = counts[:, 8] / some
    return out


_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False

# --- the model -------------------------------------------------------------------


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]  # inner borders of each feature's bins
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # from fine to coarse bin, per feature
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.tables and len(x):
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                total += t[b[:, k]]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps per bin of the best tree with up to three leaves over ordered bins."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)

    def value(a: int, b: int) -> float:
        """Newton step of the bins a to b - 1."""
        gs = cg[b - 1] - (cg[a - 1] if a else 0)
        hs = ch[b - 1] - (ch[a - 1] if a else 0)
        return gs / (hs + 1.0)

    def split(a: int, b: int) -> tuple[float, int]:
        """Best gain within the bins a to b - 1, and where the right leaf begins."""
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, -1
        g0, h0, n0 = (c[a - 1] if a else 0 for c in (cg, ch, cn))
        gl, hl, nl = cg[at - 1] - g0, ch[at - 1] - h0, cn[at - 1] - n0
        ga, ha, na = cg[b - 1] - g0, ch[b - 1] - h0, cn[b - 1] - n0
        gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
        gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
        best = int(gain.argmax())
        return float(gain[best]), int(at[best])

    m = len(g)
    gain, at = split(0, m)
    if gain <= 0:
        return np.zeros(m)
    cuts = [0, at, m]
    (gl, al), (gr, ar) = split(0, at), split(at, m)
    if max(gl, gr) > 0:
        cuts = sorted({*cuts, al if gl >= gr else ar})
    out = np.empty(m)
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts both axes once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ga, ha = cg[-1, -1], ch[-1, -1]
    parts = []
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    row_g, row_h = cg[:-1, -1:], ch[:-1, -1:]
    col_g, col_h = cg[-1:, :-1], ch[-1:, :-1]
    for x, y in ((a, b), (row_g - a, row_h - b), (col_g - a, col_h - b), (ga - row_g - col_g + a, ha - row_h - col_h + b)):
        parts.append((x, y))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [x[i, j] / (y[i, j] + 1) for x, y in parts]
    step = np.empty_like(g)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - ga**2 / (ha + 1)), step


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the logistic loss: first single features, then pairs."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return AdditiveModel(float(np.log(share / (1 - share))), [], [], [], [], [])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], [], [], [])
    b = model.bins(x)
    rows = [np.bincount(c, minlength=len(t)) for c, t in zip(b.T, model.tables)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = STEP * _leaves(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)), rows[k])
            t += step
            total += step[b[:, k]]
    model.coarse = [np.arange(len(t)) * PAIR_BINS // len(t) if len(t) > PAIR_BINS else np.arange(len(t)) for t in model.tables]
    c = np.stack([m[col] for m, col in zip(model.coarse, b.T)], 1)
    width = [int(m[-1]) + 1 for m in model.coarse]

    def table(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * width[j] + c[:, j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    found = [
        (_quadrants(table(i, j, g), table(i, j, h))[0], i, j)
        for i in range(len(width)) for j in range(i) if width[i] > 1 and width[j] > 1
    ]
    for _, i, j in sorted(found, reverse=True)[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((width[i], width[j])))
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = STEP * _quadrants(table(i, j, g), table(i, j, h))[1]
            t += step
            total += step[c[:, i], c[:, j]]
    return model


# --- the operator ------------------------------------------------------------------


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def with_features(docs: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns and ``features``, an array of doubles, from ``text``."""
    rows = docs.select("text", *kept)
    schema = rows.drop("text").schema.add("features", T.ArrayType(T.DoubleType()))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            values = pa.array(list(text_features(part.column(0))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], values], names=[*kept, "features"])

    return map_arrow(rows, features, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on at most ``sample_rows`` labelled ids, those with the least hash."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id") != 2))
        .distinct()
    )
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has a fixed bound, so it may be sent to every task.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = with_features(sample, "doc_id", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.features))
    x = np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_model(x, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            s = shared.value.scores(text_features(part.column(2)))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, apply, "doc_id long, held_out boolean, score double, predicted int")
