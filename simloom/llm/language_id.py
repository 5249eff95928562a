"""Language ID by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over windows of fixed
length, the maximum of each filter over a window (at least 0) goes into a
softmax over the languages. Training is plain gradient descent with momentum;
only the position of each maximum carries a gradient. A text is cut into windows
that overlap by the widest filter, and the mean of the windows' probabilities,
weighted by their length, is the text's.

The network is fitted on a bounded sample of labelled texts (parameter
``per_language`` texts of each language on average and at most twice as many in
all, ``windows_per_text`` windows of each); prediction covers every byte of every
text.

Results for odd input: a null text, or one without a letter, is ``und`` with
score 0; rows with a null language are not learned from; with no labelled row
at all every text is ``und``; of languages that tie the first by name is taken;
repeated rows get equal results and are learned from once; a very long text is
cut and scored in steps, as one text; an empty table gives no rows. Extra
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import map_arrow, release_memory, slices, text_buffer

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
UNKNOWN = "und"
PER_LANGUAGE, WINDOWS_PER_TEXT = 400, 5
EPOCHS, BATCH, RATE, MOMENTUM, SEED = 5, 64, 0.05, 0.9, 17
#: Windows that one numpy step predicts, and that are cut out at once.
STEP, CUT = 256, 1 << 14
#: How far a score must lie above chance, on the way from 1/L to 1, for a text to be kept.
MARGIN = 1 / 15


@dataclass
class Network:
    """Weights: embedding (256, d), a filter bank (w * d, f) per width, softmax."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(
            languages,
            r.standard_normal((256, EMBEDDING)).astype(np.float32),
            [draw(w * EMBEDDING, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(FILTERS * len(WIDTHS), len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights, self.bias]

    def _pool(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (n, filters) and their places per width."""
        n, length = windows.shape
        x = self.embedding[windows].reshape(n, length * EMBEDDING)
        tops, places = [], []
        for w, bank, bias in zip(WIDTHS, self.filters, self.biases):
            spans = np.lib.stride_tricks.sliding_window_view(x, w * EMBEDDING, axis=1)[:, ::EMBEDDING]
            y = spans.reshape(-1, w * EMBEDDING) @ bank
            y = y.reshape(n, length - w + 1, FILTERS)
            at = y.argmax(1)
            places.append(at)
            tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0] + bias)
        return np.maximum(np.concatenate(tops, 1), 0), places

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights + self.bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), STEP):
            part = windows[at : at + STEP]
            n, length = part.shape
            x = self.embedding[part].reshape(n, length * EMBEDDING)
            tops = []
            for w, bank, bias in zip(WIDTHS, self.filters, self.biases):
                spans = np.lib.stride_tricks.sliding_window_view(x, w * EMBEDDING, axis=1)[:, ::EMBEDDING]
                y = (spans.reshape(-1, w * EMBEDDING) @ bank).reshape(n, length - w + 1, FILTERS)
                tops.append(y.max(1) + bias)
            out.append(self._softmax(np.maximum(np.concatenate(tops, 1), 0)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        pooled, places = self._pool(windows)
        n = len(windows)
        dz = self._softmax(pooled)
        dz[np.arange(n), labels] -= 1
        dz /= n
        d_weights, d_bias = pooled.T @ dz, dz.sum(0)
        d_pooled = (dz @ self.weights.T) * (pooled > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for k, (w, bank, at) in enumerate(zip(WIDTHS, self.filters, places)):
            d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS]
            d_biases.append(d.sum(0))
            d_bank = np.empty_like(bank)
            for j in range(w):
                seen = windows[np.arange(n)[:, None], at + j]  # (n, filters): the byte under place j
                rows = bank[j * EMBEDDING : (j + 1) * EMBEDDING]
                d_bank[j * EMBEDDING : (j + 1) * EMBEDDING] = np.einsum("nf,nfe->ef", d, self.embedding[seen])
                np.add.at(d_embedding, seen.ravel(), (d[:, :, None] * rows.T[None]).reshape(-1, EMBEDDING))
            d_filters.append(d_bank)
        return [d_embedding, *d_filters, *d_biases, d_weights, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fits a network; languages weigh alike, whatever their number of windows."""
    net = Network.fresh(languages, seed)
    speed = [np.zeros_like(p) for p in net.parameters()]
    r = np.random.default_rng(seed)
    counts = np.bincount(labels, minlength=len(languages))
    chance = 1 / np.maximum(counts, 1)[labels]
    chance /= chance.sum()
    steps = -(-len(labels) // BATCH)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for _ in range(steps):
            pick = r.choice(len(labels), BATCH, p=chance)
            for p, v, g in zip(net.parameters(), speed, net.gradients(windows[pick], labels[pick])):
                v *= MOMENTUM
                v -= rate * g
                p += v
    return net


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all windows of all texts, and the text of each."""
    stride = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // stride)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + nth * stride
    return start, np.minimum(start + WINDOW, offsets[text + 1]), text


def cut_out(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bytes of windows, filled up with blanks."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0x20).astype(np.uint8)


def has_letter(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False)


def predict(net: Network, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    data, offsets = text_buffer(column)
    n = len(column)
    sums = np.zeros((n, len(net.languages)))
    if net.languages and len(data):
        start, stop, text = cut(offsets)
        for k in range(0, len(text), CUT):
            a, b, own = start[k : k + CUT], stop[k : k + CUT], text[k : k + CUT]
            chances = net.probabilities(cut_out(data, a, b)) * (b - a)[:, None]
            begins = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[begins]] += np.add.reduceat(chances, begins, axis=0)
    total = sums.sum(1)
    ok = has_letter(column).to_numpy(zero_copy_only=False) & (total > 0)
    best = sums.argmax(1) if net.languages else np.zeros(n, int)
    score = np.where(ok, sums.max(1, initial=0) / np.where(total > 0, total, 1), 0.0)
    return [net.languages[b] if o else UNKNOWN for b, o in zip(best, ok)], np.clip(score, 0, 1)


# --- the operator ------------------------------------------------------------------


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, windows_per_text: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Evenly spaced windows of some labelled texts outside the held-out fold.

    Distinct texts are chosen by a hash of id and text, with a chance that gives
    about ``per_language`` of each language, and at most twice as many in all; the
    driver gets the windows alone.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        (fold("doc_id") != 2) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    languages = sorted(r.lang for r in counts)
    million = 1_000_000
    chances = {r.lang: min(million, million * per_language // r.n + 1) for r in counts}
    chance = F.from_json(F.lit(json.dumps(chances)), "map<string,int>")
    lot = F.xxhash64(F.lit("language"), "doc_id", "text")
    chosen = known.where(F.pmod(lot, F.lit(million)) < F.element_at(chance, F.col("lang"))).select("lang", "text", lot.alias("lot")).distinct()
    chosen = chosen.orderBy("lot", "lang", "text").limit(2 * len(languages) * per_language).select("lang", "text")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, offsets = text_buffer(part.column(1))
            start, stop, text = cut(offsets)
            borders = np.searchsorted(text, np.arange(part.num_rows + 1))
            keep = np.unique(
                np.concatenate([np.linspace(a, b - 1, min(windows_per_text, b - a)).astype(int) for a, b in zip(borders, borders[1:]) if b > a] or [np.zeros(0, int)])
            )
            lang = part.column(0).take(pa.array(text[keep]))
            yield pa.RecordBatch.from_arrays([lang, pa.array([w.tobytes() for w in cut_out(data, start[keep], stop[keep])], pa.binary())], names=["lang", "window"])

    rows = sorted(map_arrow(chosen, windows, "lang string, window binary").collect())
    number = {x: i for i, x in enumerate(languages)}
    return (
        np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW),
        np.array([number[r.lang] for r in rows], np.int64),
        languages,
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, windows_per_text: int = WINDOWS_PER_TEXT) -> Network:
    windows, labels, languages = sample_windows(docs, id_col, text_col, lang_col, per_language, windows_per_text)
    return train(windows, labels, languages) if len(labels) else Network.fresh([])


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, language and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kilobytes, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            lang, score = predict(shared.value, part.column(2))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, label, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network, margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """The documents with a known language, as they were.

    What has no letter goes, and what scores less than ``margin`` above chance
    (0.3 with four languages). Where no language could be learned all texts with a
    letter stay. The text alone decides, so the rows never leave their order or place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema
    at = docs.columns.index(text_col)
    least = (1 + margin * (len(net.languages) - 1)) / max(1, len(net.languages))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            if not net.languages:
                yield part.filter(has_letter(part.column(at)))
                continue
            lang, score = predict(shared.value, part.column(at))
            yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score.tolist())], pa.bool_()))
        release_memory()

    return map_arrow(docs, keep, schema)
