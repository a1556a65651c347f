"""Document quality from two views that teach each other.

One classifier sees only the text, the other only the page's metadata. Both start from a
bounded sample of the labelled documents. In each round Spark scores every document of the
corpus with both, and each view passes all documents it is sure of to the other one. What
the other view learns from them is summed over the executors: the gradient of its loss and
a bound on its curvature, one number each per feature, so a round costs one pass and brings
the same few thousand numbers to the driver whatever the corpus holds. At the end each view
is calibrated on labelled rows kept apart, and a logistic combination of both calibrated
views, fitted on rows kept apart from both, scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches
from terrajobs.llm.quality_rules import _measure

BUCKETS = 1024  # hashed words
META = 160  # hashed metadata values
SAMPLE = 1500  # labelled documents of each class at most
ROUNDS = 4
SURE = 0.95
PSEUDO = 0.5  # weight of all pseudo-labels against all labels


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(style measures of each row, word buckets, first word of each row)."""
    start, end, first = B.words(data, offsets)
    bucket = (B.span_hashes(B.LOWER[data], start, end) & np.uint64(BUCKETS - 1)).astype(np.int64)
    n_words, chars, symbols, dup, repeat, n_lines, upper, digits, bangs = (x.astype(np.float64) for x in _measure(data, offsets))
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    style = np.stack([np.log1p(n_words), chars / w, symbols / w, dup / np.maximum(n_lines, 1), repeat / w, n_lines / w, upper / c, digits / c, bangs / w, n_words < 20], axis=1)
    return style, bucket, first


def meta_buckets(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three hashed values per row: source, language, and the size's power of two."""
    import zlib

    out = np.empty((len(source), 3), np.int64)
    for i, values in enumerate(zip(source, lang, n_chars, strict=True)):
        size = None if values[2] is None else int(values[2]).bit_length()
        for k, v in enumerate((values[0], values[1], size)):
            out[i, k] = zlib.crc32(f"{k}:{v}".encode()) % META
    return out


@dataclass
class Lesson:
    """What pseudo-labels teach a view: a quadratic that lies above their loss and touches it
    at the weights ``at``, with this gradient and, per feature, this bound on the curvature."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, lesson: Lesson | None = None, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (weight * (_sigmoid(x @ w) - y)) / weight.sum() + l2 * w
        if lesson is not None:
            g = g + PSEUDO * (lesson.gradient + lesson.curvature * (w - lesson.at))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    share = np.clip(y.mean(), 0.02, 0.98)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


@dataclass
class CoTrained:
    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray  # style weights, bias, bucket weights
    meta: np.ndarray
    platt: np.ndarray  # (2, 2): slope and offset of each view
    mix: np.ndarray  # offset, weight of the text view, of the metadata view
    log: list = field(default_factory=list)

    def views(self, style: np.ndarray, words: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits; ``words`` is the bucket part's contribution to the text view."""
        k = len(self.mean)
        text = ((style - self.mean) / self.scale) @ self.text[:k] + self.text[k] + words
        other = self.meta[meta].sum(axis=1) + self.meta[-1]
        return self.platt[0, 0] * text + self.platt[0, 1], self.platt[1, 0] * other + self.platt[1, 1]

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.mix[0] + self.mix[1] * text + self.mix[2] * meta, -30, 30)))


def _text_view(style: np.ndarray, bucket: np.ndarray, first: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """One row of features per text: style, a constant, and ten times the share of each bucket."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    bags = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(np.diff(first), 1)[:, None]
    return np.concatenate([(style - mean) / scale, np.ones((n, 1)), bags * 10], axis=1)


def _meta_view(meta: np.ndarray) -> np.ndarray:
    hot = np.zeros((len(meta), META + 1))
    np.add.at(hot, (np.arange(len(meta))[:, None], meta), 1)
    hot[:, -1] = 1
    return hot


def exchange(documents: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]) -> tuple[list[Lesson | None], list[tuple[int, int, int]]]:
    """One round over all documents: each view's lesson from the other's sure labels, and
    the log (teacher, label, documents). A view gets no lesson unless its teacher is sure of
    documents of both labels, which then weigh the same.

    The curvature bound is a quarter of |x_j| times the sum of |x|, so steps cannot overshoot
    however the features go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(k, y): [0, np.zeros(len(weights[k])), np.zeros(len(weights[k]))] for k in (0, 1) for y in (0, 1)}
        for batch in batches:
            meta = meta_buckets(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            for a, b, data, offsets in B.slices(batch.column("text")):
                views = [_text_view(*text_features(data, offsets), mean, scale), _meta_view(meta[a:b])]
                p = [_sigmoid(x @ w) for x, w in zip(views, weights, strict=True)]
                for k in (0, 1):
                    teacher = p[1 - k]
                    for y, sure in ((0, teacher <= 1 - SURE), (1, teacher >= SURE)):
                        x = views[k][sure]
                        size = np.abs(x)
                        sums = total[k, y]
                        sums[0] += len(x)
                        sums[1] += x.T @ (p[k][sure] - y)
                        sums[2] += size.T @ size.sum(axis=1) / 4
        for (k, y), (n, g, h) in total.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(np.full(len(g), y)), pa.array(np.arange(len(g))), pa.array(np.full(len(g), n)), pa.array(g), pa.array(h)], names=["view", "label", "place", "n", "g", "h"])

    parts = small_batches(documents).mapInArrow(released(run), "view long, label long, place long, n long, g double, h double")
    sums = parts.groupBy("view", "label", "place").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    lessons, log = [], []
    for k in (0, 1):
        own = [sums[(sums["view"] == k) & (sums["label"] == y)].sort_values("place") for y in (0, 1)]
        log += [(1 - k, y, int(rows["n"].iloc[0]) if len(rows) else 0) for y, rows in enumerate(own)]
        if min(map(len, own)):
            g, h = (sum(0.5 * (rows[c] / rows["n"]).to_numpy() for rows in own) for c in ("g", "h"))
            lessons.append(Lesson(weights[k], g, h))
        else:
            lessons.append(None)
    return lessons, log


def co_train(style: np.ndarray, bags: np.ndarray, meta: np.ndarray, y: np.ndarray, documents: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Learn from labelled rows and, over the rounds, from all ``documents``. Of six labelled
    rows one calibrates the views and another one their combination; neither is learned from."""
    mean, scale = style.mean(axis=0), style.std(axis=0) + 1e-6
    views = [np.concatenate([(style - mean) / scale, np.ones((len(style), 1)), bags], axis=1), _meta_view(meta)]
    place = np.arange(len(y)) % 6
    base = np.flatnonzero(place > 1)
    if not 0 < y[base].mean() < 1:
        base = np.arange(len(y))
    lessons: list[Lesson | None] = [None, None]
    log = []
    for turn in range(rounds + 1):
        weights = [_logistic(x[base], y[base].astype(float), _balanced(y[base]), 1e-3, lesson) for x, lesson in zip(views, lessons, strict=True)]
        if turn < rounds:
            lessons, found = exchange(documents, mean, scale, weights)
            log += [(turn, *row) for row in found]

    def apart(k: int) -> np.ndarray:
        rows = np.flatnonzero(place == k)
        return rows if len(rows) and 0 < y[rows].mean() < 1 else base

    calibrates, mixes = apart(0), apart(1)
    platt = np.empty((2, 2))
    for k in (0, 1):
        z = np.clip(views[k][calibrates] @ weights[k], -30, 30)
        platt[k] = _logistic(np.stack([z, np.ones(len(z))], axis=1), y[calibrates].astype(float), np.ones(len(z)), 1e-3)
    logits = [platt[k, 0] * np.clip(views[k][mixes] @ weights[k], -30, 30) + platt[k, 1] for k in (0, 1)]
    mix = _logistic(np.stack([np.ones(len(mixes)), *logits], axis=1), y[mixes].astype(float), np.ones(len(mixes)), 1e-3)
    return CoTrained(mean, scale, weights[0], weights[1], platt, np.array([mix[0], max(mix[1], 0), max(mix[2], 0)]), log)


def sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """At most ``per_class`` documents of each label, spread by a hash. Of several labels of
    one id the higher counts, of several rows of one id any one does; null ids have no label."""
    key = F.xxhash64("doc_id", F.lit("sample"))
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    rows = documents.select("doc_id").join(known, "doc_id")
    chosen = rows.groupBy("y", F.pmod(key, F.lit(per_class)).alias("slot")).agg(F.min(F.struct(key.alias("key"), "doc_id")).alias("r")).select("y", F.col("r.doc_id").alias("doc_id"))
    return documents.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


_COLUMNS = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.col(c).cast(kind).alias(c) for c, kind in _COLUMNS.items()))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> CoTrained | None:
    """Co-train on at most ``per_class`` labelled documents of each label and on all
    documents; None without labelled documents of both classes. Labels of the sample alone
    are read: in the exchange every document takes part, by what the other view says of it."""
    documents = _columns(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            styles, bags = [], []
            for _, _, data, offsets in B.slices(batch.column("text")):
                style, bucket, first = text_features(data, offsets)
                styles += style.tolist()
                for r in range(len(first) - 1):
                    n = max(int(first[r + 1] - first[r]), 1)
                    bags.append((np.bincount(bucket[first[r] : first[r + 1]], minlength=BUCKETS) / n).astype(np.float32).tolist())
            meta = meta_buckets(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(styles, pa.list_(pa.float64())), pa.array(bags, pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int64()))],
                names=["doc_id", "y", "style", "bag", "meta"],
            )

    rows = sample(documents, labels, per_class).select(*_COLUMNS, "y").mapInArrow(run, "doc_id long, y int, style array<double>, bag array<float>, meta array<long>").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.int64)
    if not {0, 1} <= set(y.tolist()):
        return None
    return co_train(np.stack(rows["style"].to_list()), np.stack(rows["bag"].to_list()).astype(np.float64) * 10, np.stack(rows["meta"].to_list()), y, documents)


def score(documents: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for every row: calibrated views and their mix.

    Null texts count as empty, null metadata is a value of its own. Without a model all
    probabilities are 0.5. One row per input row; columns beyond the five named by the
    table's contract are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            out = np.full((3, n), 0.5)
            if model is not None:
                meta = meta_buckets(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
                weights = model.text[len(model.mean) + 1 :] * 10
                for a, b, data, offsets in B.slices(batch.column("text")):
                    style, bucket, first = text_features(data, offsets)
                    total = np.concatenate([[0], np.cumsum(weights[bucket])])
                    words = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
                    x, z = model.views(style, words, meta[a:b])
                    out[0, a:b], out[1, a:b] = 1 / (1 + np.exp(-np.clip(x, -30, 30))), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    out[2, a:b] = model.combine(x, z)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in out), pa.array(out[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    source = _columns(small_batches(documents))
    return source.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")
