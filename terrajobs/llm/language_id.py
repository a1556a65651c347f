"""Language of texts by a small convolutional network over bytes, in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each
filter's maximum over a window is kept, and a softmax layer names the language. A text's
windows cover all of it; their probabilities are averaged by the bytes in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 6
UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 800


@dataclass
class ByteCnn:
    """Weights: embedding (256, E), filters (widest * E, F), their bias, output layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator) -> ByteCnn:
        n = FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (max(WIDTHS) * EMBED, n)) * _shape_mask()
        return ByteCnn(
            languages,
            rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            filters.astype(np.float32),
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows].reshape(len(windows), -1)
        steps = WINDOW - max(WIDTHS) + 1
        view = np.lib.stride_tricks.as_strided(x, (len(x), steps, max(WIDTHS) * EMBED), (x.strides[0], EMBED * x.itemsize, x.itemsize))
        return np.ascontiguousarray(view)

    def probabilities(self, windows: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), block):
            cols = self.columns(windows[a : a + block])
            top = (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(len(cols), -1, len(self.bias)).max(axis=1)
            out[a : a + block] = _softmax(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)
        return out


def _shape_mask() -> np.ndarray:
    """Narrow filters see only the first of the widest filter's bytes."""
    return np.concatenate([np.repeat((np.arange(max(WIDTHS) * EMBED) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 14, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy; gradients pass the pooling at each filter's maximum."""
    rng = np.random.default_rng(seed)
    net = ByteCnn.fresh(languages, rng)
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    mask, t, n_filters = _shape_mask(), 0, FILTERS * len(WIDTHS)
    steps = np.arange(max(WIDTHS))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            idx = windows[order[a : a + batch]]
            y = label[order[a : a + batch]]
            m = len(idx)
            cols = net.columns(idx)
            z = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(m, -1, n_filters)
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ net.out + net.out_bias)
            p[np.arange(m), y] -= 1
            p /= m
            back = (p @ net.out.T) * (top > 0)
            seen = cols[np.arange(m)[:, None], at]  # (m, filters, width * E)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0), "filters": np.einsum("mf,mfc->cf", back, seen) * mask}
            into = (back[:, :, None] * net.filters.T[None]).reshape(m, n_filters, max(WIDTHS), EMBED)
            spots = idx[np.arange(m)[:, None, None], at[:, :, None] + steps]
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], spots.reshape(-1), into.reshape(-1, EMBED))
            t += 1
            for k in names:
                g = grads[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w = getattr(net, k)
                w -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their row, bytes in each): every row's bytes in windows, the last padded with 0."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + k * WINDOW
    held = np.minimum(WINDOW, offsets[1:][row] - start)
    spot = start[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < held[:, None]
    return np.where(inside, data[np.minimum(spot, len(data) - 1)], 0).astype(np.uint8), row, held


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> ByteCnn | None:
    """Train on a bounded sample: one window from each of at most ``per_language`` texts of a
    language, spread over the table by a hash. None if no row has both text and language."""
    key = F.xxhash64(id_col, F.lit("sample"))
    length = F.greatest(F.length(text_col) - WINDOW, F.lit(0))
    text = F.substring(F.col(text_col), (F.pmod(F.xxhash64(id_col, F.lit("place")), length + 1) + 1).cast("int"), F.lit(WINDOW))
    rows = (
        labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
        .select(F.col(lang_col).cast("string").alias("lang"), F.pmod(key, F.lit(per_language)).alias("slot"), key.alias("key"), text.alias("text"))
        .groupBy("lang", "slot")
        .agg(F.min_by("text", F.struct("key", "text")).alias("text"))
        .toPandas()
        .sort_values(["lang", "slot"])
    )
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    # a window of the text's characters may hold more bytes; both its windows are used
    windows, label = [], []
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data):
            windows.append(cut(data, np.array([0, len(data)]))[0][:1])
            label.append(languages.index(lang))
    return train(np.concatenate(windows), np.array(label), languages)


def predict(documents: DataFrame, net: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, carried columns) for every row's whole text.

    ``und`` with score 0 if the text is null or has no letter, or if there is no model.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)
    letters = np.zeros(256, bool)
    letters[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            text, langs, scores = batch.column("_text"), [], []
            for a, b, data, offsets in B.slices(text):
                some = np.zeros(b - a, bool)
                plain = np.concatenate([[0], np.cumsum(letters[data])])
                some[:] = plain[offsets[1:]] > plain[offsets[:-1]]
                for r in np.flatnonzero(~some & (np.diff(offsets) > 0)):
                    some[r] = any(c.isalpha() for c in bytes(data[offsets[r] : offsets[r + 1]]).decode())
                if net is None or not len(data):
                    langs += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                windows, row, held = cut(data, offsets)
                p = net.probabilities(windows) * held[:, None]
                total = np.zeros((b - a, p.shape[1]))
                for k in range(p.shape[1]):
                    total[:, k] = np.bincount(row, p[:, k], b - a)
                total /= np.maximum(np.diff(offsets), 1)[:, None]
                best = total.argmax(axis=1)
                langs += [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
                scores += [min(float(total[r, k]), 1.0) if some[r] else 0.0 for r, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*carried, "lang_pred", "score"])

    carried = ["doc_id", *(c for c in carry)]
    source = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried)
    return source.mapInArrow(released(run), schema + ", lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learnt from the table's own rows not held out.

    Null ids are not held out. Repeated rows stay repeated; an empty table gives an empty
    result; extra columns are not read.
    """
    net = fit(documents.filter(~held_out()))
    return predict(documents.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
