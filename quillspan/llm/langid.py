"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved with filters of widths 2, 3 and 4, max-pooled over
a window and classified by softmax. It learns from labelled texts, and is applied
to every fixed-length window of a text, never to a prefix alone; windows follow each
other without overlap, so a filter doesn't see across their borders. A text's
posterior is the mean of its windows', weighted by their bytes.

A document is rejected if it has no text, if nothing was learned, or if its best
language gets less than ``least`` of the posterior.

The labelled sample is bounded by ``TRAIN_DOCS`` distinct texts a language, the first
by hash whatever the order of rows, and a stretch of ``TRAIN_CHARS`` characters of each,
from a place chosen by hash; application covers everything.

Defined results: null and empty texts, and texts of white space only, are ``und``
with confidence 0 and are rejected; with no labelled rows every document is
``und``; equal texts get equal answers; repeated rows are answered each; an empty
table gives an empty result; columns of any names are kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import textbuf

WINDOW, EMBEDDING, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
TRAIN_DOCS, TRAIN_CHARS, STEPS, BATCH = 1200, 2000, 500, 128
LEAST = 0.5
_WIDE = max(WIDTHS)


@dataclass
class ByteCNN:
    """Weights; ``w`` holds all widths, with zero rows beyond a filter's own."""

    languages: list[str]
    embedding: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embedding[x]
        t = x.shape[1] - _WIDE + 1
        return np.concatenate([e[:, j : j + t] for j in range(_WIDE)], axis=2)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Softmax of windows: ``x`` has shape (windows, bytes)."""
        z = (self._columns(x) @ self.w).max(axis=1) + self.b
        logits = np.maximum(z, 0) @ self.v + self.c
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    m = np.zeros((_WIDE * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        m[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    return m


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteCNN | None:
    """Adam on random windows of random length; None without texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by = [[t for t, lab in zip(texts, labels, strict=True) if lab == k] for k in languages]
    mask, n = _mask(), FILTERS * len(WIDTHS)
    f4 = np.float32
    model = ByteCNN(languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(f4), rng.normal(0, 0.3, mask.shape).astype(f4) * mask, np.zeros(n, f4), rng.normal(0, 0.3, (n, len(languages))).astype(f4), np.zeros(len(languages), f4))
    weights = [model.embedding, model.w, model.b, model.v, model.c]
    first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    rows = np.arange(BATCH)[:, None]
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, k in enumerate(y):
            text = by[k][rng.integers(len(by[k]))]
            size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
            at = int(rng.integers(max(1, len(text) - size + 1)))
            piece = text[at : at + size]
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        cols = model._columns(x)
        raw = cols @ model.w
        best = raw.argmax(axis=1)
        z = np.take_along_axis(raw, best[:, None, :], 1)[:, 0] + model.b
        pooled = np.maximum(z, 0)
        logits = pooled @ model.v + model.c
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        dz = (p @ model.v.T) * (z > 0)
        won = cols[rows, best]  # (batch, filters, inputs)
        dw = np.einsum("bf,bfi->if", dz, won) * mask
        dcol = dz[:, :, None] * model.w.T[None]
        de = np.zeros_like(model.embedding)
        for j in range(_WIDE):
            np.add.at(de, x[rows, best + j], dcol[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        rate = 0.01 * (0.1 if step > 0.8 * steps else 1)
        for q, g, m1, m2 in zip(weights, [de, dw, dz.sum(0), pooled.T @ p, p.sum(0)], first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            q -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(f4)
    return model


def fit(docs: DataFrame) -> ByteCNN | None:
    """Train on a bounded sample of the rows with a ``lang``, chosen by hash, as many of each language as there are up to ``TRAIN_DOCS``."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    counts = {r["lang"]: r["count"] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * TRAIN_DOCS / n))])
    luck = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003)
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1))) + 1
    sample = labelled.where(luck < share[F.col("lang")]).select("lang", F.xxhash64("text").alias("hash"), F.col("text").substr(at.cast("int"), F.lit(TRAIN_CHARS)).alias("part"))
    # Copies count once, so that a large group of them doesn't crowd out others.
    distinct = sample.groupBy("lang", "hash").agg(F.min("part").alias("part"))
    order = Window.partitionBy("lang").orderBy("hash", "part")
    rows = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRAIN_DOCS).select("lang", "part").collect()
    taken: dict[str, list[bytes]] = {}
    for lang, part in sorted((r["lang"], r["part"]) for r in rows):
        taken.setdefault(lang, []).append(part.encode())
    texts, labels = [], []
    for lang, parts in taken.items():
        texts += parts[:TRAIN_DOCS]
        labels += [lang] * len(parts[:TRAIN_DOCS])
    return train(texts, labels)


def classify(model: ByteCNN | None, offsets: np.ndarray, data: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text of a chunk."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    if model is None:
        return ["und"] * n, np.zeros(n)
    windows = -(-length // WINDOW)
    first = np.concatenate([[0], np.cumsum(windows)])
    padded = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    for i in range(n):
        padded[first[i] * WINDOW : first[i] * WINDOW + length[i]] = data[offsets[i] : offsets[i + 1]]
    x = padded.reshape(-1, WINDOW)
    weight = (x > 32).sum(axis=1)
    total = np.zeros((n, len(model.languages)))
    if len(x):
        p = np.concatenate([model.posterior(x[k : k + 64]) for k in range(0, len(x), 64)]) * weight[:, None]
        some = windows > 0
        total[some] = np.add.reduceat(p, first[:-1][some], axis=0)
        mass = np.zeros(n)
        mass[some] = np.add.reduceat(weight, first[:-1][some])
        total /= np.maximum(mass, 1)[:, None]
    best = total.argmax(axis=1)
    confidence = total[np.arange(n), best]
    return [model.languages[k] if c > 0 else "und" for k, c in zip(best, confidence, strict=True)], confidence


def identify(docs: DataFrame, model: ByteCNN | None, least: float = LEAST) -> DataFrame:
    """``doc_id, language, confidence, rejected`` of every row."""
    names = ["doc_id", "language", "confidence", "rejected"]

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                language, confidence = classify(model, off, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(language), pa.array(confidence.round(6)), pa.array(confidence < least)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, language string, confidence double, rejected boolean")


def keep_identified(docs: DataFrame, model: ByteCNN | None, least: float = LEAST) -> DataFrame:
    """The rows that aren't rejected, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(at))
            keep = np.concatenate([classify(model, off, part)[1] >= least for _, _, off, part in textbuf.chunks(offsets, data)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
