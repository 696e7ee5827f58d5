"""Mixing domains to target weights with soft memberships.

A classifier learned from the labelled table gives each document a posterior over
domains (here the pairs of quality and toxicity labels). Rates r_d >= 0 of the
documents are then fitted so that the expected token totals of the domains,
A r with A_kd = tokens_d p_dk, meet the targets T:

    minimise 1/2 |A r - T|^2 subject to r >= 0, from r = 1,

by projected gradient in the metric of the documents' tokens: a step moves r_d by
p_d . s with s = eta (A r - T), then clips at 0, which in a diagonal metric is the
projection. With M the sum of tokens_d p_d p_d' over the documents that are free
(r_d > 0), eta = 1 / lambda_max(M) never raises the objective. Each pass over the
documents tries that step and longer ones at once, multiples of it and steps
(M + mu I)^-1 (A r - T), measures the objective after clipping of each, and takes the
best: every step descends, whether the targets can be met or not. It ends when the
targets are met (``CLOSE``), when ``STALLS`` passes in a row gain less than ``GAIN`` of
the objective, or after ``PASSES``. As a rate depends on the document's posterior and
the steps alone, tasks replay the steps: each pass sums a few numbers a task, and no
rates are stored or sent. A document is then taken floor(r) times and once more
with probability r - floor(r), decided by a hash of its id and text.

The classifier is fitted on at most ``SAMPLE`` labelled rows, chosen by hash;
posteriors, totals and rates cover every document.

Defined results: a null or empty text has no tokens and rate 1; without labels
every document is of one domain and has the rate that meets its total; a domain
without a target has weight 0; targets that no rates meet get those that come
closest, in the sense of the objective; an empty table gives an empty result; repeated
rows get equal rates and equal decisions; ties can't occur; columns of any names
are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quillspan.llm import linear, shared, textbuf

SAMPLE = 6000
PREFIXES = (4,)
PASSES, CLOSE, GAIN, STALLS = 80, 1e-6, 1e-5, 3
#: Shares of the tokens: high or low quality (q1, q0), clean or toxic (t0, t1).
WEIGHTS = {"q1t0": 0.86, "q0t0": 0.08, "q1t1": 0.05, "q0t1": 0.01}


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = textbuf.Words(offsets, textbuf.lower(data), PREFIXES)
    n = len(offsets) - 1
    return linear.join(n, linear.shapes(offsets, data, words), linear.presence(words, n, PREFIXES))


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``columns`` of the labels and ``text`` of at most ``most`` labelled documents, the first by hash."""
    chosen = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *columns).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(*columns, "text")


def collected(sample: DataFrame, features) -> tuple[list, np.ndarray, np.ndarray]:
    """Label, bounds and features of a bounded sample in columns ``label, text``, in the order of label and text."""

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                bounds, feature = features(off, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["label", "feature"])

    got = sample.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(run, "label string, feature array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["label"][i].as_py() or "", len(got["feature"][i])))
    got = got.take(pa.array(order, pa.int64()))
    lists = got["feature"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(got):
        return [], np.zeros(1, np.int64), np.zeros(0, np.int64)
    return got["label"].to_pylist(), lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)


def fit_classifier(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Domains and weights from at most ``SAMPLE`` labelled documents."""
    domain = F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic"))
    sample = sampled(docs, labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", domain.alias("label")), ["label"], SAMPLE)
    label, bounds, feature = collected(sample, _features)
    domains = sorted(set(label))
    if len(domains) < 2:
        return domains or ["all"], np.zeros((linear.DIM + linear._SHAPES + 1, 1), np.float32)
    target = np.zeros((len(label), len(domains)))
    target[np.arange(len(label)), [domains.index(x) for x in label]] = 1
    return domains, linear.fit(bounds, feature, target)


def posteriors(docs: DataFrame, weights: np.ndarray, carry: list[str], names: tuple[str, str] = ("tokens", "posterior")) -> DataFrame:
    """Columns ``carry`` and, by ``names``, tokens and posterior. The weights go out once, as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    made = [*carry, *names]

    def run(batches):
        w = sent.value
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(len(carry)))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                p = linear.softmax(linear.scores(*_features(off, part), w))
                tokens = -(-np.diff(off) // 4)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(carry))), pa.array(tokens), flat], made)

    schema = StructType([*(docs.schema[c] for c in carry), StructField(names[0], LongType()), StructField(names[1], ArrayType(DoubleType()))])
    return docs.select(*carry, "text").mapInArrow(run, schema)


def replay(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps."""
    r = np.ones(len(posterior))
    for s in steps:
        r = np.maximum(0, r - posterior @ s)
    return r


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _candidates(off: np.ndarray, metric: np.ndarray) -> list[np.ndarray]:
    """Steps to try from the residual: the safe gradient step first, then longer ones."""
    values, vectors = np.linalg.eigh(metric)
    top = max(float(values[-1]), 1e-300)
    along = vectors.T @ off
    gradient = [off / top * 4.0**j for j in range(6)]
    damped = [vectors @ (along / (np.maximum(values, 0) + top * mu)) * scale for mu in (1e-1, 1e-2, 1e-3, 1e-5, 1e-9) for scale in (1.0, 3.0)]
    return gradient + damped


def fit_rates(held: DataFrame, domains: list[str], weights: Mapping[str, float]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, achieved totals and targets, from written ``tokens, posterior``."""
    k = len(domains)
    steps: list[np.ndarray] = []
    tries: list[np.ndarray] = [np.zeros(k)]
    target = value = None
    off, stalled, width = np.zeros(k), 0, k + k * k + 1
    for _ in range(PASSES):
        now, each = list(steps), list(tries)

        def run(batches, now=now, each=each):
            total = np.zeros((len(each), width))
            for batch in batches:
                t, p = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch.column(1), k)
                start = replay(p, now)
                for i, s in enumerate(each):
                    r = np.maximum(0, start - p @ s)
                    total[i, :k] += (t * r) @ p
                    free = r > 0
                    total[i, k:-1] += ((t * free)[:, None] * p).T.dot(p).ravel()
                    total[i, -1] += t.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

        rows = held.select("tokens", "posterior").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(len(each) * width)
        for row in rows:
            sums[row["i"]] = row["x"]
        sums = sums.reshape(len(each), width)
        every = float(sums[0, -1])
        if target is None:
            share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
            target = every * (share / share.sum() if share.sum() > 0 else np.full(k, 1 / k))
        values = ((sums[:, :k] - target) ** 2).sum(axis=1) / 2
        best = int(values.argmin())
        if value is not None and values[best] >= value:
            break
        stalled = stalled + 1 if value is not None and value - values[best] < GAIN * value else 0
        value, got = float(values[best]), sums[best, :k]
        if len(each) > 1:
            steps.append(each[best])
        off = got - target
        if not every or np.abs(off).max() <= CLOSE * every or stalled >= STALLS:
            break
        tries = _candidates(off, sums[best, k:-1].reshape(k, k))
    return steps, got, target


def rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``doc_id, tokens, domain, rate, copies``: domain is the likeliest; copies the number of times to take the document."""
    domains, w = fit_classifier(docs, labels)
    held = shared.table(posteriors(docs.withColumn("luck", _luck(docs)), w, ["doc_id", "luck"]), "posteriors")
    steps, _, _ = fit_rates(held, domains, weights)
    k = len(domains)

    def run(batches):
        for batch in batches:
            p, t = _matrix(batch.column(3), k), batch.column(2).to_numpy()
            r = np.where(t > 0, replay(p, steps), 1.0)
            copies = _copies(r, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([domains[i] for i in p.argmax(axis=1)]), pa.array(r.round(6)), pa.array(copies)], ["doc_id", "tokens", "domain", "rate", "copies"])

    return held.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tokens long, domain string, rate double, copies int")


def _luck(docs: DataFrame):
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _copies(rate: np.ndarray, luck: np.ndarray) -> np.ndarray:
    whole = np.floor(rate)
    return (whole + (luck < rate - whole)).astype(np.int32)


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``docs`` with each row taken as often as its rate says, all columns as they are. Texts are classified once; the rows are written with their posteriors."""
    domains, w = fit_classifier(docs, labels)
    columns = docs.columns
    luck = shared.spare(columns, "luck")
    tokens = shared.spare([*columns, luck], "tokens")
    posterior = shared.spare([*columns, luck, tokens], "posterior")
    held = shared.table(posteriors(docs.withColumn(luck, _luck(docs)), w, [*columns, luck], (tokens, posterior)), "posteriors")
    steps, _, _ = fit_rates(held.select(F.col(tokens).alias("tokens"), F.col(posterior).alias("posterior")), domains, weights)
    k, n = len(domains), len(columns)

    def run(batches):
        for batch in batches:
            t = batch.column(n + 1).to_numpy()
            times = _copies(np.where(t > 0, replay(_matrix(batch.column(n + 2), k), steps), 1.0), batch.column(n).to_numpy())
            yield batch.select(range(n)).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return held.mapInArrow(run, docs.schema)
