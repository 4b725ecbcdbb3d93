"""Mixing documents to target weights with soft domain membership.

A softmax classifier, trained on a bounded sample of labelled rows, gives every document a posterior over domains.  Then
nonnegative rates are fitted by projected-gradient least squares: the expected tokens of a domain are the sum over documents of
rate * tokens * posterior, and the squared distance of these totals from the targets is brought down by steps r <- max(0, r - step).
A document's step is its tokens times the inner product of its posterior with one small vector, so its rate is a replay of the steps so
far, a longer document of a scarce domain is repeated more than a short one, and one without tokens keeps its rate;
the driver holds that small vector for each step, and each pass over the posteriors, which are dealt over the cluster, returns one
total for each domain.

Defined cases: a null or empty text has no tokens, the posterior of an empty text, and a rate all the same; a null id is a
row like others (and has no label); rows that share an id are documents of their own, with the same label; labels that
repeat an id count once (the smallest domain); without any labelled row all posteriors are uniform; an empty table gives an
empty result; a very long text is a chunk of its own, and its copies leave the task in batches of bounded bytes; ``mix_documents`` keeps
all columns.  Copies are drawn by row (from its id, its text and how often the chunk has had both), so rows without an id don't share a draw.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .quality import Facts
from .textops import LOWER, Chunk, chunks, equal_runs, mix, range_hash, word_hashes

#: Labelled rows that the classifier is fitted on at most (those of the least id hashes).
LABEL_ROWS = 4000
#: Bytes of a batch of copies.
OUT_BYTES = 16 << 20
#: Hashed word features.
BUCKETS = 1 << 11
#: Domains in order, and the share of all tokens that each is to have.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}
_DENSE = 7


def domain_of(quality: Column, toxic: Column) -> Column:
    """The label table's domain: toxic before low before clean; null without a label."""
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(0))


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and weight of every word; dense facts of every row).  A row's word weights sum to 1."""
    f = Facts(c)
    w = f.words
    h = word_hashes(c, w, LOWER[c.data])
    bucket = (mix(h) >> np.uint64(53)).astype(np.int64)
    n = np.maximum(f.n_words, 1)
    upper = np.concatenate(([0], np.cumsum((c.data >= 65) & (c.data <= 90))))
    upper = upper[c.off[1:]] - upper[c.off[:-1]]
    dense = np.stack([np.ones(c.n), np.minimum(f.n_symbols / n, 1), f.n_repeat_words / n, f.n_echo_words / n, np.minimum(f.word_chars / n, 20) / 10, np.minimum(upper / n, 5) / 5, f.n_words < 20], axis=1)
    return bucket, w.first, dense


@dataclass
class Classifier:
    words: np.ndarray  # BUCKETS x domains
    dense: np.ndarray  # facts x domains

    def posteriors(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Words of each row and its posterior."""
        bucket, first, dense = features(c)
        n = np.diff(first)
        z = dense @ self.dense
        for k in range(z.shape[1]):
            total = np.concatenate(([0.0], np.cumsum(self.words[bucket, k])))
            z[:, k] += (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(n, 1))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return n, p / p.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS, steps: int = 250) -> Classifier:
    """labels: doc_id and domain (0, 1, ...).  Features are made in Spark; the driver gets the bounded sample's counts."""
    known = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                bucket, first, dense = features(c)
                out = []
                for i in range(c.n):
                    b, n = np.unique(bucket[first[i] : first[i + 1]], return_counts=True)
                    out.append((b.astype(np.int32), n.astype(np.float32) / np.sqrt(max(1, first[i + 1] - first[i]))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.list_(pa.float32())), pa.array(list(dense), pa.list_(pa.float64()))], names=["domain", "bucket", "weight", "dense"])

    # At most label_rows ids, so this side is safe to broadcast.
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(sample), "doc_id").select("domain", "t").limit(label_rows)
    got = rows.mapInArrow(count, "domain int, bucket array<int>, weight array<float>, dense array<double>").toArrow()
    k = len(DOMAINS)
    model = Classifier(np.zeros((BUCKETS, k)), np.zeros((_DENSE, k)))
    if not got.num_rows:
        return model
    y = np.eye(k)[got["domain"].to_numpy()]
    x = np.zeros((len(y), BUCKETS), np.float32)
    for i, (b, v) in enumerate(zip(got["bucket"].to_pylist(), got["weight"].to_pylist(), strict=True)):
        x[i, b] = v
    dense = np.array(got["dense"].to_pylist())
    x = np.hstack([x, dense.astype(np.float32)])
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ ((p / p.sum(axis=1, keepdims=True) - y) / len(y)).astype(np.float32) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(w[:BUCKETS].astype(float), w[BUCKETS:].astype(float))


def with_posteriors(docs: DataFrame, model: Classifier, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), p (the posterior of each domain) and draw, the row's number from 0 to 1 that rounds its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                n, p = model.posteriors(c)
                ids = batch.column(0).slice(c.lo, c.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), _lists(p), pa.array(draws(ids, c))], names=["doc_id", "n_tokens", "p", "draw"])

    return docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>, draw double")


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))


def rates(n: np.ndarray, p: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    """Rates of documents of n tokens and posteriors p after the steps of a path: from 1, and after each step to zero where it is below."""
    r, a = np.ones(len(p)), p * n[:, None]
    for step in path:
        r = np.maximum(0.0, r - a @ step)
    return r


#: Share of its trace that is added to the Gram matrix of a step: a domain that hardly any document belongs to is chased in smaller steps.
DAMPING = 1e-4
#: A fit ends after two steps that bring the objective down by less than this share of it.
PROGRESS = 1e-3


def fit_rates(table: DataFrame, targets: Mapping[str, float] = TARGETS, tokens: float | None = None, most_passes: int = 100, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The steps of a projected-gradient fit over a table with n_tokens and p.

    targets: weight of each domain; tokens: the total to match (default: that of the table).  What is minimised is the squared distance of
    the totals from the targets.  A step goes along the gradient over the rates, scaled by the inverse of the damped Gram matrix of the
    documents whose rate is above zero (so that a scarce domain isn't slower than others), and every rate is projected before the next
    step; a step is halved until it brings the objective down.  The fit ends within ``tolerance`` of all tokens, or where steps make no
    more PROGRESS, as for targets that can't be reached; those give a warning, and domain_totals() says what was reached.
    """
    k = len(DOMAINS)
    weight = np.array([targets[d] for d in DOMAINS], float)
    held = table.select(F.col("n_tokens").cast("double"), "p")

    def totals(path: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the documents above zero."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(k + k * k)
            for batch in batches:
                n, p = batch.column(0).to_numpy(), batch.column(1).values.to_numpy().reshape(-1, k)
                r, a = rates(n, p, path), p * n[:, None]
                free = a[r > 0]
                sums += np.append(r @ a, free.T @ free)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "x"])

        found = dict(held.mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect())
        flat = np.array([found.get(i, 0.0) for i in range(k + k * k)])
        return flat[:k], flat[k:].reshape(k, k)

    path: list[np.ndarray] = []
    total, gram = totals(path)
    goal = weight / weight.sum() * (tokens if tokens is not None else total.sum())
    scale = max(goal.sum(), 1.0)
    value = lambda total: float(((total - goal) ** 2).sum())
    passes, idle, better = 1, 0, True
    while np.abs(total - goal).max() / scale >= tolerance and passes < most_passes and idle < 2 and better and gram.any():
        step = np.linalg.solve(gram + DAMPING * np.trace(gram) * np.eye(k), total - goal)
        for _ in range(12):
            after, free = totals([*path, step])
            passes += 1
            if better := value(after) < value(total):
                break
            step = step / 2
        if better:
            idle = idle + 1 if value(total) - value(after) <= PROGRESS * value(total) else 0
            path.append(step)
            total, gram = after, free
    error = float(np.abs(total - goal).max() / scale)
    if error >= tolerance and goal.sum():
        warnings.warn(f"the domains' expected totals miss their targets by up to {error:.2g} of all tokens", stacklevel=2)
    return path


def draws(ids: pa.Array, c: Chunk) -> np.ndarray:
    """A number from 0 to 1 for each row of a chunk, from its id, its text and its place among equal rows of the chunk."""
    key = mix(pa.compute.fill_null(ids, -1).to_numpy().view(np.uint64) + np.uint64(77)) ^ range_hash(c.data, c.off[:-1], c.off[1:])
    at, begin = equal_runs(key)
    again = np.zeros(c.n, np.uint64)
    again[at] = (np.arange(len(at)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
    return (mix(mix(key) + again) >> np.uint64(11)).astype(float) / (1 << 53)


def copies(r: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Whole copies whose expectation over draws is the rate."""
    return np.floor(r + draw).astype(np.int64)


def document_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, n_tokens, p, rate and copies of every row; ``domain_totals`` sums them up."""
    table = written(with_posteriors(docs, fit_classifier(docs, labels, id, text, label_rows), id, text), "posteriors")
    path = fit_rates(table, targets)
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates(batch.column(1).to_numpy(), batch.column(2).values.to_numpy().reshape(-1, k), path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(r), pa.array(copies(r, batch.column(3).to_numpy()))], names=["doc_id", "n_tokens", "p", "rate", "copies"])

    return table.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double, copies long")


def domain_totals(rated: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """domain, target and reached: the share of all tokens that a domain is to have, and that of its expected tokens.

    rated: rows of n_tokens, p and rate, as document_rates makes them; reached is relative to the tokens before mixing.
    """
    weight = sum(targets[d] for d in DOMAINS)
    sums = rated.agg(F.sum("n_tokens").alias("all"), *(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p")[k]).alias(d) for k, d in enumerate(DOMAINS)))
    each = (F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / weight).alias("target"), (F.col(d) / F.col("all")).alias("reached")) for d in DOMAINS)
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id: str = "doc_id", text: str = "text", label_rows: int = LABEL_ROWS) -> DataFrame:
    """The rows of docs, each as often as its rate says."""
    model = fit_classifier(docs, labels, id, text, label_rows)
    path = fit_rates(written(with_posteriors(docs, model, id, text), "posteriors"), targets)
    i, t = docs.columns.index(id), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(i).cast(pa.int64())
            for c in chunks(batch.column(t)):
                r = rates(*model.posteriors(c), path)
                yield from repeated_rows(batch.slice(c.lo, c.n), copies(r, draws(ids.slice(c.lo, c.n), c)), np.diff(c.off))

    return docs.mapInArrow(run, docs.schema)


def repeated_rows(batch: pa.RecordBatch, times: np.ndarray, size: np.ndarray, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Each row so many times, in batches of about ``most`` bytes by the rows' sizes (of at least one row)."""
    row = np.repeat(np.arange(len(times)), times)
    end = np.cumsum(size[row] + 64)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, "right")))
        yield batch.take(pa.array(row[lo:hi]))
        lo = hi
