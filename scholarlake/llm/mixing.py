"""Mixing sources to target weights with soft membership.

A softmax classifier, trained on a bounded sample of the labelled table,
predicts for every document the posterior of its domain. Nonnegative rates of
the documents are then fitted by distributed projected-gradient least squares,
so that the expected tokens of the domains (rate * tokens * posterior) match
the targets, staying near rate 1 where the targets leave a choice. Gradients
are summed before they are projected: a rate is 1 less the posterior times the
sum of all steps, cut at 0, so a pass over the data carries one number per
domain. A step is the residual times the inverse Gram matrix of the posteriors
of documents with a positive rate, halved where it went too far; so a handful
of passes meets the targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import checkpointed, discard, texts
from scholarlake.llm.words import U, Words, raw_text, salted, slices

#: Hashed word features beside the shape features.
BUCKETS = 256
SHAPE = 8
#: Hashed words whose odds of the domains are counted.
ODDS = 1 << 16
#: Weight of the distance to rate 1 against the targets.
RIDGE = 1e-5


def word_buckets(words: Words) -> np.ndarray:
    return (salted(words.hash, 14) % U(ODDS)).astype(np.int64)


def doc_vectors(column: pa.Array, odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows, tokens) of a run of texts; an empty text has zero features but the constant.

    ``odds``: how much a word speaks for each domain; its mean and maximum over a text are features too.
    """
    words = Words(column, lower=True)
    raw, offsets = raw_text(column)
    n = len(words.count)
    size = np.maximum(np.diff(offsets), 1)
    of = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda mask: np.bincount(of[mask], minlength=n) / size
    doc = words.doc_of()
    many = np.maximum(words.count, 1)
    x = np.zeros((n, SHAPE + BUCKETS), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.log1p(words.count) / 10
    x[:, 2] = share((raw >= 65) & (raw <= 90)) * 2
    x[:, 3] = share((raw >= 48) & (raw <= 57)) * 4
    x[:, 4] = share((raw < 127) & (raw > 32) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 65) & (raw <= 90)) & ~((raw >= 97) & (raw <= 122))) * 4
    x[:, 5] = share(raw == 10) * 10
    if len(words.hash):
        pair = salted(words.hash, 2) ^ salted(doc.astype(U), 8)
        _, first = np.unique(pair, return_index=True)
        x[:, 6] = np.bincount(doc[first], minlength=n) / many
        x[:, 7] = np.minimum(np.bincount(doc, weights=words.end - words.start, minlength=n) / many / 10, 3)
        bucket = (salted(words.hash, 4) % U(BUCKETS)).astype(np.int64)
        counts = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        x[:, SHAPE:] = np.sqrt(counts / many[:, None])
    if odds is not None:
        k = odds.shape[1]
        more = np.zeros((n, 2 * k), np.float32)
        if len(words.hash):
            each = odds[word_buckets(words)]
            full = np.flatnonzero(words.count)
            more[full, :k] = 5 * np.add.reduceat(each, words.first[full], axis=0) / words.count[full][:, None]
            more[full, k:] = np.maximum.reduceat(each, words.first[full], axis=0)
        x = np.hstack([x, more])
    return x, words.count


def posteriors(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def word_odds(rows: DataFrame, domains: list[str]) -> np.ndarray:
    """Log odds of each domain given a word (hashed), from the documents of rows(domain, text) that hold it."""
    k = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ODDS * k, np.int32)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), lower=True)
                y = np.searchsorted(domains, part.column(0).to_pylist())
                cell = np.unique(words.doc_of() * ODDS + word_buckets(words)) if len(words.hash) else np.zeros(0, np.int64)
                total += np.bincount((cell % ODDS) * k + y[cell // ODDS], minlength=ODDS * k).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    # A bounded table from each of a few tasks.
    found = rows.coalesce(4).mapInArrow(count, "n binary").collect()
    n = np.sum([np.frombuffer(r.n, np.int32) for r in found], axis=0).reshape(ODDS, k).astype(np.float64)
    share = n.sum(axis=0) / max(1, n.sum())
    odds = np.log((n + 4 * share) / (n.sum(axis=1, keepdims=True) + 4)) - np.log(np.maximum(share, 1e-9))
    return np.where(n.sum(axis=1, keepdims=True) >= 4, odds, 0).astype(np.float32)


def fit_domains(docs: DataFrame, labelled: DataFrame, n_rows: int = 8000, rounds: int = 500, l2: float = 1e-4) -> tuple[list[str], np.ndarray, np.ndarray | None]:
    """(domains in order, softmax weights, word odds) from at most ``n_rows`` labelled rows, chosen by a hash of the id.

    One half of them gives the odds of words, the other the weights.
    """
    named = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_rows)
    # At most n_rows ids.
    sample = checkpointed(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text"))
    domains = sorted(r.domain for r in sample.select("domain").distinct().collect())
    if not domains:
        return [], np.zeros((SHAPE + BUCKETS, 0)), None
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))
    odds = word_odds(sample.filter(half == 0).select("domain", "text"), domains)
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, _ = doc_vectors(part.column(2), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "domain", "x"])

    rows = sample.filter(half == 1).mapInArrow(run, "doc_id long, domain string, x array<float>").toArrow().sort_by("doc_id")
    discard(sample)
    names = rows.column("domain").to_pylist()
    if not names:
        return domains, np.zeros((SHAPE + BUCKETS + 2 * len(domains), len(domains))), odds
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(names), -1)
    y = np.zeros((len(names), len(domains)), np.float32)
    y[np.arange(len(names)), np.searchsorted(domains, names)] = 1
    w = seen = np.zeros((x.shape[1], len(domains)), np.float32)
    step = np.float32(2 * len(x) / (x.astype(np.float64) ** 2).sum())
    for i in range(rounds):
        new = seen - step * (x.T @ (posteriors(x, seen) - y) / np.float32(len(x)) + np.float32(l2) * seen)
        seen, w = new + np.float32(i / (i + 3)) * (new - w), new
    return domains, w.astype(np.float64), odds


def rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the summed ``steps``."""
    return np.maximum(0, 1 - p @ steps)


def fit_rates(weighed: DataFrame, targets: np.ndarray, n_tokens: float, ridge: float = RIDGE, rounds: int = 60, close: float = 1e-7) -> tuple[np.ndarray, float]:
    """(summed steps, largest miss of a target) of the projected gradient over ``weighed(n_tokens, p)``.

    Minimises the squared miss plus ``ridge`` times the squared distance of the
    rates to 1 by its dual, which is convex and piecewise quadratic: a step is
    Newton's, taken back by half until the dual falls. ``rounds`` bounds the
    passes; what is left then shows in the miss.
    """
    k = len(targets)
    width = 1 + k + k * k

    def measured(steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(dual value, expected share of each domain, Gram matrix of the documents with a positive rate)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False) / n_tokens
                p = np.asarray(batch.column(1).flatten()).reshape(-1, k)
                r = rates(p, steps)
                total[0] += n @ (r * r) / 2
                total[1 : 1 + k] += (n * r) @ p
                total[1 + k :] += ((n * (r > 0))[:, None] * p).T.dot(p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["k", "total"])

        out = np.zeros(width)
        for r in weighed.mapInArrow(run, "k long, total double").groupBy("k").agg(F.sum("total").alias("total")).collect():
            out[r.k] = r.total
        return out[0] + steps @ targets + ridge * (steps @ steps) / 2, out[1 : 1 + k], out[1 + k :].reshape(k, k)

    steps = np.zeros(k)
    value, share, gram = measured(steps)
    move = None
    for _ in range(rounds):
        if move is None:
            slope = share - targets - ridge * steps
            if np.abs(slope).max() < close:
                break
            # Domains that no document with a positive rate may belong to keep their steps bounded.
            move = np.linalg.solve(gram + max(ridge, 1e-9 * np.trace(gram)) * np.eye(k), slope)
        tried = measured(steps + move)
        if tried[0] <= value + 1e-15:
            steps, (value, share, gram), move = steps + move, tried, None
        elif np.abs(move).max() < 1e-9:
            break
        else:
            move = move / 2
    return steps, float(np.abs(share - targets).max())


def target_shares(domains: list[str], weights: dict[str, float]) -> np.ndarray:
    """Targets in the order of ``domains``, summing to 1; domains without a weight get 0, and all get the same if none has."""
    t = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    return t / t.sum() if t.sum() > 0 else np.full(len(domains), 1 / max(1, len(domains)))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, ridge: float = RIDGE, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, posterior (domain -> probability), rate, copies, target_miss.

    ``labelled``: (doc_id, domain). The expected token share of domain d
    becomes ``weights[d]`` of ``budget`` times all tokens. ``copies`` is the
    rate rounded up or down by a hash of the id, so that it is right on
    average. ``target_miss``, the same in all rows, is how far the worst domain
    stays from its target: near 0 unless no rates meet the targets. Empty and
    null texts have no tokens and rate 1; without labels there are no domains,
    every rate is the budget and the miss is null. A targeted domain that no
    labelled row has is ignored. Repeated rows count each; a null id is a row
    like others. ``keep`` returns all columns of ``docs`` before the results;
    a column of ``docs`` that is named like one of the results is replaced.
    """
    plain = texts(docs, id_col=id_col, text_col=text_col)
    domains, w, odds = fit_domains(plain, labelled, **params)
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    k = len(domains)

    def scored(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, n = doc_vectors(column, shared.value)
        return n, posteriors(x.astype(np.float64), w) if k else np.zeros((len(n), 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, p = scored(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(p.ravel()))], names=["n_tokens", "p"])

    steps, miss = np.zeros(k), None
    if k:
        weighed = checkpointed(plain.select("text").mapInArrow(measure, "n_tokens long, p array<double>"))
        total = weighed.agg(F.sum("n_tokens")).first()[0] or 0
        if total:
            steps, miss = fit_rates(weighed, target_shares(domains, weights) * budget, float(total), ridge)
        discard(weighed)

    base = docs.drop("rate", "copies", "n_tokens", "posterior", "target_miss") if keep else plain
    at = base.columns.index(text_col if keep else "text")
    name = text_col if keep else "text"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if keep or f.name == "doc_id")
    id_at = base.columns.index(id_col if keep else "doc_id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, name):
                n, p = scored(part.column(at))
                r = rates(p, steps) if k else np.full(len(n), float(budget))
                r = np.where(n == 0, 1.0, r)
                ids = part.column(id_at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                copies = np.floor(r + (salted(ids.view(U), 77) >> U(11)) / float(1 << 53))
                entries = pa.StructArray.from_arrays([pa.array(domains * len(n), pa.string()), pa.array(p.ravel())], ["key", "value"])
                posterior = pa.MapArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), entries.field(0), entries.field(1))
                kept = [part.column(i) for i in range(part.num_columns)] if keep else [part.column(id_at)]
                names = list(part.schema.names) if keep else ["doc_id"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64)), posterior, pa.array(r), pa.array(copies.astype(np.int64)), pa.array([miss] * len(n), pa.float64())], names=[*names, "n_tokens", "posterior", "rate", "copies", "target_miss"])

    return base.mapInArrow(apply, f"{fields}, n_tokens long, posterior map<string,double>, rate double, copies long, target_miss double")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxicity labels: q<quality>t<toxic>."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("q"), F.col("quality").cast("int"), F.lit("t"), F.col("toxic").cast("int")).alias("domain"))
