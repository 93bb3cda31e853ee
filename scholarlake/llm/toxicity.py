"""Toxicity by weak supervision.

Voters are single words (a seed lexicon and words that the labelled rows
associate with toxicity), word beginnings (patterns that catch inflected and
compounded forms) and shape patterns. A generative label model estimates each
voter's hit rates in both classes and the correlations of voters within the
classes from the votes of all documents, by expectation maximisation over the
table of distinct vote patterns; labels choose the voters and give the rates
where it starts, which stay in it as a prior. Correlated voters of a text share what they say. The model's
posteriors train a logistic classifier, which scores every document by the
features of its text; only a labelled row on which every voter abstains is
learned by its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import checkpointed, crc_mod, discard, signed, texts
from scholarlake.llm.words import U, Words, raw_text, salted, slices

#: Seed lexicon.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Bytes of word beginnings that serve as pattern voters.
PREFIXES = (4, 5, 6)
#: Shape patterns, in the order that `shapes` returns them.
SHAPES = ("mostly upper case", "many exclamation marks", "few different words")
#: Weight of the rates by label in the label model, in documents for each document that votes.
ANCHOR = 3.0
N_FEATURES = 512
N_VOTERS = 96
#: Share of a voter's votes that must be right on labelled rows.
PRECISION = 0.9


def word_features(words: Words) -> list[np.ndarray]:
    """One array of feature hashes per kind, aligned with the words; 0 where a word is too short."""
    out = [salted(words.hash, 1)]
    for n in PREFIXES:
        out.append(np.where(words.end - words.start > n, salted(words.prefix_hash(n), 100 + n), U(0)))
    return out


def shapes(words: Words, raw: np.ndarray) -> np.ndarray:
    """Boolean shape patterns, a row per text."""
    n = len(words.count)
    of = np.repeat(np.arange(n), np.diff(words.offsets))
    upper = np.bincount(of[(raw >= 65) & (raw <= 90)], minlength=n)
    lower = np.bincount(of[(raw >= 97) & (raw <= 122)], minlength=n)
    bangs = np.bincount(of[raw == 33], minlength=n)
    many = np.maximum(words.count, 1)
    if len(words.hash):
        _, first = np.unique(salted(words.hash, 5) ^ salted(words.doc_of().astype(U), 6), return_index=True)
        distinct = np.bincount(words.doc_of()[first], minlength=n)
    else:
        distinct = np.zeros(n, int)
    return np.stack([upper > 2 * lower + 10, bangs > 0.2 * many + 1, (distinct < 0.3 * words.count) & (words.count > 20)], axis=1)


def shape_hashes() -> np.ndarray:
    return salted(np.arange(len(SHAPES), dtype=U), 900)


def seed_hashes() -> np.ndarray:
    return salted(Words(pa.array(SEEDS), lower=True, letters=True).hash, 1)


def doc_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, feature hash) pairs of a run of texts."""
    words = Words(column, lower=True, letters=True)
    raw, _ = raw_text(column)
    doc = words.doc_of()
    docs, features = [], []
    for h in word_features(words):
        there = h != 0
        docs.append(doc[there])
        features.append(h[there])
    at, which = np.nonzero(shapes(words, raw))
    docs.append(at)
    features.append(shape_hashes()[which])
    docs, features = np.concatenate(docs), np.concatenate(features)
    order = np.lexsort((features, docs))
    docs, features = docs[order], features[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (features[1:] != features[:-1])
    return docs[new], features[new]


def counted(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): documents of each label that hold a feature; rows(y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=16 << 20):
                y = part.column(0).to_numpy(zero_copy_only=False)
                docs, features = doc_features(part.column(1))
                key, inverse = np.unique(features, return_inverse=True)
                pos = np.bincount(inverse, weights=y[docs] == 1, minlength=len(key)).astype(np.int64)
                neg = np.bincount(inverse, weights=y[docs] == 0, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(pos), pa.array(neg)], names=["feature", "pos", "neg"])

    return rows.mapInArrow(run, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def held(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(y, at: indices into the sorted ``vocabulary`` that a text holds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                docs, features = doc_features(part.column(1))
                at = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
                hit = vocabulary[at] == features
                docs, at = docs[hit], at[hit]
                offsets = np.searchsorted(docs, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))], names=["y", "at"])

    return rows.mapInArrow(run, "y int, at array<int>")


class LabelModel:
    """Hit rates of voters in both classes (``a``: toxic, ``b``: clean), their correlations, and the rates of silence.

    A text is silent or not, by its class; if not, what each vote adds is its
    rate among such texts. A single abstention is no evidence. Voters of one text that are correlated share what they
    say: each counts 1 / (1 + its correlations with the others that voted).
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, silent: tuple[float, float], prior: float, correlation: np.ndarray, least: float = 0.1):
        self.a, self.b, self.silent, self.prior = a, b, silent, prior
        self.quiet = float(np.log(silent[0]) - np.log(silent[1]))
        self.loud = float(np.log(1 - silent[0]) - np.log(1 - silent[1]))
        self.each = np.log(a / b) - self.loud
        self.shared = np.where(correlation > least, correlation, 0)
        np.fill_diagonal(self.shared, 1)
        self.start = np.log(prior / (1 - prior))

    @classmethod
    def of(cls, positive: np.ndarray, votes: np.ndarray, silent: np.ndarray, n: np.ndarray, prior: float, both: np.ndarray, seen: float | None = None) -> LabelModel:
        """From (expected) toxic documents with each vote, all with each vote, silent ones and all by class, and joint votes of ``seen`` (all) documents."""
        rate = lambda x, k: np.clip((x + 0.05) / (k + 0.1), 1e-5, 1 - 1e-5)
        a, b = rate(positive, n[0]), rate(votes - positive, n[1])
        total = max(n.sum() if seen is None else seen, 1)
        return cls(a, b, (float(rate(silent[0], n[0])), float(rate(silent[1], n[1]))), prior, correlations(both / total, a, b, n[0] / max(n.sum(), 1)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxicity of the rows of a 0/1 table of votes."""
        odds = self.start + (votes * self.each / np.maximum(votes @ self.shared, 1)).sum(axis=1)
        odds = odds + np.where(votes.any(axis=1), self.loud, self.quiet)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def correlations(both: np.ndarray, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Of voters within the classes: what their joint rates ``both`` hold beyond the class means."""
    within = both - share * np.outer(a, a) - (1 - share) * np.outer(b, b)
    spread = np.sqrt(np.maximum(np.diag(within), 1e-9))
    out = np.clip(within / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def label_model(patterns: DataFrame, start: LabelModel, rounds: int = 8, close: float = 1e-3, anchor: float = 0.0) -> LabelModel:
    """Expectation maximisation over patterns(votes, n): a round sums one number per voter.

    Joint votes do not depend on the classes, so they are summed once. The
    rates of ``start`` count as those of ``anchor`` times as many documents
    (a prior of the same weight at every size), so that rare voters do not
    drift to the other class.
    """
    k = len(start.a)
    quiet_a, quiet_b = start.silent

    def summed(width: int, add) -> np.ndarray:
        """Totals over all patterns of ``add(table of votes, documents with each)``, a few thousand patterns at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    size = np.diff(np.asarray(part.column(0).offsets))
                    votes = np.zeros((part.num_rows, k))
                    votes[np.repeat(np.arange(part.num_rows), size), np.asarray(part.column(0).flatten())] = 1
                    total += add(votes, part.column(1).to_numpy().astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "x"])

        out = np.zeros(width)
        for r in patterns.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out

    found = summed(k * k + 2, lambda v, n: np.concatenate([(v.T @ (v * n[:, None])).ravel(), [n.sum(), n[~v.any(axis=1)].sum()]]))
    both, total, silent = found[: k * k].reshape(k, k), found[-2], found[-1]
    model = start
    for _ in range(rounds):

        def expected(votes: np.ndarray, n: np.ndarray, model=model) -> np.ndarray:
            q = n * model.posterior(votes)
            return np.concatenate([q @ votes, [q.sum(), q[~votes.any(axis=1)].sum()]])

        sums = summed(k + 2, expected)
        toxic, quiet = sums[k], sums[k + 1]
        prior = float(np.clip(toxic / max(total, 1), 0.001, 0.5))
        # The documents that `start` stands for, by class.
        more = anchor * total * np.array([start.prior, 1 - start.prior])
        positive, negative = sums[:k] + more[0] * start.a, np.diag(both) - sums[:k] + more[1] * start.b
        hushed = np.array([quiet, silent - quiet]) + more * [quiet_a, quiet_b]
        new = LabelModel.of(positive, positive + negative, hushed, np.array([toxic, total - toxic]) + more, prior, both, total)
        moved = np.abs(np.append(new.a - model.a, new.prior - model.prior)).max()
        model = new
        if moved < close:
            break
    return model


def logistic(x: np.ndarray, q: np.ndarray, weights: np.ndarray, l2: float = 1e-5, rounds: int = 800) -> np.ndarray:
    """Coefficients (the last is the intercept) of a logistic fit to soft labels, by accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    weights = (weights / weights.sum()).astype(np.float32)
    step = 4 / ((x**2).sum(1) * weights).sum()
    w = seen = np.zeros(x.shape[1], np.float32)
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 0
    q = q.astype(np.float32)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ seen, -30, 30)))
        new = seen - step * (x.T @ (weights * (p - q)) + penalty * seen)
        seen, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", holdout: int = 5, n_positive: int = 2500, n_negative: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature hashes, coefficients and intercept).

    Voters are chosen, and the classifier is fitted, on at most ``n_positive``
    + ``n_negative`` labelled rows, chosen by a hash of the id; the label model
    learns from the votes of all documents. The held-out remainder has no part
    in any of it.
    """
    docs = docs.filter("doc_id is not null").filter(crc_mod("doc_id", holdout) != 0)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    labels = labels.filter(crc_mod("doc_id", holdout) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n)
    share = labels.agg(F.avg("y")).first()[0]
    prior = float(np.clip(share if share is not None else 0.1, 0.01, 0.5))
    chosen = by_hash(labels.filter("y = 1"), n_positive).union(by_hash(labels.filter("y = 0"), n_negative))
    # At most n_positive + n_negative ids.
    rows = checkpointed(docs.join(F.broadcast(chosen), "doc_id").select("y", "text"))
    counts = dict(map(tuple, rows.groupBy("y").count().collect()))
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    seeds = np.concatenate([seed_hashes(), shape_hashes()])
    vocabulary = np.unique(seeds)
    value: dict[int, int] = {}
    if n_pos:
        least = max(4.0, 0.004 * n_pos)
        rate = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / (n_neg + 1))
        often = checkpointed(counted(rows).filter(F.col("pos") >= least).withColumn("rate", rate))
        # By chance alone (a Poisson tail), fewer than one in twenty of all features would get so far together.
        sure = F.col("pos") * (F.log("rate") - 1) + F.col("pos") / F.col("rate") >= float(np.log(20 * max(1, often.count())))
        best = often.filter("rate >= 8").withColumn("sure", sure).orderBy(F.desc(F.col("pos") * F.log("rate")), "feature").limit(N_FEATURES).collect()
        discard(often)
        vocabulary = np.unique(np.concatenate([seeds, np.array([r.feature for r in best], np.int64).view(U)]))
        value = {r.feature: r.pos for r in best if r.sure}
    may_vote = np.isin(vocabulary, np.concatenate([seeds, np.array(list(value), np.int64).view(U)]))
    ranked = sorted(np.flatnonzero(may_vote).tolist(), key=lambda j: (vocabulary[j] not in seeds, -value.get(int(vocabulary[j].view(np.int64)), 0), j))
    found = held(rows, vocabulary).collect()
    x = np.zeros((len(found), len(vocabulary)), np.float32)
    for i, r in enumerate(found):
        x[i, r.at] = 1
    y = np.array([r.y for r in found], int)
    discard(rows)
    if n_pos:
        # A voter must mostly be right alone, the lexicon and the shapes too: one that is as often wrong would make itself right.
        rates = [(x[y == c].sum(0) + 0.5) / ((y == c).sum() + 1) for c in (0, 1)]
        ranked = [j for j in ranked if prior * rates[1][j] >= PRECISION / (1 - PRECISION) * (1 - prior) * rates[0][j]] or ranked
    at = np.sort(np.array(ranked[:N_VOTERS]))
    voters, v = vocabulary[at], x[:, at].astype(np.float64)
    if n_pos:
        # Rates by label, at the classes' shares.
        n = np.array([prior, 1 - prior]) * min(n_pos / prior, n_neg / (1 - prior) if n_neg else np.inf)
        weight = np.where(y == 1, n[0] / n_pos, n[1] / max(n_neg, 1))
        hits = [weight[y == c] @ v[y == c] for c in (0, 1)]
        quiet = weight * ~v.any(axis=1)
        start = LabelModel.of(hits[1], hits[0] + hits[1], np.array([quiet[y == 1].sum(), quiet[y == 0].sum()]), n, prior, v.T @ (v * weight[:, None]))
    else:
        # Without a toxic label words vote alone: each speaks for toxicity, silence against it.
        lexicon = np.isin(voters, seed_hashes())
        start = LabelModel(np.where(lexicon, 0.2, 0.02), np.where(lexicon, 0.01, 0.02), (0.2, 0.9), prior, np.eye(len(voters)))
    patterns = checkpointed(held(docs.select(F.lit(0).alias("y"), "text"), voters).groupBy(F.col("at").alias("votes")).agg(F.count("*").alias("n")))
    model = label_model(patterns, start, anchor=ANCHOR)
    discard(patterns)
    if not len(found):
        each = np.zeros(len(vocabulary))
        each[at] = model.each + model.loud
        return vocabulary, np.append(each, model.start + model.quiet)
    # Labelled rows were drawn by class; weigh them back to the classes' shares.
    weights = np.where(y == 1, prior / max(n_pos, 1), (1 - prior) / max(n_neg, 1))
    # Where every voter abstains the model has nothing to say, and the row's own label stands.
    return vocabulary, logistic(x, np.where(v.any(axis=1), model.posterior(v), y), weights)


def toxicity(docs: DataFrame, labels: DataFrame, holdout: int = 5, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``score`` is the classifier's probability; an empty or null text scores
    its intercept. ``held_out`` is null for a null id, which is never learned
    from. Labels other than 0 and 1 are ignored; an id labelled twice counts
    as toxic if any label says so; without labels the seed lexicon votes
    alone. Only id and text of ``docs`` are read.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)
    vocabulary, w = fit(docs, labels, holdout=holdout, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores(part.column(1), vocabulary, w))], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", "text", (crc_mod("doc_id", holdout) == 0).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scores(column: pa.Array, vocabulary: np.ndarray, w: np.ndarray) -> np.ndarray:
    words = Words(column, lower=True, letters=True)
    n = len(words.count)
    doc = words.doc_of()
    # A bit table tells most features apart from the vocabulary at once.
    table = np.zeros(1 << 16, bool)
    table[(vocabulary >> U(48)).astype(np.int64)] = True
    docs, at = [], []
    for h in word_features(words):
        maybe = np.flatnonzero(table[(h >> U(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
        hit = vocabulary[where] == h[maybe]
        docs.append(doc[maybe[hit]])
        at.append(where[hit])
    i, which = np.nonzero(shapes(words, raw_text(column)[0]))
    docs.append(i)
    at.append(np.searchsorted(vocabulary, shape_hashes())[which])
    pair = np.unique(np.concatenate(docs) * len(vocabulary) + np.concatenate(at))
    total = np.bincount(pair // len(vocabulary), weights=w[:-1][pair % len(vocabulary)], minlength=n) + w[-1]
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns stay, in one pass over the text."""
    vocabulary, w = fit(texts(docs, id_col=id_col, text_col=text_col), labels, **params)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                keep = scores(part.column(at), vocabulary, w) < threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
