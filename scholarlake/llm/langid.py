"""Language identification by a linear-chain conditional random field.

The words of a text are a chain whose labels are languages. Emissions sum
hashed features of a word - itself (a learned lexicon), beginnings, endings
and character trigrams - and transitions are learned, so a text that switches
languages is labelled word by word. Forward-backward runs over all chains of a
batch at once: chains are cut into segments whose matrix products give the
messages at the cuts, then all segments run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.llm.tools import crc_mod, texts
from scholarlake.llm.words import BASE_INV, U, Words, mix, powers, salted, slices

BUCKETS = 1 << 16
#: Words in a segment of a chain.
SEGMENT = 96
SWITCH = 0.02
UNKNOWN = "und"


class Chains:
    """Hashed features of the words of a run of texts."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column, lower=True, letters=True)
        self.first, self.count = w.first, w.count
        self.word_features = [(salted(w.hash, 1) % U(BUCKETS)).astype(np.int32)]
        for n in (2, 3):
            self.word_features.append((salted(w.prefix_hash(n), 10 + n) % U(BUCKETS)).astype(np.int32))
            tail = (w.total[w.end] - w.total[np.maximum(w.end - n, w.start)]) * powers_at(w, np.maximum(w.end - n, w.start))
            self.word_features.append((salted(mix(tail), 20 + n) % U(BUCKETS)).astype(np.int32))
        data = w.data.astype(U)
        if len(data) >= 3:
            code = data[:-2] | data[1:-1] << U(8) | data[2:] << U(16)
            self.grams = (salted(code, 30) % U(BUCKETS)).astype(np.int32)
        else:
            self.grams = np.zeros(0, np.int32)
        self.lo = np.minimum(w.start, len(self.grams))
        self.hi = np.maximum(np.minimum(w.end - 2, len(self.grams)), self.lo)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores (words x languages)."""
        out = weights[self.word_features[0]]
        for f in self.word_features[1:]:
            out = out + weights[f]
        # Trigram scores of a word: differences of running sums (in doubles, as they grow with the text).
        total = np.zeros((len(self.grams) + 1, weights.shape[1]))
        np.cumsum(weights[self.grams], axis=0, out=total[1:])
        return out + (total[self.hi] - total[self.lo])

    def spread(self, gradient: np.ndarray) -> np.ndarray:
        """Gradient of the weights from one of the emissions."""
        k = gradient.shape[1]
        out = np.zeros((BUCKETS, k))
        n = self.hi - self.lo
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.lo[row]
        for j in range(k):
            g = gradient[:, j]
            for f in self.word_features:
                out[:, j] += np.bincount(f, weights=g, minlength=BUCKETS)
            out[:, j] += np.bincount(self.grams[at], weights=g[row], minlength=BUCKETS)
        return out


def powers_at(words: Words, at: np.ndarray) -> np.ndarray:
    return powers(BASE_INV, len(words.data) + 1)[at]


def forward_backward(scores: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward, backward, emissions), rows per word, all scaled; ``transition``: positive weights."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if n else scores
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    if not n:
        return forward, forward, backward, e
    pieces = -(-count // SEGMENT)
    chain = np.repeat(np.arange(len(count)), pieces)
    piece = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[chain] + piece * SEGMENT
    size = np.minimum(SEGMENT, first[chain] + count[chain] - start)
    order = np.argsort(-size, kind="stable")
    start, size, chain, piece = start[order], size[order], chain[order], piece[order]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")
    # Matrix products over segments that are followed by another.
    product = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
    for t in range(size[0]):
        m = live[t]
        p = (product[:m] @ transition) * e[start[:m] + t][:, None, :]
        product[:m] = p / p.sum(axis=(1, 2), keepdims=True)
    into = np.full((len(start), k), 1.0 / k)
    after = np.ones((len(start), k))
    place = np.full((len(count), max(1, pieces.max())), -1)
    place[chain, piece] = np.arange(len(start))
    for s in range(1, place.shape[1]):
        rows = place[:, s]
        rows, before = rows[rows >= 0], place[:, s - 1][rows >= 0]
        v = np.einsum("ij,ijk->ik", into[before], product[before])
        into[rows] = v / v.sum(axis=1, keepdims=True)
    for s in range(place.shape[1] - 1, 0, -1):
        rows = place[:, s]
        rows, before = rows[rows >= 0], place[:, s - 1][rows >= 0]
        v = np.einsum("ijk,ik->ij", product[rows], after[rows])
        after[before] = v / v.sum(axis=1, keepdims=True)
    # Messages: ``into`` before the transition to the first word, ``after`` past the last.
    a = into.copy()
    for t in range(size[0]):
        m = live[t]
        v = (a[:m] @ transition) * e[start[:m] + t]
        a[:m] = v / v.sum(axis=1, keepdims=True)
        forward[start[:m] + t] = a[:m]
    b = after.copy()
    for t in range(size[0] - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        backward[at] = b[:m]
        v = (b[:m] * e[at]) @ transition.T
        b[:m] = v / v.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward, e


def train(column: pa.Array, labels: np.ndarray, k: int, epochs: int = 6, rate: float = 0.5, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition weights in logs) by AdaGrad on the chains' likelihood, a group of texts a step."""
    prior = np.log(np.full((k, k), SWITCH / max(1, k - 1)) + np.eye(k) * (1 - SWITCH - SWITCH / max(1, k - 1)))
    weights, trans = np.zeros((BUCKETS, k), np.float32), prior.copy()
    seen_w, seen_t = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1.0)
    batch = pa.RecordBatch.from_arrays([pa.array(labels), column], names=["y", "text"])
    groups = [(Chains(part.column(1)), part.column(0).to_numpy()) for part in slices(batch, limit=1 << 18)]
    for _ in range(epochs):
        for chains, y in groups:
            p, forward, backward, e = forward_backward(chains.emissions(weights), chains.first, chains.count, np.exp(trans))
            if not len(p):
                continue
            truth = np.repeat(y, chains.count)
            # A text counts by the root of its length.
            share = np.repeat(1 / np.sqrt(np.maximum(chains.count, 1)), chains.count) / len(y)
            g = -p
            g[np.arange(len(p)), truth] += 1
            dw = chains.spread(g * share[:, None]) - l2 * weights
            seen_w += dw**2
            weights += (rate * dw / np.sqrt(seen_w)).astype(np.float32)
            inner = np.ones(len(p), bool)
            inner[chains.first[:-1][chains.count > 0]] = False
            t = np.flatnonzero(inner)
            pair = forward[t - 1][:, :, None] * np.exp(trans)[None] * (e[t] * backward[t])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            dt = -(pair * share[t][:, None, None]).sum(axis=0)
            np.add.at(dt, (truth[t], truth[t]), share[t])
            # Texts are labelled as a whole: the prior keeps switches possible.
            dt -= 1.0 * (trans - prior)
            seen_t += dt**2
            trans += 0.1 * dt / np.sqrt(seen_t)
    return weights, trans


def drawn(known: DataFrame, lang_col: str, n_rows: int) -> list:
    """(doc_id, lang, octets) of at most ``n_rows`` texts (or one a language, if there are more languages), in the order of a hash of the id.

    Half of the rows are dealt evenly over the languages, the rest come in the shares that languages have.
    """
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(schema)]).group_by(["lang", "h", "doc_id"]).aggregate([("n", "max")]).rename_columns(schema.names)
            held = held.sort_by([("lang", "ascending"), ("h", "ascending"), ("doc_id", "ascending")])
            code = held.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
            place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
            held = held.take(pa.array(np.flatnonzero(place < n_rows)))
        yield from held.combine_chunks().to_batches()

    rows = known.select(F.col(lang_col).alias("lang"), F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").cast("long").alias("n"))
    some = rows.mapInArrow(best, "lang string, h long, doc_id long, n long").groupBy("lang", "h", "doc_id").agg(F.max("n").alias("n"))
    turns = some.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).persist()
    try:
        k = turns.filter("turn = 1").count()
        quota = max(1, n_rows // (2 * max(1, k)))
        return turns.orderBy(F.least("turn", F.lit(quota + 1)), "h", "doc_id", "lang").limit(max(n_rows, k)).collect()
    finally:
        turns.unpersist()


def level(sizes: np.ndarray, budget: int) -> int:
    """The largest size at which all may be cut so that their sum is at most ``budget``; 1 at least."""
    at, left = np.sort(sizes), budget
    for i, size in enumerate(at.tolist()):
        if size * (len(at) - i) > left:
            return max(1, left // (len(at) - i))
        left -= size
    return max(1, int(at[-1]) if len(at) else 1)


def fit(docs: DataFrame, lang_col: str, holdout: tuple[int, int], n_rows: int = 3000, n_bytes: int = 6 << 20) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, transitions) from at most ``n_rows`` labelled texts, half of them dealt evenly over the languages, and ``n_bytes``.

    Where the texts are longer than ``n_bytes``, the longest are cut to one
    length, an excerpt from a place by a hash of the id. So no text keeps
    another out: each gives at least min(its size, n_bytes / n_rows).
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).filter(crc_mod("doc_id", holdout[0]) != holdout[1])
    chosen = drawn(known, lang_col, n_rows)
    if not chosen:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0))
    cut = level(np.array([r.n for r in chosen]), n_bytes)
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in chosen], "doc_id long, lang string")
    # As many characters as fill the cut at the text's mean bytes a character.
    octets, chars = F.octet_length("text"), F.char_length("text")
    take = F.when(octets <= cut, chars).otherwise(F.greatest(F.lit(1), F.floor(chars * F.lit(float(cut)) / octets))).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit(7)), (chars - take + 1).cast("long")).cast("int") + 1
    # At most one row for each chosen text.
    found = known.select("doc_id", F.col(lang_col).alias("lang"), "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", F.substring("text", start, take).alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = found.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs = sorted(set(rows.column("lang").to_pylist()))
    y = np.searchsorted(langs, rows.column("lang").to_pylist())
    # Mixed order: neighbours by id may share a source.
    order = np.argsort(mix(np.arange(len(y), dtype=U)))
    column = rows.column("text").combine_chunks().take(pa.array(order))
    return langs, *train(column, y[order], len(langs))


def language(docs: DataFrame, lang_col: str = "lang", holdout: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, lang_shares (language -> share of words).

    Learns from rows with a language whose crc32(id) modulo ``holdout[0]`` is
    not ``holdout[1]``. ``lang_pred`` is the language of the largest expected
    share of words (ties: first by name), ``score`` that share. A null text, or
    one without a letter, is `und` with score 0, as is every text if no row is
    labelled. Rows with a null id are scored, never learned from.
    """
    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, weights, trans = fit(both.withColumn("text", F.coalesce("text", F.lit(""))), "lang", holdout, **params)
    k, step = len(langs), np.exp(trans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                chains = Chains(part.column(1))
                n = part.num_rows
                share = np.zeros((n, k))
                if k:
                    p = forward_backward(chains.emissions(weights), chains.first, chains.count, step)[0]
                    doc = chains.words.doc_of()
                    for j in range(k):
                        share[:, j] = np.bincount(doc, weights=p[:, j], minlength=n) / np.maximum(chains.count, 1)
                letters = lettered(chains.words, part.column(1))
                best = share.argmax(axis=1) if k else np.zeros(n, int)
                known = letters & (chains.count > 0) & (k > 0)
                pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                score = np.where(known, share[np.arange(n), best] if k else 0.0, 0.0)
                flat = pa.array(share.ravel())
                shares = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(langs * n, pa.string()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), shares], names=["doc_id", "held_out", "lang_pred", "score", "lang_shares"])

    plain = both.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", holdout[0]) == holdout[1]).alias("held_out"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, lang_shares map<string,double>")


def lettered(words: Words, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    n = len(words.count)
    of = np.repeat(np.arange(n), np.diff(words.offsets))
    out = np.bincount(of[(words.data >= 97) & (words.data <= 122)], minlength=n) > 0
    for i in np.flatnonzero(~out & (words.count > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out
