"""Language-model scoring with a hashed maximum-entropy model.

A class-factored softmax: the class of the next word is predicted from hashed
n-gram and skip features of the words before it. So is the word inside its
class, by a tree of binary decisions over bits of the word's hash: a decision
starts at the odds of the smoothed counts below it, and hashed features of
(context, decision) correct it; words of one leaf share its probability by
their counts. Classes are the end of a text, two copies (the word before,
the word before that), and word forms by a hash of their last letters, so that
a word's class needs no table. A copy has no probability where there is no
word to copy. Training runs over all training documents:
every partition takes AdaGrad steps over its texts from common weights, and
the weights are averaged over partitions after each round, those of classes by
the number of tokens, those of decisions over the partitions that met them; every round takes its own share of the documents. Counts of all words
are looked up by blocks of documents (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.blocks import Blocks, packed, split, text_batch, unpacked
from scholarlake.llm.tools import checkpointed, crc_mod, texts
from scholarlake.llm.words import BASE_INV, U, Words, mix, powers, salted, slices

CLASSES, FORMS = 16, 13
END, COPY_1, COPY_2 = 0, 1, 2
END_KEY = U(1)
BUCKETS = 1 << 14
#: Kinds of features of a context.
KINDS = 5
STEP_TOKENS = 16_384
#: Rows whose probabilities are worked out at a time, so that they stay in a core's cache.
ROWS = 4096
ROUNDS = 2
#: Weight rows that travel together when partitions are averaged.
CHUNKS = 64
ADD = 0.1
#: Levels of decisions below a class.
DEPTH = 11
#: Kinds of features of a decision: the word before, the form of the word but one before.
WORD_KINDS = (1, 2)
#: Words of a step: a share of the decision weights, so that a step over all of them costs a word alike.
STEP_SHARE = 64
#: Bits of the number of decision weights, least and most; in between it is that of the training tokens.
WORD_BITS = (14, 20)


class Events:
    """The tokens (words, then an end) of a run of texts; `contexts` adds what comes before each."""

    def __init__(self, column: pa.Array):
        w = Words(column, lower=True)
        n = len(w.count)
        #: Token rows: the words of a text and its end.
        self.count = w.count + 1
        self.first = w.first[:-1] + np.arange(n)
        self.n = len(w.hash) + n
        self.is_end = np.zeros(self.n, bool)
        self.is_end[self.first + w.count] = True
        word_rows = np.flatnonzero(~self.is_end)
        self.key = np.full(self.n, END_KEY)
        self.key[word_rows] = w.hash
        tail = np.maximum(w.end - 3, w.start)
        ending = mix((w.total[w.end] - w.total[tail]) * powers(BASE_INV, len(w.data) + 1)[tail])
        self.form = np.zeros(self.n, U)
        self.form[word_rows] = ending
        self.form_class = np.full(self.n, END, np.uint8)
        self.form_class[word_rows] = (salted(ending, 3) % U(FORMS)).astype(np.uint8) + 3

    def contexts(self) -> Events:
        place = np.arange(self.n) - np.repeat(self.first, self.count)

        def before(x: np.ndarray, k: int) -> np.ndarray:
            out = np.roll(x, k)
            out[place < k] = 0
            return out

        back_1, back_2 = before(self.key, 1), before(self.key, 2)
        hashed = (salted(before(self.form, 1), 1), salted(back_1, 2), salted(before(self.form, 2), 3), salted(mix(back_1) + back_2, 4), salted(before(self.form, 3), 5))
        self.features = np.stack([(h % U(BUCKETS)).astype(np.uint16) for h in hashed], axis=1)
        self.word_features = np.stack([(hashed[j] >> U(32)).astype(np.uint32) for j in WORD_KINDS])
        self.same_1 = (back_1 == self.key) & ~self.is_end
        self.same_2 = (back_2 == self.key) & ~self.is_end
        #: Words before a token, two at most.
        self.before = np.minimum(place, 2).astype(np.uint8)
        return self


def class_probabilities(weights: np.ndarray, features: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probabilities of the classes from hashed features and the number of words ``before`` (0, 1, 2 or more)."""
    out = np.empty((len(features), CLASSES), np.float32)
    for lo in range(0, len(features), ROWS):
        f, b, z = features[lo : lo + ROWS], before[lo : lo + ROWS], out[lo : lo + ROWS]
        np.take(weights, f[:, 0], axis=0, out=z, mode="clip")
        for j in range(1, f.shape[1]):
            z += weights.take(f[:, j], axis=0, mode="clip")
        # Far beyond what training reaches, and safe for exp in single precision.
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        z[b < 1, COPY_1] = 0
        z[b < 2, COPY_2] = 0
        z /= z.sum(axis=1, keepdims=True)
    return out


def start_weights() -> np.ndarray:
    return np.zeros((BUCKETS, CLASSES), np.float32)


def descend(weights: np.ndarray, seen: np.ndarray, events: Events, rate: float) -> None:
    """AdaGrad steps over the events; a word that could be a copy counts as one."""
    label = np.where(events.same_1, COPY_1, np.where(events.same_2, COPY_2, events.form_class))
    for lo in range(0, events.n, STEP_TOKENS):
        f, y = events.features[lo : lo + STEP_TOKENS], label[lo : lo + STEP_TOKENS]
        g = class_probabilities(weights, f, events.before[lo : lo + STEP_TOKENS])
        g[np.arange(len(y)), y] -= 1
        by_class = np.ascontiguousarray(g.T, np.float64)
        total = np.zeros((CLASSES, BUCKETS))
        for j in range(f.shape[1]):
            at = f[:, j].astype(np.intp)
            for c in range(CLASSES):
                total[c] += np.bincount(at, weights=by_class[c], minlength=BUCKETS)
        step = (total / len(y)).astype(np.float32).T
        seen += step**2
        weights -= rate * step / np.sqrt(seen)


def token_probabilities(model: tuple, events: Events, c: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The model's probability of every token, from training counts ``c`` and the classes' tokens and distinct words.

    Over the known words, one unknown word a class and the end they sum to 1.
    """
    weights, table, tree = model
    inside = tokens + ADD * (words + 1)
    p = np.zeros(events.n)
    for lo in range(0, events.n, 1 << 15):
        rows = slice(lo, lo + (1 << 15))
        q = class_probabilities(weights, events.features[rows], events.before[rows])
        kind = events.form_class[rows]
        own = q[np.arange(len(kind)), kind].astype(np.float64)
        # An unknown word counts once a class, context-free; a known one by its path, then its share of the leaf.
        own *= np.where(kind == END, 1.0, ADD / inside[kind])
        known = np.flatnonzero((kind != END) & (c[rows] > 0))
        if len(known):
            k, code = kind[known], code_of(events.key[rows][known])
            path = tree.path(table, events.word_features[:, known + lo], k, code)
            own[known] *= (inside[k] / ADD - 1) * path * (c[rows][known] + ADD) / tree.leaf[k.astype(np.int32) << DEPTH | code]
        # A copy of a word before adds to the word's probability.
        own += np.where(events.same_1[rows], q[:, COPY_1], 0.0) + np.where(events.same_2[rows], q[:, COPY_2], 0.0)
        p[rows] = own
    return p


def code_of(key: np.ndarray) -> np.ndarray:
    """The path of each word below its class."""
    return (salted(key, 9) >> U(64 - DEPTH)).astype(np.int32)


class Tree:
    """Decisions below the classes, from the training tokens and distinct words of each leaf (class, path)."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray):
        self.leaf = tokens + ADD * words
        mass, odds, both = self.leaf, [], []
        for _ in range(DEPTH):
            left, right = mass[0::2], mass[1::2]
            both.append((left > 0) & (right > 0))
            odds.append(np.where(both[-1], np.log(np.maximum(right, ADD)) - np.log(np.maximum(left, ADD)), 0).astype(np.float32))
            mass = left + right
        #: Nodes by level from the classes down; a decision is open if both sides hold words.
        self.odds, self.open = np.concatenate(odds[::-1]), np.concatenate(both[::-1])
        self.salt = (salted(np.arange(len(self.odds), dtype=U), 41) >> U(32)).astype(np.uint32)

    def decisions(self, table: np.ndarray, features: np.ndarray, kind: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, weights' places by kind of feature, log odds of the right side, side taken), level by level."""
        shift = np.uint32(32 - (len(table).bit_length() - 1))
        kind = kind.astype(np.int32)
        for level in range(DEPTH):
            node = CLASSES * ((1 << level) - 1) + (kind << level | code >> (DEPTH - level))
            live = self.open[node]
            rows = slice(None)
            if not live.all():
                rows = np.flatnonzero(live)
                if not len(rows):
                    continue
                node = node[rows]
            at = features[:, rows] ^ self.salt[node]
            at *= np.uint32(0x9E3779B1)
            at >>= shift
            at = at.astype(np.intp)
            z = self.odds[node]
            for a in at:
                z += table.take(a, mode="clip")
            # Safe for a product of all levels.
            yield rows, at, np.clip(z, -30, 30, out=z), (code[rows] >> (DEPTH - 1 - level) & 1).astype(np.float32)

    def path(self, table: np.ndarray, features: np.ndarray, kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Probability of each word's leaf in its class."""
        out = np.ones(len(kind))
        for rows, _, z, side in self.decisions(table, features, kind, code):
            z *= 1 - 2 * side
            np.exp(z, out=z)
            z += 1
            out[rows] /= z
        return out

    def descend(self, table: np.ndarray, seen: np.ndarray, events: Events, rate: float) -> None:
        """AdaGrad steps over the words that could not be copies."""
        words = np.flatnonzero(~(events.is_end | events.same_1 | events.same_2))
        size = len(table) // STEP_SHARE
        for lo in range(0, len(words), size):
            rows = words[lo : lo + size]
            step = np.zeros(len(table), np.float32)
            for _, at, z, side in self.decisions(table, events.word_features[:, rows], events.form_class[rows], code_of(events.key[rows])):
                g = 1 / (1 + np.exp(-z)) - side
                for a in at:
                    np.add.at(step, a, g)
            seen += step**2
            table -= rate * step / np.sqrt(seen)


def train(docs: DataFrame, tree: Tree, n_tokens: int, rounds: int = ROUNDS, rate: float = 0.25, word_rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(class weights, decision weights) from all of ``docs``: round r takes the documents whose hash modulo ``rounds`` is r."""
    weights = start_weights()
    table = np.zeros(1 << min(max(n_tokens.bit_length(), WORD_BITS[0]), WORD_BITS[1]), np.float32)
    size, wide = BUCKETS // CHUNKS, len(table) // CHUNKS
    spark = docs.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, table, tree))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, begin, tree = shared.value
            own, seen, n = start.copy(), np.full((BUCKETS, CLASSES), 1e-6, np.float32), 0
            other, seen_other = begin.copy(), np.ones(len(begin), np.float32)
            for batch in batches:
                for part in slices(batch):
                    events = Events(part.column(1)).contexts()
                    descend(own, seen, events, rate)
                    tree.descend(other, seen_other, events, word_rate)
                    n += events.n
            if n:
                moved, met = other - begin, (seen_other > 1).astype(np.uint16)
                for i in range(CHUNKS):
                    part = slice(i * wide, (i + 1) * wide)
                    yield sums(i, n, own[i * size : (i + 1) * size] * n, moved[part], met[part])

        def sums(chunk: int, n: int, w: np.ndarray, moved: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
            made = [pa.array([x.tobytes()], pa.binary()) for x in (w.astype(np.float32), moved.astype(np.float32), met)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), *made], names=["chunk", "n", "w", "moved", "met"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                for chunk, n, w, moved, met in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    total = held.setdefault(chunk, [0, np.zeros(size * CLASSES), np.zeros(wide), np.zeros(wide, np.uint32)])
                    total[0] += n
                    total[1] += np.frombuffer(w, np.float32)
                    total[2] += np.frombuffer(moved, np.float32)
                    total[3] += np.frombuffer(met, np.uint32 if len(met) == 4 * wide else np.uint16)
            for chunk, total in held.items():
                yield sums(chunk, *total)

        schema = "chunk int, n long, w binary, moved binary, met binary"
        some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == turn)
        # As many tasks as pay for sending the weights; at least one a core.
        some = some.coalesce(max(spark.sparkContext.defaultParallelism, n_tokens // len(table)))
        # Two steps of sums, so that no task adds up all partitions.
        parts = some.mapInArrow(run, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(16)))
        summed = parts.repartition("chunk", "lane").select("chunk", "n", "w", "moved", "met").mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema)
        found = summed.collect()
        for r in found:
            weights[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.w, np.float32).reshape(size, CLASSES) / r.n
            table[r.chunk * wide : (r.chunk + 1) * wide] += np.frombuffer(r.moved, np.float32) / np.maximum(np.frombuffer(r.met, np.uint32), 1)
        shared.unpersist()
    return weights, table


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

def lm_scores(docs: DataFrame, holdout: int = 10, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id) modulo ``holdout`` is not 0. Tokens are
    A-Z lower-cased words and one end. ``base_score``: smoothed unigram log10
    probability; ``score``: the model's, which sums to 1 over the known words,
    one unknown word per class, and the end. A null text is empty: its only
    token is the end. A row with a null id is held out. Repeated rows count
    each; without training rows every score uses zero counts.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col).withColumn("held_out", F.coalesce(crc_mod("doc_id", holdout) == 0, F.lit(True)))
    blocks = Blocks(docs)
    n = blocks.n
    bucket_of = lambda key: ((key >> U(32)) % U(n)).astype(np.int64)

    def events_of(table: pa.Table) -> tuple[list[Events], np.ndarray]:
        """The block's events, and which documents are held out."""
        return [Events(part.column(1)) for part in slices(text_batch(table))], table.column("held_out").to_numpy()

    def vocabulary(parts: list[Events], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, their training count, their class, tokens of each, the tokens in the words' order) of a block."""
        key, kind = np.concatenate([e.key for e in parts]), np.concatenate([e.form_class for e in parts])
        learn = np.repeat(~held, np.concatenate([e.count for e in parts]))
        order = np.argsort(key)
        key = key[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[cut], np.add.reduceat(learn[order].astype(np.uint32), cut), kind[order[cut]], np.diff(cut, append=len(key)), order

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        key, count, kind, _, _ = vocabulary(*events_of(table))
        for b, columns, _ in split(bucket_of(key), key, count, kind):
            yield b, packed(*columns)

    def answer(payloads: list[list[np.ndarray]]) -> Iterator[tuple]:
        keys = np.concatenate([p[0] for p in payloads])
        names, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([p[1] for p in payloads]), minlength=len(names)).astype(np.int64)
        kind = np.concatenate([p[2] for p in payloads])[first]
        # Totals of the bucket by leaf go with the first answer: tokens and distinct words seen in training.
        known = total > 0
        leaf, back = np.unique((kind.astype(np.int32) << DEPTH | code_of(names))[known], return_inverse=True)
        tokens = np.bincount(back, weights=total[known], minlength=len(leaf)).astype(np.int64)
        words = np.bincount(back, minlength=len(leaf))
        at = 0
        for i, p in enumerate(payloads):
            rows = inverse[at : at + len(p[0])]
            at += len(p[0])
            yield (total[rows].astype(np.uint32) if total.max(initial=0) < 1 << 32 else total[rows], *((leaf, tokens, words) if i == 0 else ()))

    answered = checkpointed(blocks.answer(blocks.ask(ask, 1), answer, 1))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, CLASSES << DEPTH), np.int64)
        for batch in batches:
            for payload in batch.column(0):
                arrays = unpacked(payload.as_py())
                if len(arrays) == 4:
                    both[:, arrays[1]] += np.stack(arrays[2:])
        leaf = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(both[0, leaf]), pa.array(both[1, leaf])], names=["k", "tokens", "words"])

    # One row a leaf at most.
    sums = answered.select("payload").mapInArrow(totals, "k long, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    leaves = np.zeros((2, CLASSES << DEPTH), np.int64)
    leaves[:, sums.column("k").to_numpy()] = np.stack([sums.column("tokens").to_numpy(), sums.column("words").to_numpy()])
    tokens, words = leaves.reshape(2, CLASSES, -1).sum(axis=2)
    n_all, v_all = int(tokens.sum()), int(words.sum())
    tree = Tree(*leaves)
    weights, table = train(docs.filter("not held_out").select("doc_id", "text"), tree, n_all, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((weights, table, tree))

    def finish(table: pa.Table, answers: dict) -> pa.Table:
        parts, held = events_of(table)
        key, _, _, times, order = vocabulary(parts, held)
        count = np.zeros(len(key))
        for b, _, rows in split(bucket_of(key), key):
            count[rows] = answers[1][b][0]
        counts = np.empty(len(order))
        counts[order] = np.repeat(count, times)
        base_floor = np.log10(n_all + ADD * (v_all + 1))
        ids, out, at, first = table.column("doc_id").combine_chunks(), [], 0, 0
        while parts:
            events = parts.pop(0).contexts()
            c = counts[first : first + events.n]
            first += events.n
            p = token_probabilities(shared.value, events, c, tokens, words)
            unigram = np.log10(c + ADD) - base_floor
            sums = [np.add.reduceat(x, events.first) for x in (unigram, np.log10(np.maximum(p, 1e-300)), (c > 0).astype(np.int64))]
            n_docs = len(events.count)
            rows = slice(at, at + n_docs)
            at += n_docs
            out.append(pa.RecordBatch.from_arrays([ids[rows], pa.array(held[rows]), pa.array(events.count), pa.array(sums[2]), pa.array(np.full(n_docs, n_all)), pa.array(sums[0]), pa.array(sums[1])], schema=OUT_ARROW))
        return pa.Table.from_batches(out, schema=OUT_ARROW)

    return blocks.finish(answered, finish, OUT, OUT_ARROW)
