import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholarlake.llm.langid import fit, language, level
from scholarlake.llm.lm import ADD, BUCKETS, CLASSES, DEPTH, END, WORD_KINDS, Events, Tree, code_of, lm_scores, start_weights, token_probabilities
from scholarlake.llm.mixing import fit_rates, label_domains, mix, rates
from scholarlake.llm.toxicity import LabelModel, drop_toxic, label_model, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.0, "x") for i, t, lang in rows], DOCS)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def toxic_corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Idiot,", "scum", "vilest" + rng.choice("abcdefgh"), "vilestor."])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, None), (5001, "", None), (None, "you idiot", None), (5002, "fine " * 60_000, "en")]
    lab = spark.createDataFrame([*labels, (5002, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(frame(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in got if r.doc_id is not None)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == by[5002].predicted == 0 and by[None].predicted == 1


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity(frame(spark, [(1, "what an idiot and moron", "en"), (2, "kind words here", "en")] + [(i, f"plain text {i}", "en") for i in range(3, 60)]), none)
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[1] > by[2]
    assert toxicity(frame(spark, []), none).collect() == []


def test_drop_toxic_keeps_columns_and_clean_rows(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, rows)
    left = drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    truth = {i: t for i, _, t in labels}
    assert sum(i in ids for i, t in truth.items() if not t) / sum(not t for t in truth.values()) > 0.98
    assert sum(i in ids for i, t in truth.items() if t) / sum(truth.values()) < 0.05


def lang_corpus(n=400, seed=2):
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "on", "and", "re"], "de": ["sch", "ung", "ich", "ei", "ver"], "fr": ["eau", "oi", "tre", "elle", "é"]}
    make = lambda lang, k: [rng.choice(syllables[lang]) + rng.choice(syllables[lang]) + rng.choice(syllables[lang]) for _ in range(k)]
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        words = make(lang, rng.randrange(3, 120))
        if i % 9 == 0:
            words[1:1] = make("de", len(words) // 4)
        rows.append((i, " ".join(words), lang))
    return rows, make


def test_language_on_held_out_rows(spark):
    rows, make = lang_corpus()
    mixed = " ".join(make("en", 60) + make("fr", 40))
    extra = [(9000, None, "en"), (9001, "", "de"), (9002, "123 ... 45", "fr"), (9003, mixed, None), (9004, "scheiung " * 20_000, None), (None, "eauoitre elleeautre", None)]
    got = language(frame(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang in rows}
    held = [by[i].lang_pred == lang for i, lang in truth.items() if crc(i, 4) == 2]
    assert all(by[i].held_out == (crc(i, 4) == 2) for i in truth) and sum(held) / len(held) > 0.97
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and by[9004].lang_pred == "de" and by[None].lang_pred == "fr"
    # Code-switched: the words are labelled apart.
    assert by[9003].lang_pred == "en" and abs(by[9003].lang_shares["fr"] - 0.4) < 0.1
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_labels_or_rows(spark):
    assert [r.lang_pred for r in language(frame(spark, [(1, "some words", None)])).collect()] == ["und"]
    assert language(frame(spark, [])).collect() == []


def test_language_learns_past_a_long_text_and_from_rare_languages(spark):
    rows, make = lang_corpus()
    free = [i for i in range(20_000, 20_400) if crc(i, 4) != 2]
    long_rows = [(i, " ".join(make("fr", 20_000)), "fr") for i in free[:40]]
    rare = [(i, " ".join(f"zwo{c}mij" for c in "abcdefgh"), "nl") for i in free[40:43]]
    docs = frame(spark, [*rows, *long_rows, *rare, *long_rows[:1]])
    langs, weights, _ = fit(docs.select("doc_id", "text", "lang"), "lang", (4, 2), n_rows=100, n_bytes=40_000)
    assert langs == ["de", "en", "fr", "nl"] and weights.shape[1] == 4
    probes = [(90_000, " ".join(make("en", 50)), None), (90_001, " ".join(make("de", 50)), None), (90_002, "zwoamij zwohmij zwocmij", None)]
    got = {r.doc_id: r.lang_pred for r in language(docs.union(frame(spark, probes)), n_rows=100, n_bytes=40_000).collect()}
    assert [got[i] for i, _, _ in probes] == ["en", "de", "nl"]
    # More languages than rows: each is learned.
    many = [(i, f"{a}x {a}y", a * 2) for i, a in zip(free, "abcdefgh")]
    assert len(fit(frame(spark, many).select("doc_id", "text", "lang"), "lang", (4, 2), n_rows=3)[0]) == 8


def test_level_fills_the_budget():
    assert level(np.array([10, 1000, 20]), 100) == 70 and level(np.array([5, 5]), 100) == 5
    assert level(np.array([8 << 20, 100, 100]), 300) == 100 and level(np.array([9, 9, 9]), 1) == 1


def test_lm_scores(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        style = i % 2
        rows.append((i, " ".join(f"{'ab'[style]}{rng.randrange(60)}{'xy'[style]}" for _ in range(rng.randrange(0, 80))), "en"))
    rows += [(1000, None, None), (1001, "New words Here", None), (1002, "same " * 40_000, None), (None, "A1x", None), (7, "a1x", None)]
    got = lm_scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] + [None]
    counts = Counter(w for i, t, _ in rows if i is not None and crc(i, 10) != 0 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i is not None, i or 0), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for i, t, _ in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(frame(spark, [])).collect() == []


def test_lm_is_a_distribution():
    """Over all continuations of a context, known words, one unknown word a class and the end sum to 1."""
    rng = np.random.default_rng(5)
    vocabulary = [f"u{chr(97 + i % 26)}{i}" for i in range(300)]
    seen = Events(pa.array([" ".join(rng.choice(vocabulary, 4000))]))
    names, first, counts = np.unique(seen.key, return_index=True, return_counts=True)
    kind = seen.form_class[first]
    leaf = np.where(kind == END, 0, kind.astype(np.int64) << DEPTH | code_of(names))
    tokens, words = (np.bincount(leaf, weights=w, minlength=CLASSES << DEPTH) for w in (counts, np.ones(len(names))))
    per_class = tokens.reshape(CLASSES, -1).sum(axis=1), words.reshape(CLASSES, -1).sum(axis=1)
    known = [w for w in vocabulary if Events(pa.array([w])).key[0] in names]
    unknown = {}
    while len(unknown) < CLASSES - 3:
        w = "zz" + "".join(rng.choice(list("abcdefgh"), 3))
        unknown.setdefault(int(Events(pa.array([w])).form_class[0]), w)
    for trained in (False, True):
        weights = start_weights() + (rng.normal(size=(BUCKETS, CLASSES)).astype(np.float32) if trained else 0)
        table = rng.normal(size=1 << 14).astype(np.float32) * trained
        for context in ([], known[:1], known[:2], [known[3], known[3]], known[4:9]):
            total = 0.0
            for last in [*known, *unknown.values(), None]:
                events = Events(pa.array([" ".join([*context, *([last] if last else [])])])).contexts()
                c = np.array([counts[names == k].sum() for k in events.key], float)
                total += token_probabilities((weights, table, Tree(tokens, words)), events, c, *per_class)[len(context)]
            assert abs(total - 1) < 1e-5


def test_lm_tells_words_of_a_class_apart_by_context(spark):
    rng = random.Random(8)
    # Equal last bytes are one class; each word occurs as often as the other.
    rows = [(i, " ".join(f"n{rng.randrange(50)} " + ("red xaing" if k % 2 else "blue ybing") for k in range(20)), None) for i in range(400)]
    held = [i for i in range(5000, 5100) if crc(i, 10) == 0][:4]
    # All probes end alike: only "xaing" is ever followed by an end, which would count against it.
    probes = list(zip(held, ["n1 red xaing n2", "n1 red ybing n2", "n1 blue ybing n2", "n1 blue xaing n2"], [None] * 4))
    got = {r.doc_id: r.score for r in lm_scores(frame(spark, rows + probes)).collect()}
    a, b, c, d = (got[i] for i in held)
    assert a > b + 0.3 and c > d + 0.3


def test_tree_is_a_distribution():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    kind, count, code = rng.integers(3, 6, 3000).astype(np.uint8), rng.integers(1, 50, 3000), code_of(keys)
    leaf = kind.astype(np.int32) << DEPTH | code
    tokens, words = (np.bincount(leaf, weights=w, minlength=CLASSES << DEPTH) for w in (count, np.ones(3000)))
    tree, features = Tree(tokens, words), np.tile(rng.integers(0, 1 << 32, (len(WORD_KINDS), 1)).astype(np.uint32), 3000)
    share = (count + ADD) / tree.leaf[leaf]
    for table in (np.zeros(1 << 14, np.float32), rng.normal(size=1 << 14).astype(np.float32)):
        p = tree.path(table, features, kind, code) * share
        assert np.allclose(np.bincount(kind, weights=p)[3:6], 1, atol=1e-5)
    # Untrained, it is the smoothed count's share of the class.
    p = tree.path(np.zeros(1 << 14, np.float32), features, kind, code) * share
    assert np.allclose(p, (count + ADD) / np.bincount(kind, weights=count + ADD)[kind], rtol=1e-4)


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))] if good else ["JUNK!!"] * rng.randrange(5, 60)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(good), 0))
    rows += [(9000, None, None), (9001, "", None), (None, "w1 w2", None)]
    lab = label_domains(spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    got = mix(frame(spark, rows), lab, {"q1t0": 0.8, "q0t0": 0.2}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    total = sum(r.n_tokens for r in got)
    share = sum(r.rate * r.n_tokens * r.posterior["q1t0"] for r in got) / total
    assert abs(share - 0.8) < 1e-4 and all(r.target_miss < 1e-4 for r in got)
    assert abs(sum(r.rate * r.n_tokens for r in got) / total - 1) < 1e-4


def test_mix_without_labels_and_clashing_columns(spark):
    none = label_domains(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = mix(frame(spark, [(1, "a b", "en")]), none, {"q1t0": 1.0}).collect()
    assert [(r.rate, r.n_tokens) for r in got] == [(1.0, 2)]
    docs = frame(spark, [(1, "a b", "en")]).withColumnRenamed("score", "rate")
    kept = mix(docs, none, {}, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "held_out", "n_tokens", "posterior", "rate", "copies", "target_miss"] and kept.count() == 1
    assert mix(frame(spark, []), none, {}).collect() == []


def test_label_model_equals_enumeration(spark):
    """One round over patterns is the sum over documents; the posterior is Bayes' rule where voters are independent."""
    rng = np.random.default_rng(7)
    toxic = rng.random(4000) < 0.2
    votes = rng.random((4000, 5)) < np.where(toxic[:, None], 0.5, 0.02)
    a, b, prior = np.full(5, 0.4), np.full(5, 0.03), 0.1
    start = LabelModel(a, b, (0.1, 0.9), prior, np.eye(5))
    for row in votes[:200].astype(float):
        fired = row > 0
        # Silence has its rate by class; where voters spoke, each one's rate is that among texts that are not silent.
        odds = [w * (np.prod(r[fired] / (1 - s)) * (1 - s) if fired.any() else s) for w, r, s in ((prior, a, 0.1), (1 - prior, b, 0.9))]
        assert abs(start.posterior(row[None, :])[0] - odds[0] / sum(odds)) < 1e-9
    rows = Counter(tuple(int(i) for i in np.flatnonzero(v)) for v in votes)
    patterns = spark.createDataFrame([(list(p), n) for p, n in rows.items()], "votes array<int>, n long").repartition(3)
    one = label_model(patterns, start, rounds=1)
    q = start.posterior(votes.astype(float))
    assert np.allclose(one.a, (q @ votes + 0.05) / (q.sum() + 0.1)) and np.allclose(one.b, ((1 - q) @ votes + 0.05) / ((1 - q).sum() + 0.1)) and abs(one.prior - q.mean()) < 1e-9
    done = label_model(patterns, start)
    # Abstentions of single voters are no evidence, which biases it a little.
    assert np.abs(done.a - 0.5).max() < 0.1 and np.abs(done.b - 0.02).max() < 0.02 and abs(done.prior - 0.2) < 0.05


def test_correlated_voters_share_what_they_say():
    a, b = np.full(3, 0.4), np.full(3, 0.02)
    twins = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], float)
    model = LabelModel(a, b, (0.1, 0.9), 0.1, twins)
    one, both, apart = model.posterior(np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1]], float))
    assert abs(one - both) < 1e-12 and apart > both


def test_rates_solve_the_least_squares_problem(spark):
    """Against brute force: a dense projected gradient on 200 documents, run until it stands still."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet([0.6, 0.8, 0.5], 200)
    n = rng.integers(1, 300, 200).astype(float)
    weighed = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    for targets, ridge in ((np.array([0.90, 0.08, 0.02]), 1e-3), (np.array([0.2, 0.3, 0.5]), 1e-3), (np.array([1.0, 0.0, 0.0]), 1e-2)):
        steps, miss = fit_rates(weighed, targets, n.sum(), ridge=ridge)
        w = n / n.sum()
        r = np.ones(200)
        size = 1 / (np.linalg.eigvalsh((w[:, None] * p).T @ p)[-1] + ridge)
        for _ in range(60_000):
            r = np.maximum(0, r - size * (p @ ((w * r) @ p - targets) + ridge * (r - 1)))
        assert np.allclose(rates(p, steps), r, atol=2e-3)
        assert abs(miss - np.abs((w * rates(p, steps)) @ p - targets).max()) < 1e-9


def test_mix_keeps_other_columns_and_tells_what_it_missed(spark):
    rows = [(i, "good words here" if i % 2 else "BAD!! 123 456", "en") for i in range(60)]
    docs = frame(spark, rows).withColumn("n_tokens", F.lit(-1)).withColumn("posterior", F.lit("x")).withColumn("copies", F.lit("y"))
    lab = label_domains(spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    got = mix(docs, lab, {"q1t0": 0.5, "q0t0": 0.5}, keep=True)
    assert got.columns == [*docs.columns[:-3], "n_tokens", "posterior", "rate", "copies", "target_miss"]
    assert sorted(r.n_tokens for r in got.collect()) == [3] * 60


def test_rare_voters_keep_their_class(spark):
    """Two groups of voters that never meet: without a prior the rarer one may drift to the clean class."""
    rng = np.random.default_rng(3)
    toxic = rng.random(6000) < 0.1
    rare = toxic & (rng.random(6000) < 0.2)
    votes = rng.random((6000, 12)) < np.where(toxic & ~rare, 0.4, 0.0005)[:, None] * (np.arange(12) < 6) + np.where(rare, 0.5, 0.0005)[:, None] * (np.arange(12) >= 6)
    y, silent = toxic.astype(float), ~votes.any(axis=1)
    start = LabelModel.of(y @ votes, votes.sum(0).astype(float), np.array([y[silent].sum(), (1 - y)[silent].sum()]), np.array([y.sum(), (1 - y).sum()]), y.mean(), (votes.T @ votes.astype(float)))
    rows = Counter(tuple(int(i) for i in np.flatnonzero(v)) for v in votes)
    patterns = spark.createDataFrame([(list(p), n) for p, n in rows.items()], "votes array<int>, n long").repartition(3)
    q = label_model(patterns, start, anchor=3.0).posterior(votes.astype(float))
    spoke = ~silent
    assert q[rare & spoke].mean() > 0.9 and q[toxic & ~rare & spoke].mean() > 0.9 and q[~toxic & silent].mean() < 0.1
