import itertools
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.llm import common as C
from loomlens.llm import lm, quality, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, held_out string"


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_forward_and_counts_match_all_paths():
    rng = np.random.default_rng(3)
    first, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    model = lm.Model(first, move, emit)
    rows = [np.array(x, np.uint16) for x in ([0, 1, 4, 2], [3], [2, 2])]
    counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for x, got in zip(rows, model.log10(rows), strict=True):
        paths = {}
        for z in itertools.product(range(3), repeat=len(x)):
            p = first[z[0]] * emit[x[0], z[0]]
            for a, b, o in zip(z, z[1:], x[1:], strict=False):
                p *= move[a, b] * emit[o, b]
            paths[z] = p
        total = sum(paths.values())
        assert got == pytest.approx(math.log10(total))
        for z, p in paths.items():
            counts[0][z[0]] += p / total
            for a, b in zip(z, z[1:], strict=False):
                counts[1][a, b] += p / total
            for o, s in zip(x, z, strict=True):
                counts[2][o, s] += p / total
    for span in (1, 2, 3, 256):
        *found, total = model.expected(rows, span)
        assert total == pytest.approx(model.log10(rows).sum())
        for want, got in zip(counts, found, strict=True):
            assert np.allclose(want, got)


@pytest.mark.parametrize("begin", [0, 1, 3])
def test_steps_of_all_sequences_along_memory(begin):
    """States, emissions and scales have a column for each token, from any step on, and are those of each sequence by itself."""
    rng = np.random.default_rng(4)
    model = lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    rows = [rng.integers(0, 5, n).astype(np.uint16) for n in (2, 6, 4, 6, 1)]
    steps, want = lm.Steps(rows), {}
    for i, row in enumerate(rows):
        a = None
        for t, o in enumerate(row):
            a = (model.first if a is None else a @ model.move) * model.emit[o]
            want[i, t], a = (a / a.sum(), model.emit[o], a.sum()), a / a.sum()
    before = None if not begin else np.stack([want[i, begin - 1][0] for i in steps.order[: steps.n[begin - 1]]], axis=1)
    states, given, scales = model.forward(steps, begin, len(steps.n), before)
    at = [(steps.order[k], t) for t in range(begin, len(steps.n)) for k in range(steps.n[t])]
    assert states.flags.c_contiguous and given.flags.c_contiguous and states.shape == given.shape == (3, len(at))
    for k, x in enumerate(at):
        assert np.allclose(states[:, k], want[x][0]) and np.allclose(given[:, k], want[x][1]) and scales[k] == pytest.approx(want[x][2])
    assert "columns" in model.__dict__ and "columns" not in pickle.loads(pickle.dumps(model)).__dict__


def test_symbols_of_rare_words_are_not_kept():
    """Looked up word by word without a call each; in a task as on the driver."""
    symbols = pickle.loads(pickle.dumps(lm.Symbols([b"the", b"of"], 4)))
    words = [b"of", b"rare", b"the", b"rarer"]
    assert symbols.ids(words).tolist() == [6, 1 + zlib.crc32(b"rare") % 4, 5, 1 + zlib.crc32(b"rarer") % 4, 0]
    assert symbols.ids([]).tolist() == [0] and dict(symbols) == {b"the": 5, b"of": 6}


def naive(rows, head, rounds, states):
    """(likelihoods before each round, score by doc_id), token by token, without pools, spans or scaling tricks."""
    tokens = {i: (t or "").encode().lower().split() for i, t, *_ in rows}
    train = [i for i in tokens if fold(i, 10)]
    c = Counter(w for i in train for w in tokens[i])
    floor = lambda x: x if x < 64 else x >> (x.bit_length() - 6) << (x.bit_length() - 6)
    least = min((floor(x) for x in c.values() if sum(floor(y) >= floor(x) for y in c.values()) <= head), default=1 << 62)
    top = sorted((w for w in c if c[w] >= least), key=lambda w: (-c[w], w))
    classes = lm.rare_classes(len(c) - len(top))
    sym = lambda w: top.index(w) + 1 + classes if w in top else 1 + zlib.crc32(w) % classes
    ids = {i: [*map(sym, ws), 0] for i, ws in tokens.items()}
    total, kinds = Counter(), Counter()
    for w in c:
        if c[w] < least:
            total[sym(w)] += c[w]
            kinds[sym(w)] += 1
    seen = np.array([len(train), *(total[k] for k in range(1, classes + 1)), *(c[w] for w in top)], float)
    shares = (seen + 0.1) / (seen + 0.1).sum()
    model, history = lm.Model.fresh(shares, states), []

    def forward(x):
        out = [model.first * model.emit[x[0]]]
        for o in x[1:]:
            out.append((out[-1] @ model.move) * model.emit[o])
        return out

    for _ in range(rounds):
        first, move, emit, like = np.zeros(states), np.zeros((states, states)), np.zeros((len(seen), states)), 0.0
        for i in train:
            x, a = ids[i], forward(ids[i])
            p, b = a[-1].sum(), np.ones(states)
            like += math.log10(p)
            for t in range(len(x) - 1, -1, -1):
                emit[x[t]] += a[t] * b / p
                if t:
                    move += a[t - 1][:, None] * model.move * (model.emit[x[t]] * b)[None] / p
                    b = model.move @ (model.emit[x[t]] * b)
                else:
                    first += a[0] * b / p
        history.append(like)
        model = lm.Model.of(first, move, emit, shares)
    inside = lambda w: math.log10((c[w] + 0.1) / (total[sym(w)] + 0.1 * (kinds[sym(w)] + 1))) if w not in top else 0.0
    return history, {i: math.log10(forward(ids[i])[-1].sum()) + sum(map(inside, tokens[i])) for i in tokens}


@pytest.mark.parametrize(("head", "rounds"), [(5, 2), (1000, 2), (0, 1), (5, 0)])
def test_scores_by_brute_force(spark, head, rounds, monkeypatch):
    monkeypatch.setattr(lm, "PER_CLASS", 4)
    rows = [(i, " ".join(f"W{(i * k) % (3 + k)}" for k in range(1, 1 + i % 23)), 0.5, "x") for i in range(60)] + [(100, None, None, None), (None, "never seen", 0.0, "")]
    got = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=rounds, states=2, head=head).collect()
    c, n = Counter(), 0
    for i, t, *_ in rows:
        if fold(i, 10):
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in got}
    history, scores = naive(rows, head, rounds, 2)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        r = by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(scores[i])
    assert all(b > a for a, b in itertools.pairwise(history))


def test_very_long_texts_and_likelihood_by_round(spark):
    long = " ".join(f"w{i * i % 97}" for i in range(30_000))
    docs = spark.createDataFrame([(101, "a b\x0bc " * 3000, 0.0, ""), (102, long, 0.0, ""), (103, long, 0.0, "")], SCHEMA)
    a = {r.doc_id: r for r in lm.score(docs, rounds=3, states=2).collect()}
    assert [a[i].n_tokens for i in (101, 102, 103)] == [9001, 30_001, 30_001] and a[102].score == pytest.approx(a[103].score)
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 9, k).astype(np.uint16) for k in (700, 3, 1, 40)]
    tokens = spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "ids binary")
    model = lm.train(tokens, np.full(9, 1 / 9), rounds=5, states=3, least_gain=-1.0)
    assert len(model.likelihoods) == 5 and all(y >= x for x, y in itertools.pairwise(model.likelihoods))
    assert len(lm.train(tokens, np.full(9, 1 / 9), rounds=5, states=3, least_gain=0.5).likelihoods) == 2


def test_training_raises_likelihood_and_beats_the_base(spark):
    docs = C.table(spark, SF, "documents")
    few = lm.score(docs, rounds=0).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    more = lm.score(docs, rounds=4).where("held_out").agg({"score": "sum"}).first()
    assert more["sum(score)"] > few["sum(score)"] and more["sum(score)"] > few["sum(base_score)"]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.93


def test_toxicity_leaves_clean_documents_alone(spark):
    docs, labels = C.table(spark, "/root/testdata/sf0.1", "documents"), C.table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == y] for y in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.005


def test_machine_learns_pairs_that_a_sum_misses():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, on in ((0, a), (1, b)) if on] + [int(rng.integers(2, 20))], np.int32))
        labels.append(int(a and b) if rng.random() < 0.5 else int(a and b))
    machine = toxicity.Machine({i: i for i in range(20)}, 0.0)
    machine.fit(rows, np.array(labels, float), rounds=30)
    got = machine.score([np.array(x, np.int32) for x in ([0, 5], [1, 5], [0, 1, 5], [5])])
    assert (got > 0.5).tolist() == [False, False, True, False]
    assert abs(machine.vectors[0] @ machine.vectors[1]) > 0.3


def test_pairs_against_a_double_loop():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine({i: i for i in range(30)}, -0.3)
    machine.weights, machine.vectors = rng.normal(0, 0.3, 30), rng.normal(0, 0.3, (30, toxicity.FACTORS))
    rows = [rng.permutation(30)[: rng.integers(0, 12)].astype(np.int32) for _ in range(40)]
    for x, got in zip(rows, machine.score(rows), strict=True):
        raw = machine.bias + sum(machine.weights[i] for i in x) + sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in itertools.combinations(x, 2))
        assert got == pytest.approx(1 / (1 + math.exp(-raw)))


def pair_corpus(n, seed=8):
    """Toxic if both words stand there; each alone is as frequent among clean texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["both", "none", "insult", "group"] if i % 2 else ["both", "none"])
        w = [f"w{rng.randrange(150)}" for _ in range(rng.randrange(5, 30))] + ["zarkish"] * (kind in ("both", "insult")) + ["blennian"] * (kind in ("both", "group"))
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(kind == "both"), kind))
    return rows


def test_fit_learns_a_pair_of_words(spark):
    rows = pair_corpus(3000)
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, _, _ in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    for kind in ("both", "none", "insult", "group"):
        own = [got[i].predicted == y for i, _, y, k in rows if k == kind and got[i].held_out]
        assert np.mean(own) > 0.9, kind


def test_a_term_that_tells_nothing_alone_is_kept(spark):
    rng = random.Random(3)
    rows = [(i, " ".join([*(["zarkish"] if i & 1 else []), *(["blennian"] if i & 2 else []), *(f"w{rng.randrange(90)}" for _ in range(9))]), int((i & 3) in (0, 3))) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    word = toxicity.terms(b"zarkish")[0]
    assert word in toxicity.fit(docs, labels).places and word not in toxicity.fit(docs, labels, frequent=0).places
    got = [r.predicted == rows[r.doc_id][2] for r in toxicity.scored(docs, toxicity.fit(docs, labels)).where("held_out").collect()]
    assert np.mean(got) > 0.9


def test_partitions_and_repeats_do_not_change_the_machine(spark):
    rows = pair_corpus(400, 2) + [(7, "given twice", 0, ""), (7, "given twice", 0, "")]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, _, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in toxicity.scored(docs, toxicity.fit(docs.repartition(k), labels.repartition(k))).collect()) for k in (1, 5)]
    assert scores[0] == scores[1] and len(scores[0]) == 402


def test_labels_learned_from_are_bounded(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    known = labels.where("toxic is not null").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40)).alias("h")).collect()
    want = sorted(r.doc_id for r in sorted((r for r in known if fold(r.doc_id, 5)), key=lambda r: (r.h, r.doc_id))[:150])
    assert sorted(r.doc_id for r in toxicity.labelled(docs, labels, 150, 5).collect()) == want


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0, "a"), (None, "word", 1.0, "b"), (2, "", None, None), (2, "x " * 200000, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == 4 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.keep_clean(docs, toxicity.fit(docs, none)).count() == 4
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_quality_samples_good_documents(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    got = quality.resample(docs, labels)
    rows = got.collect()
    assert sorted(r.rank for r in rows) == list(range(1, docs.count() + 1))
    order = sorted(rows, key=lambda r: r.rank)
    assert all(a.key >= b.key for a, b in itertools.pairwise(order))
    good = labels.where("quality = 1").count() / labels.count()
    assert sum(r.kept for r in rows) == math.ceil(good * len(rows)) == max(r.rank for r in rows if r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept = [r.kept for r in rows if known.get(r.doc_id) == 1]
    junk = [r.kept for r in rows if known.get(r.doc_id) == 0]
    print("kept", np.mean(kept), "junk", np.mean(junk))
    assert np.mean(kept) > 0.9 and np.mean(junk) < 0.35


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0, "a"), (None, "word", 1.0, "b"), (None, "word", 1.0, "b")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.log_weight for r in quality.resample(docs, none).collect()] == [0.0] * 3
    assert quality.resample(docs.limit(0), none).count() == 0
