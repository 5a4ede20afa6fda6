"""Language-model scoring with a hidden Markov model.

Words are counted over all training documents. The most frequent ones (a bounded head, sent to the
workers) are symbols of the model; all others share symbols by hash, in classes whose number grows with the
number of such words up to RARE_CLASSES; a rare word's own probability within
its class comes from its exact count, by a join. Baum-Welch: each partition adds up the expected
counts of transitions and emissions over its training texts, Spark adds up the partitions, and the
driver normalizes them, an array of fixed size. Forward and backward recursions run over whole texts; the forward states
of many tokens are kept at the start of every SPAN alone and computed again from there on the way back. Rounds end when the
likelihood hardly rises any more, or after ROUNDS.

Nulls and edges: a null text is empty (its only token is the end); a null doc_id counts as the empty string in
the fold's crc32. Repeated rows are scored and learned from as often as they stand there; very long texts are taken whole. An empty
table gives no row; without training rows every count is 0, the base gives each token probability 1
and the model spreads over its symbols evenly.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import batches_of, sql_schema

#: Symbols: the end, the classes of rare words, then the most frequent words, HEAD at most. RARE_CLASSES is a power of two.
END, RARE_CLASSES = 0, 1 << 13
HEAD = (1 << 16) - 1 - RARE_CLASSES
#: Rare words that a class has on average before there are more classes.
PER_CLASS = 64
STATES, ROUNDS, SPAN, LEAST_GAIN = 8, 4, 256, 1e-4
#: Tokens worked on at once, the length from which texts are pooled apart, and for how many tokens all forward states are kept.
POOL, LONG, KEPT = 600_000, 2048, 1 << 20
FOLDS = 10


def words(text: bytes) -> list[bytes]:
    """Lower-cased by ASCII, split at ASCII white space; bytes.split does just that."""
    return text.lower().split()


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over the given rows, each partition's counts added up before the shuffle."""

    def run(batches):
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        held: Counter = Counter()
        for _, text in C.pairs(batches):
            held.update(words(text))
            if len(held) > 300_000:
                yield from batches_of(held.items(), schema)
                held = Counter()
        yield from batches_of(held.items(), schema)

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def threshold(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` words have it or more. Counts are told apart by their six leading bits, so that the table of how many words have each is small."""
    floor = F.expr("shiftleft(shiftright(c, greatest(0, length(bin(c)) - 6)), greatest(0, length(bin(c)) - 6))")
    rows = sorted(((r["f"], r["n"]) for r in counts.groupBy(floor.alias("f")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundreds
    least, total = None, 0
    for f, n in rows:
        total += n
        if total > head:
            break
        least = f
    return least if least is not None else 1 << 62


def rare_classes(kinds: int) -> int:
    return min(RARE_CLASSES, 1 << max(0, (kinds // PER_CLASS).bit_length()))


class Symbols(dict):
    """Ids of words: 0 the end, then ``classes`` for rare words by hash, then the head. Rare words aren't kept."""

    def __init__(self, head: list[bytes], classes: int):
        super().__init__((w, i + 1 + classes) for i, w in enumerate(head))
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        return 1 + crc32(word) % self.classes

    def __reduce__(self):
        return Symbols, (list(self), self.classes)

    def ids(self, found: list[bytes]) -> np.ndarray:
        out = np.empty(len(found) + 1, np.uint16)
        out[:-1] = np.fromiter(map(self.__getitem__, found), np.uint16, len(found))
        out[-1] = END
        return out


def pooled(rows, size):
    """Lists of rows of about POOL tokens; texts of over LONG tokens apart, as their steps are many."""
    pools, weights = {False: [], True: []}, {False: 0, True: 0}
    for row in rows:
        big = size(row) > LONG
        pools[big].append(row)
        weights[big] += size(row)
        if weights[big] >= POOL * (1 + 2 * big):
            yield pools[big]
            pools[big], weights[big] = [], 0
    yield from (p for p in pools.values() if p)


class Steps:
    """Sequences side by side, the longest first: at step t the first n[t] are still going on."""

    def __init__(self, rows: list[np.ndarray]):
        lengths = np.array([len(r) for r in rows])
        self.order = np.argsort(-lengths, kind="stable")
        going = np.bincount(lengths, minlength=lengths.max() + 1)
        self.n = len(rows) - np.cumsum(going)[:-1]
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.at = np.empty(int(lengths.sum()), dtype=np.uint16)
        for place, i in enumerate(self.order):
            self.at[self.starts[: lengths[i]] + place] = rows[i]


class Model:
    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit  # emit: a row for each symbol, a column for each state
        self.likelihoods: list[float] = []  # log10 of the training texts, before each round

    @classmethod
    def fresh(cls, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        """States that tend to stay, each with the words' shares shaken."""
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * rng.uniform(0.5, 1.5, (len(shares), states))
        move = np.full((states, states), 0.2 / max(states - 1, 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @cached_property
    def columns(self) -> np.ndarray:
        """``emit`` with a row for each state, as a task needs it: what is done for all tokens of a step then runs along memory."""
        return np.ascontiguousarray(self.emit.T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "columns"}

    def forward(self, steps: Steps, begin: int, end: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the steps from ``begin`` to ``end`` the scaled forward states, the emissions and the scales, a column for each token; ``a`` is the states before them, None at the start."""
        low = steps.starts[begin]
        given = self.columns.take(steps.at[low : steps.starts[end]], axis=1)
        states, scales = np.empty_like(given), np.empty(given.shape[1])
        for t in range(begin, end):
            own = slice(steps.starts[t] - low, steps.starts[t + 1] - low)
            now = states[:, own]
            if a is None:
                np.multiply(self.first[:, None], given[:, own], out=now)
            else:
                np.matmul(self.move.T, a[:, : now.shape[1]], out=now)
                now *= given[:, own]
            now /= now.sum(axis=0, out=scales[own])
            a = now
        return states, given, scales

    def log10(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of each whole sequence, by the scaled forward recursion."""
        steps, out, a = Steps(rows), np.zeros(len(rows)), None
        for begin in range(0, len(steps.n), SPAN):
            end = min(begin + SPAN, len(steps.n))
            states, _, scales = self.forward(steps, begin, end, a)
            a, scales = states[:, states.shape[1] - steps.n[end - 1] :].copy(), np.log10(scales)
            for t in range(begin, end):
                out[: steps.n[t]] += scales[steps.starts[t] - steps.starts[begin] : steps.starts[t + 1] - steps.starts[begin]]
        back = np.empty(len(rows))
        back[steps.order] = out
        return back

    def expected(self, rows: list[np.ndarray], span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, transitions and emissions over the whole sequences, and their log10 likelihood."""
        steps, marks, total = Steps(rows), [None], 0.0
        span = span or (len(steps.n) if len(steps.at) <= KEPT else SPAN)
        for end in range(span, len(steps.n), span):  # what the last span holds is kept on the way back
            states = self.forward(steps, end - span, end, marks[-1])[0]
            marks.append(states[:, states.shape[1] - steps.n[end - 1] :].copy())
        move, emit, weighed = np.zeros_like(self.move), np.zeros_like(self.columns), None
        held, size, gamma = [], 0, None

        def settle():
            at, g = (np.concatenate(x, axis=-1) if len(held) > 1 else x[0] for x in zip(*held, strict=True))
            at = at.astype(np.intp)
            for s in range(len(emit)):
                emit[s] += np.bincount(at, g[s], emit.shape[1])

        for k in range(len(marks) - 1, -1, -1):
            begin, end = k * span, min((k + 1) * span, len(steps.n))
            states, given, scales = self.forward(steps, begin, end, marks.pop())
            total += float(np.log10(scales).sum())
            np.reciprocal(scales, out=scales)
            low = steps.starts[begin]
            for t in range(end - 1, begin - 1, -1):  # in place: states become their expected counts, emissions what goes on to the step before
                own = slice(steps.starts[t] - low, steps.starts[t + 1] - low)
                gamma, now = states[:, own], given[:, own]
                if weighed is not None:  # sequences that end here go on with ones
                    n = weighed.shape[1]
                    move += gamma[:, :n] @ weighed.T
                    b = self.move @ weighed
                    gamma[:, :n] *= b
                    now[:, :n] *= b
                now *= scales[own]
                weighed = now
            weighed = weighed.copy()
            held.append((steps.at[low : steps.starts[end]], states))
            size += states.shape[1]
            if size > POOL // 4 or not k:
                settle()
                held, size = [], 0
        return gamma.sum(axis=1), move * self.move, emit.T, total

    @classmethod
    def of(cls, first: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """Normalized counts, each emission mixed with one part in a thousand of the words' shares."""
        first, move = first + 1e-3, move + 1e-3
        emit = 0.999 * emit / np.maximum(emit.sum(axis=0), 1e-300) + 0.001 * shares[:, None]
        return cls(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(tokens: DataFrame, shares: np.ndarray, rounds: int = ROUNDS, states: int = STATES, least_gain: float = LEAST_GAIN) -> Model:
    """Baum-Welch over the rows of ``tokens`` (column ids), until a round raises the likelihood by less than ``least_gain`` of it."""
    model, likelihoods = Model.fresh(shares, states), []
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):

        def run(batches, model=model):
            first, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(shares), states)), 0.0
            for pool in pooled((np.frombuffer(held, np.uint16) for b in batches for held in b.column(0).to_pylist()), len):
                *got, more = model.expected(pool)
                for own, x in zip((first, move, emit), got, strict=True):
                    own += x
                total += more
            at = np.flatnonzero(emit.sum(axis=1))
            at_all = np.concatenate([at, -1 - np.arange(states + 2)])  # below 0: the transitions' rows, the first states, the likelihood
            rows = np.concatenate([emit[at], move, first[None], np.full((1, states), total)])
            yield pa.RecordBatch.from_arrays([pa.array(at_all), *(pa.array(np.ascontiguousarray(rows[:, s])) for s in range(states))], names=["at", *names])

        sums = tokens.select("ids").mapInArrow(run, "at long, " + ", ".join(f"{x} double" for x in names)).groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # as many rows as symbols
        if sums.empty:
            break
        by = dict(zip(sums["at"].to_numpy(), sums[names].to_numpy(), strict=True))
        emit = np.zeros((len(shares), states))
        at = np.array([k for k in by if k >= 0], dtype=np.int64)
        emit[at] = np.array([by[k] for k in at]).reshape(len(at), states)
        likelihoods.append(float(by[-2 - states][0]))
        model = Model.of(by[-1 - states], np.array([by[-1 - k] for k in range(states)]), emit, shares)
        model.likelihoods = likelihoods
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < least_gain * abs(likelihoods[-2]):
            break
    return model


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    spark = docs.sparkSession
    C.prepare(spark)
    texts = C.text_bytes(docs).withColumn("held_out", C.crc_bucket(F.col("doc_id"), FOLDS) == 0)
    training = texts.where("not held_out")
    counts = counted(training.select("doc_id", "text")).checkpoint()
    n_docs = training.select("doc_id").count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = threshold(counts, head)
    top = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))  # at most ``head`` rows
    n, v = n_words + n_docs, n_distinct + (n_docs > 0)
    classes = rare_classes(n_distinct - len(top))
    symbols = Symbols([w for w, _ in top], classes)
    class_of = lambda word: F.crc32(word) % classes + 1
    in_class, kinds = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in counts.where(F.col("c") < least).groupBy(class_of(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # one row for each class
        in_class[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    seen = np.concatenate([[n_docs], in_class[1:], np.array([c for _, c in top], dtype=float)])
    base = np.log10((seen + 0.1) / (n + 0.1 * (v + 1)))
    known = (seen > 0).astype(np.int64)
    shares = (seen + 0.1) / (seen + 0.1).sum()
    within = np.log10(in_class + 0.1 * (kinds + 1))

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("ids", pa.binary()), ("rare", pa.binary())])

    def encode(batches):
        def rows():
            at = C.part_id() << 33
            for b in batches:
                for doc_id, text, held_out in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = words(text)
                    ids = symbols.ids(found)
                    is_rare = (ids > END) & (ids <= classes)
                    own = ids[~is_rare]
                    # Rare words' shares of their classes: here what they are divided by, the counts by the join below.
                    yield at, doc_id, held_out, len(ids), int(known[own].sum()), float(base[own].sum()), float(-within[ids[is_rare]].sum()), ids.tobytes(), b" ".join(compress(found, is_rare.tolist()))
                    at += 1

        yield from batches_of(rows(), schema, lambda r: len(r[7]) + len(r[8]) + 88)

    tokens = texts.select("doc_id", "text", "held_out").mapInArrow(encode, sql_schema(schema).replace("held_out double", "held_out boolean")).checkpoint()
    model = train(tokens.where("not held_out"), shares, rounds, states)

    forward = pa.schema([("row", pa.int64()), ("forward", pa.float64())])

    def run(batches):
        def rows():
            for b in batches:
                yield from ((row, np.frombuffer(held, np.uint16)) for row, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        for pool in pooled(rows(), lambda r: len(r[1])):
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pool], pa.int64()), pa.array(model.log10([x for _, x in pool]))], schema=forward)

    rare = tokens.where(F.length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word")).select("row", F.col("word").cast("binary").alias("word"))
    found = rare.join(counts, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    share = F.log10(F.col("c") + 0.1)
    rare_sums = found.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(share - F.lit(float(np.log10(n + 0.1 * (v + 1))))).alias("base"), F.sum(share).alias("inside"))
    own = tokens.select("row", "doc_id", "held_out", "n_tokens", F.col("n_known").alias("k"), F.col("base").alias("b"), "within")
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_rows = own.join(tokens.select("row", "ids").mapInArrow(run, sql_schema(forward)), "row", "left").join(rare_sums, "row", "left")
    return all_rows.select("doc_id", "held_out", "n_tokens", (F.col("k") + zero(F.col("known"))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("b") + zero(F.col("base"))).alias("base_score"), (F.col("forward") + F.col("within") + zero(F.col("inside"))).alias("score"))
