"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is that of its 5-word shingles. Documents with equal sets form a class; each class has
one signature of 64 symbols of 16 bits, the low bits of 64 minima. Two signatures that differ in at most
MOST_APART = 31 symbols agree, by pigeonhole, in all but one symbol of some of the 16 chunks of four; so a
class stands in the index under each chunk with each of its symbols left out (64 picks), and all such
pairs meet in a bucket, whatever its size. (Sets of similarity 0.75 differ in 16 symbols on average; a
pair at just 0.75 is more than 31 apart about once in a hundred thousand.)

In a bucket of up to MOST_ALL classes all meet each other. In a larger one each first meets a pivot, which
settles what hangs together closely; the bucket is then split into blocks, and the classes outside its
largest component are compared in them with all classes of other components. A pair is compared in its
lowest common pick alone, and only links leave a block. Candidates are confirmed on the full sets.
Components come from alternating stars.

A key that holds a five-hundredth of all classes or more is found beforehand and isn't dealt out by key;
the blocks of a large bucket are spread over tasks. Sets are held as 64-bit hashes of shingles.

Nulls and edges: a null text is empty; a document without words has n_shingles 0 and is linked with
nothing; one of fewer than five words has its whole sequence as its only shingle. A row with a null
doc_id takes no part and is kept, its component_id null. Rows that share a doc_id count as one document with several
texts. Repeated rows come back as often as they stand there. Very long texts are taken whole. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import batches_of, sql_schema

WIDTH = 5
#: Symbols of a signature, symbols of a chunk, and how far apart a pair may be so that it is sure to meet.
SYMBOLS, CHUNK = 64, 4
MOST_APART = 2 * (SYMBOLS // CHUNK) - 1
#: Classes of a bucket that all meet each other; larger buckets go through blocks of so many classes and others.
MOST_ALL, BLOCK, OTHERS = 32, 2048, 512
#: So many orders of classes, from which a large bucket takes its pivot by its key.
PIVOTS = 4
#: Pairs of one class confirmed by a task at a time.
STAR = 256
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75

_RNG = np.random.default_rng(20240229)
_POWERS = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_TIMES = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= 150_000:
            self.clear()
        self[word] = got = xxh3_64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, held: Hashes) -> np.ndarray:
    """The sorted set of hashed shingles of a text, lower-cased by ASCII and split at ASCII white space."""
    w = np.array(list(map(held.__getitem__, text.lower().split())), dtype=np.uint64)
    if not len(w):
        return w
    width = min(WIDTH, len(w))
    total = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += w[k : len(w) - width + 1 + k] * _POWERS[k]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 2048):
        least = np.minimum(least, mixed(found[a : a + 2048, None] * _TIMES + _PLUS).min(axis=0))
    return (least & np.uint64(0xFFFF)).astype("<u2")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("sig", pa.binary()), ("packed", pa.binary())])


def signed(texts: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), class (digest of the set), sig and packed (the text, compressed) of every row."""

    def run(batches):
        from hashlib import blake2b

        import zstandard

        held, press = Hashes(), zstandard.ZstdCompressor(level=3)

        def rows():
            for doc_id, text in C.pairs(batches):
                found = shingles(text, held)
                if len(found):
                    yield doc_id, len(found), blake2b(found.tobytes(), digest_size=16).digest(), signature(found).tobytes(), press.compress(text)
                else:
                    yield doc_id, 0, None, None, None

        yield from batches_of(rows(), _SIGNED, lambda r: 200 + len(r[4] or b""))

    return texts.mapInArrow(run, sql_schema(_SIGNED))


_PICKED = np.concatenate([np.delete(np.arange(SYMBOLS).reshape(-1, CHUNK), k, axis=1) for k in range(CHUNK)], axis=1).reshape(-1, CHUNK - 1)
_LONG = pa.int64()


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: the number of the pick, then its three symbols."""
    key = np.broadcast_to(np.arange(len(_PICKED), dtype=np.uint64), (len(sigs), len(_PICKED))).copy()
    for k in range(CHUNK - 1):
        key = (key << np.uint64(16)) | sigs[:, _PICKED[:, k]]
    return key


def lowest_pick(same: np.ndarray) -> np.ndarray:
    """Of rows that say which symbols agree, the lowest pick that agrees; 64 if none does."""
    agrees = same[:, _PICKED].all(axis=2)
    return np.where(agrees.any(axis=1), agrees.argmax(axis=1), len(_PICKED))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def hot_keys(reps: DataFrame, most_all: int = MOST_ALL) -> np.ndarray:
    """The keys that hold a five-hundredth of all classes or more, and maybe some that hold a thousandth: 64,000 at most."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                found, often = np.unique(keys_of(_signatures(b.column(0))), return_counts=True)
                some = often * 2000 >= max(b.num_rows, 4000)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found[some].view(np.int64), 0)), pa.array(np.append(often[some], 0)), pa.array(np.append(np.zeros(int(some.sum()), np.int64), b.num_rows))], names=["key", "often", "rows"])

    counted = reps.select("sig").mapInArrow(run, "key long, often long, rows long").groupBy("key").agg(F.sum("often").alias("often"), F.sum("rows").alias("rows")).checkpoint()
    rows = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return np.array(sorted(r["key"] for r in counted.where((F.col("often") > most_all) & (F.col("often") * 1000 >= rows)).select("key").collect()), dtype=np.int64)


def keyed(reps: DataFrame, hot: np.ndarray, are_hot: bool) -> DataFrame:
    """(key, rep): each class under its keys that are hot, or under all others."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                own = b.slice(at, 2000)
                key = keys_of(_signatures(own.column(1))).ravel().view(np.int64)
                rep = np.repeat(own.column(0).to_numpy(), len(_PICKED))
                wanted = np.isin(key, hot) == are_hot if len(hot) else np.full(len(key), not are_hot)
                yield pa.RecordBatch.from_arrays([pa.array(key[wanted]), pa.array(rep[wanted])], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


_MET = pa.schema([("pick", _LONG), ("x", _LONG), ("y", _LONG)])


def _meeting(most_all: int):
    """Rows (key, rep), sorted, to the pairs (-1, a, b) of small buckets and the members (0, key, rep) of large ones."""

    def run(batches):
        def out(pick, x, y):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), pick, np.int64)), pa.array(x), pa.array(y)], schema=_MET)

        def small(key, rep):
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            for n in np.unique(size[size > 1]):
                own = begin[size == n]
                if n > most_all:
                    at = (own[:, None] + np.arange(n)).ravel()
                    yield out(0, key[at], rep[at])
                else:
                    i, j = np.triu_indices(n, 1)
                    yield out(-1, rep[own[:, None] + i].ravel(), rep[own[:, None] + j].ravel())

        held_key, held_rep, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            if large is not None:  # the rest of a bucket known to be large
                n = int(np.searchsorted(key, large, "right"))
                yield out(0, key[:n], rep[:n])
                key, rep = key[n:], rep[n:]
                large = large if not len(key) else None
            if not len(key):
                continue
            key, rep = np.concatenate([held_key, key]), np.concatenate([held_rep, rep])
            last = int(np.searchsorted(key, key[-1], "left"))
            yield from small(key[:last], rep[:last]) if last else ()
            held_key, held_rep = key[last:], rep[last:]
            if len(held_key) > most_all:
                large = held_key[0]
                yield out(0, held_key, held_rep)
                held_key, held_rep = held_key[:0], held_rep[:0]
        if len(held_key):
            yield from small(held_key, held_rep)

    return run


def near(found: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b), a < b, those whose set sizes allow a link and whose signatures are near."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    joined = found.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "sa", "sb")

    def run(batches):
        for x in batches:
            d = (_signatures(x.column(2)) != _signatures(x.column(3))).sum(axis=1)
            yield x.select([0, 1]).filter(pa.array(d <= MOST_APART))

    return joined.mapInArrow(run, "a long, b long")


def _unpacked(packed: bytes, held: Hashes) -> np.ndarray:
    import zstandard

    return shingles(zstandard.decompress(packed), held)


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


class Forest:
    """What hangs together, each node under the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)

    def edges(self) -> pa.RecordBatch:
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, _LONG), pa.array([self.root(x) for x in nodes], _LONG)], names=["a", "b"])


def confirmed(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are links by their full sets, as a forest: each node of a task under the smallest that it hangs together with there.

    All pairs of one a are dealt out together, STAR at a time.
    """
    often = found.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = found.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    needs = dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct().union(dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id")))

    def run(batches):
        held, own, centres, found = Hashes(), None, [], Forest()
        for x in batches:
            for a, part, role, doc_id, packed in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if (a, part) != own:
                    own, centres = (a, part), []
                if role and found.root(a) == found.root(doc_id):
                    continue
                q = _unpacked(packed, held)
                if not role:
                    centres.append(q)
                elif any(linked(p, q) for p in centres):
                    found.join(a, doc_id)
            if len(found.up) > 500_000:
                yield found.edges()
                found = Forest()
        yield found.edges()

    rows = needs.join(texts.select("doc_id", "packed"), "doc_id").select("a", "part", "role", "doc_id", "packed")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches; there are ``most`` at most, if that is known. Alternating large and small stars."""

    def star(edges, large):
        both = edges.union(edges.select("b", "a"))
        least = (both if large else both.where("b < a")).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.where("b > a" if large else "b < a").join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (out if large else out.union(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    edges, before = links.select("a", "b").where("a <> b").distinct(), None
    edges = edges.checkpoint() if most is None else C.in_few_files(edges, most)
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = C.in_few_files(star(star(edges, True), False), 2 * now[0])
    own = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return C.in_few_files(own.union(own.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label")), 2 * now[0])


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (a, b): only the labels that these join are worked on again."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(ends, more.count())
    moved = labels.join(over.toDF("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return moved.union(over.toDF("node", "label")).groupBy("node").agg(F.min("label").alias("label"))


def _between(batches):
    """Blocks, sorted so that those outside the largest component come first, to links between different components."""
    names = ["a", "b"]
    block, held = None, Hashes()
    reps = labels = sizes = sigs = texts = sets = up = None

    def root(x):
        while x in up:
            x = up[x]
        return x

    for x in batches:
        key, m, r, role, rep, label, n = (x.column(i).to_numpy() for i in range(7))
        sig, packed = _signatures(x.column(7)) if x.num_rows else None, x.column(8)
        turn = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (r[1:] != r[:-1])])) if len(key) else []
        out = []
        for begin, end in zip(turn, [*turn[1:], len(key)], strict=True):
            if (key[begin], m[begin], r[begin]) != block:
                block = (key[begin], m[begin], r[begin])
                reps, labels, sizes, sigs, texts, sets, up = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SYMBOLS), "<u2"), [], {}, {}
            first = np.arange(begin, end)[role[begin:end] == 0]
            if len(first):
                reps, labels, sizes, sigs = np.concatenate([reps, rep[first]]), np.concatenate([labels, label[first]]), np.concatenate([sizes, n[first]]), np.concatenate([sigs, sig[first]])
                texts += packed.take(pa.array(first)).to_pylist()
            pick = int(np.int64(key[begin]).view(np.uint64) >> np.uint64(48))
            for i in np.arange(begin, end)[role[begin:end] > 0]:
                able = (labels != label[i]) & (100 * np.minimum(sizes, n[i]) >= PERCENT * np.maximum(sizes, n[i]))
                if role[i] == 2:  # outside too: each such pair once
                    able &= reps < rep[i]
                at = np.flatnonzero(able)
                same = sigs[at] == sig[i]
                near_by = SYMBOLS - same.sum(axis=1) <= MOST_APART
                at, same = at[near_by], same[near_by]
                at = at[lowest_pick(same) == pick] if len(at) else at
                own = None
                for j in at:
                    p, q = root(labels[j]), root(label[i])
                    if p == q:
                        continue
                    if j not in sets:
                        sets[j] = _unpacked(texts[j], held)
                    if own is None:
                        own = _unpacked(packed[int(i)].as_py(), held)
                    if linked(sets[j], own):
                        up[max(p, q)] = min(p, q)
                        out.append((int(reps[j]), int(rep[i])))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, _LONG), pa.array(b, _LONG)], names=names)


def in_blocks(members: DataFrame, labels: DataFrame, texts: DataFrame, most: int, block: int = BLOCK, others: int = OTHERS) -> DataFrame:
    """Links (a, b) between members (key, rep), ``most`` at most, of one large bucket that have different labels.

    Those outside a bucket's largest component are dealt to parts of ``others``, all members to blocks of ``block``;
    each part meets each block in a group of its own, so that a task holds one part and reads a block through.
    """
    named = C.in_few_files(members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), most)
    counts = named.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("all"))
    mixed_keys = counts.where("x.c < all").select("key", F.col("x.label").alias("most"), F.ceil(F.col("all") / block).cast("int").alias("ms"), F.ceil((F.col("all") - F.col("x.c")) / others).cast("int").alias("rs"))
    rows = named.join(mixed_keys, "key").withColumn("outside", F.col("label") != F.col("most"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    some = rows.where("outside").select("key", all_of("ms").alias("m"), own("rs", 1).alias("r"), F.lit(0).alias("role"), "rep", "label")
    every = rows.select("key", own("ms", 2).alias("m"), all_of("rs").alias("r"), F.when(F.col("outside"), 2).otherwise(1).alias("role"), "rep", "label")
    joined = some.union(every).join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("key", "m", "r", "role", "rep", "label", "n", "sig", "packed")
    return joined.repartition("key", "m", "r").sortWithinPartitions("key", "m", "r", "role").mapInArrow(_between, "a long, b long")


def labelled(reps: DataFrame, texts: DataFrame, most_all: int = MOST_ALL, block: int = BLOCK, others: int = OTHERS) -> DataFrame:
    """(node, label) of the classes (rep, n, sig) that are linked with others: the smallest class that each reaches."""
    hot, most = hot_keys(reps, most_all), len(_PICKED) * reps.count()
    met = C.in_few_files(keyed(reps, hot, False).repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_meeting(most_all), sql_schema(_MET)), most)
    members = C.in_few_files(met.where("pick = 0").select(F.col("x").alias("key"), F.col("y").alias("rep")).union(keyed(reps, hot, True)), most)
    # Members of one group meet in many buckets. With a pivot of its own for each, every member would be paired with as many; by one of PIVOTS orders of classes they agree on few.
    pivots = members.groupBy("key").agg(F.min_by("rep", F.xxhash64(F.pmod("key", F.lit(PIVOTS)), "rep")).alias("pivot"))
    stars = members.join(pivots, "key").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    found = met.where("pick < 0").select(F.col("x").alias("a"), F.col("y").alias("b")).union(stars).distinct()
    able = near(found, reps).checkpoint()
    labels = components(confirmed(able, texts), able.count())
    if members.isEmpty():
        return labels
    return joined(labels, in_blocks(members, labels, texts, most, block, others).distinct().checkpoint())


def classes(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document. ``sizes`` are those of ``labelled``; they change the work, not the result."""
    C.prepare(docs.sparkSession)
    rows = signed(C.text_bytes(docs)).checkpoint()
    able = rows.where("n > 0 and doc_id is not null")
    by_class = able.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")).checkpoint()
    labels = labelled(by_class.select("rep", "n", "sig"), able.select("doc_id", "n", "sig", "packed"), **sizes)
    named = by_class.select("class", "rep").join(labels.toDF("rep", "label"), "rep", "left").select("class", F.coalesce("label", "rep").alias("label"))
    out = rows.select("doc_id", "n", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: DuckDB: the same by comparing all sets that share a shingle.
SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM toks WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM toks UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM toks t LEFT JOIN sizes s USING (doc_id) JOIN least_ids c ON c.a = t.doc_id
"""
