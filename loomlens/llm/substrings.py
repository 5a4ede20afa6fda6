"""Repeated passages: a depth-limited, most-significant-digit radix sort of suffixes.

The sort goes only as deep as the threshold of 200 bytes; suffixes that are equal so far are exactly the
repeated windows. The digits aren't of equal size. The first digit of a window is its sync gram, 32 of
its bytes picked by content, so that one row stands for the run of windows that share it; rows whose
first digit is met once drop out. The second digit is all bytes of the run: rows that agree in it are
repeated throughout. What is left, runs with a repeated gram but bytes of their own, gets a third digit, SIDE bytes beside the
gram: those before it for the windows that hold these, those after it for the others. Rows that agree in it are sorted window by
window, to the full depth. A partition settles its own repeated runs before the shuffle and sends on one
witness of each. Grams found to be very frequent in a sample of the texts are dealt out with their second digit from the start;
this changes where rows are sorted, not the result. A group of over HOT rows that agree in the third digit goes window by window through a counted, map-side
combined shuffle. Texts are moved compressed. Digits are 64-bit hashes.

Nulls and edges: a null text is empty; texts of under 200 bytes lose nothing; a null doc_id is carried as it is.
Repeated rows of at least 200 bytes lose all they have, as each is the other's copy. An empty table gives no row. Very long texts are taken whole. ``removed`` leaves columns other than doc_id and text out, whatever their names;
``cleaned`` keeps them.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import sql_schema
from .spans import DEPTH, GRAM, Rolled, mixed, sync_points

#: Rows of one gram sorted in a task at most; larger groups go through the shuffle window by window.
HOT = 20_000
#: Bytes of the third digit. A window has as many before its gram or after it.
SIDE = (DEPTH - GRAM) // 2
#: One text in so many is looked at for frequent grams: those of a five-hundredth of its rows or more.
SAMPLED, FREQUENT = 64, 500
#: Bytes of text whose sync points a task holds at once.
CHUNK = 4 << 20

_KEYS = ["k1", "k2"]
_I = pa.int64()
COVERED, RUN, WINDOW = 0, 1, 2
#: Bits of many: a run met twice, and one of a frequent gram.
TWICE, OFTEN = 1, 2
_SYNC = pa.schema([(n, _I) for n in ("kind", "p", "g", "c", "many", "k1", "k2", "a", "z")])
_SPANS = pa.schema([(n, _I) for n in ("kind", "g", "k1", "k2", "a", "z")])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both: rows of one key are equal."""
    return C.text_bytes(docs).select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").cast("long").alias("k2"), "doc_id", "text")


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], schema=schema)


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[1:] == y[:-1]


def _settled(parts: list, often: np.ndarray) -> pa.RecordBatch:
    """Rows of a chunk: runs met twice in it, joined with their neighbours in the text, as COVERED; the others, and a witness of each such run, as RUN."""
    k1, k2, g, a, z, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first, inverse, counts = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    sent = ~twice
    sent[first] = True
    fresh = twice & ~np.concatenate([[False], twice[:-1] & (a[1:] == z[:-1] + 1) & _same(k1, k1) & _same(k2, k2)])
    begin = np.flatnonzero(fresh)
    group = np.cumsum(fresh)[twice] - 1
    end = np.full(len(begin), 0)
    np.maximum.at(end, group, z[twice])
    n, s = len(begin), int(sent.sum())
    zero = np.zeros(n, np.int64)
    hot = np.isin(g[sent], often)
    return _batch(
        _SYNC,
        np.concatenate([zero + COVERED, np.full(s, RUN)]),
        np.concatenate([k1[begin], np.where(hot, mixed(g[sent] + c[sent]), g[sent]).view(np.int64)]),
        np.concatenate([zero, g[sent].view(np.int64)]),
        np.concatenate([zero, c[sent].view(np.int64)]),
        np.concatenate([zero, twice[sent] * TWICE + hot * OFTEN]),
        np.concatenate([k1[begin], k1[sent]]),
        np.concatenate([k2[begin], k2[sent]]),
        np.concatenate([a[begin], a[sent]]),
        np.concatenate([end, z[sent]]),
    )


def _sync_rows(often: np.ndarray):
    def run(batches):
        parts, size = [], 0
        for b in batches:
            for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for g, _, a, z, c in sync_points(text):
                    parts.append((np.full(len(g), k1), np.full(len(g), k2), g, a, z, c))
                size += len(text)
                if size >= CHUNK and parts:
                    yield _settled(parts, often)
                    parts, size = [], 0
        if parts:
            yield _settled(parts, often)

    return run


def frequent_grams(texts: DataFrame) -> np.ndarray:
    """Grams that a sample of the texts shows to be frequent: FREQUENT of them at most."""

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                for g, *_ in sync_points(text):
                    found, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["g", "n"])

    counts = texts.where(F.pmod("k1", F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.array([r["g"] for r in counts.where(F.col("n") * FREQUENT >= max(total, 8 * FREQUENT)).select("g").collect()], dtype=np.int64).view(np.uint64)


def _verdicts(batches):
    """Rows sorted by gram and bytes to spans: a look at the row before and the row after is all it takes."""
    held = None
    for b in batches:
        rows = {n: b.column(i).to_numpy() for i, n in enumerate(_SYNC.names)}
        if held is not None:
            rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
        yield from _judged(rows, 2 if held is not None and len(held["g"]) > 1 else int(held is not None) - 1, False)
        held = {n: v[-2:] for n, v in rows.items()}
    if held is not None:
        yield from _judged(held, len(held["g"]), True)


def _judged(rows: dict, skip: int, last: bool):
    """Of rows with their neighbours, those not judged yet: all but the first of the two held over, and the last one only at the end."""
    n = len(rows["g"])
    is_run = rows["kind"] == RUN
    same_g = np.concatenate([[False], _same(rows["g"], rows["g"]) & is_run[1:] & is_run[:-1], [False]])
    same_c = same_g & np.concatenate([[False], _same(rows["c"], rows["c"]), [False]])
    repeated = same_c[:-1] | same_c[1:] | (rows["many"] & TWICE > 0)
    other = (same_g[:-1] & ~same_c[:-1]) | (same_g[1:] & ~same_c[1:]) | (rows["many"] & OFTEN > 0)
    judge = np.ones(n, bool)
    if skip >= 0:
        judge[: max(0, (n if last else skip) - 1)] = False
    if not last:
        judge[-1] = False
    for kind, mask in ((COVERED, ~is_run | repeated), (RUN, is_run & other)):
        at = np.flatnonzero(mask & judge)
        if len(at):
            yield _batch(_SPANS, np.full(len(at), kind), *(rows[x][at] for x in ("g", "k1", "k2", "a", "z")))


_BYTES = pa.schema([("g", _I), ("k1", _I), ("k2", _I), ("a", _I), ("data", pa.binary())])


def _sides(g: np.ndarray, k1: np.ndarray, k2: np.ndarray, a: np.ndarray, data: list[bytes]):
    """Runs, cut in two by where their windows have SIDE bytes beside the gram; g becomes the hash of gram and side."""
    sizes = np.array([len(x) for x in data])
    begin = np.cumsum(sizes) - sizes
    rolled = Rolled(np.frombuffer(b"".join(data), np.uint8))
    gram, side = mixed(rolled.of(GRAM)), rolled.of(SIDE)
    row = np.repeat(np.arange(len(data)), sizes)[: len(gram)]
    at = np.flatnonzero(gram == g[row])
    _, first = np.unique(row[at], return_index=True)
    m = at[first] - begin  # the first place of the gram: the sync point
    last = sizes - DEPTH  # the last window's start, from the run's
    for after in (False, True):
        low, high = (np.maximum(0, m - SIDE + 1), last) if after else (np.zeros(len(m), np.int64), np.minimum(last, m - SIDE))
        own = np.flatnonzero(low <= high)
        where = begin[own] + m[own] + (GRAM if after else -SIDE)
        key = mixed(g[own] + mixed(side[where] + np.uint64(after)))
        yield from zip(key.view(np.int64).tolist(), k1[own].tolist(), k2[own].tolist(), (a[own] + low[own]).tolist(), [data[i][lo : hi + DEPTH] for i, lo, hi in zip(own, low[own], high[own], strict=True)], strict=True)


def _cut(batches):
    """The bytes of the runs that are sorted further."""
    import zstandard

    for b in batches:
        rows = []
        for k1, k2, packed, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = zstandard.decompress(packed)
            rows += [(r["g"], k1, k2, r["a"], text[r["a"] : r["z"] + DEPTH]) for r in runs]
        for at in range(0, len(rows), 10_000):
            g, k1, k2, a, data = zip(*rows[at : at + 10_000], strict=True)
            out = list(_sides(np.array(g, np.int64).view(np.uint64), np.array(k1), np.array(k2), np.array(a), list(data)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _BYTES.types, strict=True)], schema=_BYTES)


def _windows(rows: list):
    """Of rows (g, k1, k2, a, data): row, start and hash of every window."""
    sizes = np.array([len(r[4]) for r in rows])
    hashes = mixed(Rolled(np.frombuffer(b"".join(r[4] for r in rows), np.uint8)).of(DEPTH))
    row = np.repeat(np.arange(len(rows)), sizes - DEPTH + 1)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes - DEPTH + 1) - (sizes - DEPTH + 1), sizes - DEPTH + 1)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes - DEPTH + 1) + inside
    return row, np.array([r[3] for r in rows])[row] + inside, hashes[at]


def _sorted_out(batches):
    """Rows sorted by gram to spans of repeated windows; the windows themselves where a gram has too many rows."""
    held, group, hot = [], [], None

    def settle(rows):
        if not rows:
            return
        row, start, h = _windows(rows)
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        fresh = again & ~np.concatenate([[False], again[:-1] & _same(row, row)])
        last = again & ~np.concatenate([again[1:] & _same(row, row), [False]])
        own, k = row[fresh], lambda i: np.array([r[i] for r in rows], np.int64)
        if len(own):
            yield _batch(_SPANS, np.full(len(own), COVERED), np.zeros(len(own), np.int64), k(1)[own], k(2)[own], start[fresh], start[last])

    def spread(rows):
        row, start, h = _windows(rows)
        k = lambda i: np.array([r[i] for r in rows], np.int64)
        yield _batch(_SPANS, np.full(len(row), WINDOW), h, k(1)[row], k(2)[row], start, start)

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and r[0] != group[0][0]:
                if hot == group[0][0]:
                    yield from spread(group)
                else:
                    held += group
                group, hot = [], None
                if len(held) >= 500:
                    yield from settle(held)
                    held = []
            group.append(r)
            if len(group) >= HOT:
                hot = r[0]
                yield from spread(group[:-1])
                group = group[-1:]
    if group and hot == group[0][0]:
        yield from spread(group)
        group = []
    yield from settle(held + group)


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): k1, k2, doc_id and packed text of every row; and for each key the spans (a, z) of starts of repeated windows."""
    C.prepare(docs.sparkSession)
    rows = keyed(docs)
    run = "kind long, g long, k1 long, k2 long, a long, z long"

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([press.compress(t) for t in b.column(3).to_pylist()], pa.binary())], names=["k1", "k2", "doc_id", "packed"])

    texts = rows.mapInArrow(pack, "k1 long, k2 long, doc_id long, packed binary")
    able = rows.where(F.length("text") >= DEPTH).select("k1", "k2", "text")
    synced = able.mapInArrow(_sync_rows(frequent_grams(able)), sql_schema(_SYNC))
    judged = synced.repartition("p").sortWithinPartitions("kind", "g", "c").mapInArrow(_verdicts, run).checkpoint()
    further = judged.where(F.col("kind") == RUN).groupBy(*_KEYS).agg(F.collect_set(F.struct("g", "a", "z")).alias("runs"))
    cut = texts.join(further, _KEYS).select("k1", "k2", "packed", "runs").mapInArrow(_cut, "g long, k1 long, k2 long, a long, data binary")
    found = cut.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_out, run).checkpoint()
    windows = found.where(F.col("kind") == WINDOW)
    again = windows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    both = judged.union(found).where(F.col("kind") == COVERED).select("k1", "k2", "a", "z")
    return texts, both.union(windows.join(again, "g").select("k1", "k2", "a", "z"))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of bytes [from, to) under spans of starts."""
    out: list[list[int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + DEPTH)
        else:
            out.append([a, z + DEPTH])
    return [tuple(x) for x in out]


def _joined(docs: DataFrame) -> DataFrame:
    texts, found = spans(docs)
    by_key = found.groupBy(*_KEYS).agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    return texts.join(by_key, _KEYS, "left").select("doc_id", "packed", "spans", *_KEYS)


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, z in gone:
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans ([from, to)) of every document."""
    fields = [("doc_id", _I), ("n_bytes", _I), ("n_removed", _I), ("n_spans", _I), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(_I)))]

    def run(batches):
        import zstandard

        for b in batches:
            out = []
            for doc_id, packed, found in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                text = zstandard.decompress(packed)
                gone = merged([(s["a"], s["z"]) for s in found or ()])
                out.append((doc_id, len(text), sum(z - a for a, z in gone), len(gone), sha256(without(text, gone)).hexdigest(), gone))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return _joined(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents' columns with the repeated passages cut out of the texts; characters cut in part go as a whole.

    n_chars, if there, is counted anew. Null texts stay null.
    """
    C.prepare(docs.sparkSession)
    _, found = spans(docs)
    marked = C.spare(docs.columns, "_spans")
    by_key = found.groupBy(*_KEYS).agg(F.collect_set(F.struct("a", "z")).alias(marked)).toDF("k1", "k2", marked)
    text, doc_id = F.coalesce(docs["text"].cast("binary"), F.lit(b"")), docs["doc_id"].cast("long")
    joined = docs.join(by_key, (F.xxhash64(doc_id, text) == by_key["k1"]) & (F.hash(text, doc_id).cast("long") == by_key["k2"]), "left").select(*(docs[c] for c in docs.columns), by_key[marked])
    at, spans_at = docs.columns.index("text"), len(docs.columns)
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for b in batches:
            new = [t if not s else without(t.encode(), merged([(x["a"], x["z"]) for x in s])).decode(errors="ignore") for t, s in zip(b.column(at).to_pylist(), b.column(spans_at).to_pylist(), strict=True)]
            columns = list(b.columns[:spans_at])
            columns[at] = pa.array(new, pa.string())
            if count_at is not None:
                columns[count_at] = pa.array([None if t is None else len(t) for t in new], columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:spans_at])

    return joined.mapInArrow(cut, docs.schema)
