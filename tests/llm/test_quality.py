"""Importance resampling, recomputed document by document with plain counters."""

import math
import re
from collections import Counter
from hashlib import blake2b
from zlib import crc32

from loomlens.llm import quality

SCHEMA = "doc_id long, text string, key double, kept string"
SEED = 17


def grams(text):
    """Words as written and pairs of neighbours, as buckets."""
    ones = [crc32(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())]
    twos = [((a * 0x9E3779B1 + b * 0x85EBCA77 + 1) % 2**64) >> 7 for a, b in zip(ones, ones[1:], strict=False)]
    return [g % 2**15 for g in ones + twos]


def brute(rows, labels):
    known = [(i, y) for i, y in labels if i is not None and y in (0, 1)]
    good = {i for i, y in known if y == 1}
    raw = Counter(g for _, t in rows for g in grams(t))
    own = Counter(g for i, t in rows if i in good for g in grams(t))
    n_raw, n_own = sum(raw.values()) + 2**14, sum(own.values()) + 2**14
    ratio = lambda g: math.log((own[g] + 0.5) / n_own) - math.log((raw[g] + 0.5) / n_raw) if own else 0.0
    out = []
    for i, t in rows:
        weight = sum(ratio(g) for g in grams(t))
        u = (int.from_bytes(blake2b(f"{SEED} {i}".encode(), digest_size=7).digest()) + 0.5) / 2**56
        out.append((i, len(grams(t)), weight, weight - math.log(-math.log(u))))
    out.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    k = math.ceil((sum(y for _, y in known) / len(known) if own else 1.0) * len(rows))
    return [(*r, rank, rank <= k) for rank, r in enumerate(out, 1)]


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect(), key=lambda r: r.rank)
    want = brute(rows, labels)
    assert [(r.doc_id, r.n_grams, r.rank, r.kept) for r in got] == [(i, n, rank, kept) for i, n, _, _, rank, kept in want]
    for r, (_, _, weight, key, *_) in zip(got, want, strict=True):
        assert abs(r.log_weight - weight) < 1e-6 * max(1, abs(weight)) and abs(r.key - key) < 1e-6 * max(1, abs(key))


def test_models_keys_and_ranks(spark):
    rows = [(i, f"good words about roads {i % 7} and rivers, well told" if i % 3 else f"BUY now!!! cheap {i % 5} $$$ été") for i in range(90)]
    rows += [(100, None), (101, ""), (102, "long text " * 20_000), (None, "no id"), (7, rows[7][1]), (103, "only here")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 80, 2)] + [(None, 1), (3, None), (5, 7)]
    check(spark, rows, labels)


def test_no_good_labels(spark):
    check(spark, [(1, "a b"), (2, "c")], [(1, 0), (2, 0)])
