import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from loomlens.llm import audit
from loomlens.llm import common as C

SCHEMA = "doc_id long, text string, source string, part string, mask int, n string, t string"
SF = "/root/testdata/sf0.001"


def masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, source in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and least[text] < i]
        out.append((i, source or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def brute(rows, labels):
    """Row by row: each order's filters applied one after the other."""
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    found, out = masks(rows), []
    for part in {p for _, p, _ in found}:
        own = [(i, m) for i, p, m in found if p == part]
        removed = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                here, stay = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                fails = sum(1 for _, m in own if m & bit)
                removed[f] += len(here)
                lines.append((part, "".join(order), step, len(stay), len(here), fails - len(here), sum(m == bit for _, m in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), f))
                left = stay
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


def some_rows():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        n = rng.choice([0, 3, 199, 200, 260])
        few = rng.random() < 0.4
        w = [(f"w{rng.randrange(9) if few else k}") for k in range(n)]
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        if rng.random() < 0.3:
            w.append(rng.choice("#$%&*|"))
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(w), rng.choice(["a", "b", None, ""])))
    rows += [(200 + i, "copy of one", "hot") for i in range(90)] + [(i, rows[i][1], "a") for i in range(20)] + [(300 + i, rows[i][1], "b") for i in range(20)]
    return rows + [(None, "copy of one", "a"), (None, None, "a"), (None, None, None), (401, None, "c"), (402, "", "c"), (403, "v " * 40_000, "c"), (404, "a b", "c"), (403, "v " * 40_000, "c")]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 2)] + [(3, None, 1), (3, 1, None), (3, 1, 0), (None, 1, 1), (201, None, None), (401, 1, 1), (999, 1, 1)]


def frames(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "n", "t") for i, t, s in rows], SCHEMA).repartition(5), spark.createDataFrame([(*x, "m") for x in LABELS], "doc_id long, quality int, toxic int, mask string")


def test_against_row_by_row_filters(spark):
    rows = some_rows()
    docs, labels = frames(spark, rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, audit.failures(docs).collect()), key=key) == sorted(masks(rows), key=key)
    assert sorted(map(tuple, audit.audit(docs, labels).collect())) == brute(rows, LABELS)


def test_transform_and_its_inverse(spark):
    rng = random.Random(1)
    n = {m: rng.randrange(10**12) for m in range(audit.MASKS)}
    rows = spark.createDataFrame([("p", m, m % 3 == 0, m % 5 == 0, k) for m, k in n.items()], "part string, mask int, good boolean, toxic boolean, n long")
    sums = audit.parity_sums(rows)
    assert sum(r["w5"] for r in sums.collect()) == sum(k * (-1) ** (5 & m).bit_count() for m, k in n.items())
    got = audit.cells(sums).first()
    assert got.n == [n[m] for m in range(32)] and got.good == [n[m] if m % 3 == 0 else 0 for m in range(32)] and got.toxic == [n[m] if m % 5 == 0 else 0 for m in range(32)]


def test_empty_tables(spark):
    docs, labels = frames(spark, some_rows()[:5])
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = audit.audit(C.table(spark, SF, "documents"), C.table(spark, SF, "labels")), con.execute(audit.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
