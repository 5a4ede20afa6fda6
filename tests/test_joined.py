import random

from pyspark.sql import functions as F

from loomlens.functions import text as T
from loomlens.operators import extraction as EX


def plain(parts, most):
    out = []
    for s in parts:
        leans = s.split(" ")[0].lower() in EX.OPENERS
        if out and leans and len(out[-1].split()) + len(s.split()) <= most:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_sentences_that_lean_are_joined(spark):
    rng = random.Random(4)
    opener, plain_start = EX.OPENERS[0], "Council"
    sentence = lambda: " ".join([rng.choice([opener, opener.title(), EX.OPENERS[-1], plain_start])] + ["w"] * rng.randint(0, 5))
    rows = [(i, [sentence() for _ in range(rng.randint(0, 12))]) for i in range(200)] + [(900, [plain_start, *[f"{opener} x"] * 300])]
    frame = spark.createDataFrame(rows, "k int, s array<string>")
    for most in (4, 12, 500):
        got = {r.k: r.x for r in frame.select("k", T.joined_sentences(F.col("s"), EX.OPENERS, most).alias("x")).collect()}
        assert got == {k: plain(s, most) for k, s in rows}


def test_many_sentences_take_linear_time(spark):
    frame = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.when(i % 3 == 0, f"{EX.OPENERS[0]} it did").otherwise("Council built it")).alias("s"))
    assert frame.select(F.size(T.joined_sentences(F.col("s"), EX.OPENERS, 60))).first()[0] == 40_000
