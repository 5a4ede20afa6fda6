"""Thresholds and labels: sweeps, metrics, samples, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollups import spread


def ratio(a, b):
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def sweep(rows: DataFrame, by: list[str], steps: int = 100, last: int | None = None) -> DataFrame:
    """Metrics at each threshold i / steps, from cumulative counts by bucket: one pass, no row meets every threshold.

    rows: by..., y (0 or 1), milli (score in thousandths). i goes up to ``last``, or to steps - 1.
    """
    bucket = F.floor(F.col("milli") * steps / 1000).cast("int")
    counts = rows.groupBy(*by, bucket.alias("i")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    grid = counts.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = Window.partitionBy(*by).orderBy(F.desc("i"))
    all_rows = grid.join(counts, [*by, "i"], "left").na.fill({"p": 0, "q": 0}).withColumns({"tp": F.sum("p").over(above), "fp": F.sum("q").over(above)})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")
    return all_rows.where(f"i between 1 and {last or steps - 1}").select(*by, "i", "tp", "fp", fn.alias("fn"), (F.col("neg") - fp).alias("tn"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, F.col("pos")), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(ratio(fp, F.col("neg")), 6).alias("fpr"))


def best(swept: DataFrame, by: list[str], most_fpr: float = 0.35) -> DataFrame:
    """The threshold with the best F1 within the false positive rate; of equal ones the higher."""
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), F.desc("i"))
    return swept.where(F.col("fpr") <= most_fpr).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def best_fine(rows: DataFrame, by: list[str], most_fpr: float = 0.35, tie: float = 0.005, around: int = 50) -> DataFrame:
    """Two passes: the best threshold in hundredths (of equal ones the lowest), then the best in thousandths within ``around`` of it.

    From the best F1 down, a threshold whose F1 is less than ``tie`` under that of the one chosen so far replaces it if it is higher.
    A group in which no threshold is within the false positive rate has 1.0.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), "i")
    low_rate = F.col("fpr") <= most_fpr
    center = sweep(rows, by).where(low_rate).withColumn("r", F.row_number().over(order)).where("r = 1").select(*by, (F.col("i") * 10).alias("center"))
    fine = sweep(rows, by, 1000, 1000)
    near = fine.join(center, by, "left").where((F.col("center").isNull() & (F.col("i") == 1000)) | (low_rate & F.col("i").between(F.col("center") - around, F.col("center") + around)))
    found = near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("f1")).alias("down"), *(c for c in fine.columns if c not in by)))).alias("found"))
    closer = lambda best, x: F.when((best["f1"] - x["f1"] < tie) & (x["i"] > best["i"]), x).otherwise(best)
    return found.select(*by, F.aggregate(F.slice("found", 2, 2 * around + 1), F.get("found", 0), closer).alias("x")).select(*by, *(F.col(f"x.{c}") for c in fine.columns if c not in by))


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from columns truth and predicted."""
    per = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("truth") == F.col("predicted")).cast("int").alias("h")))).alias("x")).groupBy(F.col("x.c").alias("class")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    hits = F.col("hits")
    return per.select("class", "support", F.round(ratio(hits, F.col("predicted")), 6).alias("precision"), F.round(ratio(hits, F.col("support")), 6).alias("recall"), F.round(ratio(2 * hits, F.col("support") + F.col("predicted")), 6).alias("f1"))


def confusion(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.where("truth <> predicted").groupBy("truth", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "predicted").limit(k)


def order_key(column, seed: str = "42"):
    """A fixed pseudo-random order: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")))


def stratified(rows: DataFrame, strata: list[str], key: str, share: float) -> DataFrame:
    """max(1, round(share * n)) rows of each stratum."""
    w = Window.partitionBy(*strata)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(order_key(key), key)), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5))).drop("_r", "_n")


def folds(rows: DataFrame, strata: list[str], key: str, k: int = 5) -> DataFrame:
    """Each stratum dealt out in turn to k folds."""
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy(*strata).orderBy(order_key(key), key)) - 1) % k).cast("int"))


def split(rows: DataFrame, strata: list[str], key: str, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    w = Window.partitionBy(*strata)
    place = F.row_number().over(w.orderBy(order_key(key), key)) / F.count("*").over(w)
    return rows.withColumn("part", F.when(place <= train, "train").when(place <= train + validate, "validate").otherwise("test"))


def votes(rows: DataFrame, item: str, vote: str, least: int = 3, first: str = "a", second: str = "b") -> DataFrame:
    """Consensus: ``first`` with at least ``least`` votes, else ``second`` with as many, else neutral."""
    n = lambda v: F.sum((F.col(vote) == v).cast("long"))
    per = rows.groupBy(item).agg(n(first).alias("n_first"), n(second).alias("n_second"), F.count("*").alias("n"))
    return per.withColumn("consensus", F.when(F.col("n_first") >= least, first).when(F.col("n_second") >= least, second).otherwise("neutral"))


def multi_label(rows: DataFrame, by: str) -> DataFrame:
    """Exact match, Hamming loss, Jaccard and F1 averaged over samples, from long rows (by, goal, y, p) of 0 and 1. No label on either side counts as a match."""
    n = lambda c: F.sum(c.cast("int"))
    both = n((F.col("y") == 1) & (F.col("p") == 1)).alias("both")
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"), both, n(F.col("y") != F.col("p")).alias("off"))
    either = F.col("y") + F.col("p") - F.col("both")
    jaccard = F.when(either == 0, 1.0).otherwise(F.col("both") / either)
    f1 = F.when(F.col("y") + F.col("p") == 0, 1.0).otherwise(2 * F.col("both") / (F.col("y") + F.col("p")))
    mean = lambda c, k: F.round(F.avg(c), 6).alias(k)
    return per.agg(mean((F.col("off") == 0).cast("double"), "exact"), mean(F.col("off") / F.col("n"), "hamming"), mean(jaccard, "jaccard"), mean(f1, "sample_f1"))


def weight_grid(rows: DataFrame, by: list[str], truth: str, steps: int = 10) -> DataFrame:
    """Accuracy of the top goal for each weight i / steps of bert against st. The grid is of fixed size."""
    grid = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("s", F.round(F.col("i") / steps * F.col("bert") + (1 - F.col("i") / steps) * F.col("st"), 8))
    top = grid.groupBy("i", *by).agg(F.max(F.struct("s", (-F.col("goal")).alias("g"))).alias("x"), F.first(truth).alias("truth"))
    return top.groupBy("i").agg(F.count("*").alias("n"), F.sum((-F.col("x.g") == F.col("truth")).cast("long")).alias("hits"))


#: Words are counted in so many buckets; the counts only order a set's words.
_BUCKETS = 1 << 16


def _parity(hashes: Column) -> Column:
    """256 bits of a set, each the parity of how many of its hashes fall to it: two sets differ by at least as many words as bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))
    part = lambda s, x, i: s[f"p{i}"].bitwiseXOR(F.when(x.bitwiseAND(F.lit(3)) == i, bit(x)).otherwise(F.lit(0).cast("long"))).alias(f"p{i}")
    return F.aggregate(hashes, F.struct(*(F.lit(0).cast("long").alias(f"p{i}") for i in range(4))), lambda s, x: F.struct(*(part(s, x, i) for i in range(4))))


def similar(docs: DataFrame, key: str, words: str, percent: int = 90) -> DataFrame:
    """(key, class_id, links): rows with equal word sets are a class, named after its smallest key; links says how many other
    rows have a set of a Jaccard similarity of over ``percent`` in a hundred, those of the class included. Rows without words are left out.

    Classes are joined on the first words that such a pair must share, in the order of the words' rough frequency, which is counted in a
    table of fixed size. A pair goes on if the lengths, the places of the shared word and a parity of the words' hashes, all of them bounds of what the sets can share,
    allow it; only then are the sets themselves, as one string each, compared. Pairs are made between classes only.
    """
    sets = docs.select(F.col(key).alias("k"), F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("w")).where("w <> ''").withColumn("h", F.unhex(F.sha2("w", 256)))
    classes = sets.groupBy("h").agg(F.min("k").alias("c"), F.count("*").alias("m"), F.first("w").alias("w"))
    bucket = lambda x: F.pmod(x, F.lit(_BUCKETS)).cast("int")
    counts = sets.select(F.explode(F.split("w", " ")).alias("x")).groupBy(bucket(F.xxhash64("x")).alias("i")).agg(F.count("*").alias("n"))
    filled = docs.sparkSession.range(_BUCKETS).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left")
    table = F.broadcast(filled.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("_n")).select(F.col("_n")["n"].alias("_n")))  # one row of fixed size
    hashed = classes.select("c", F.transform(F.split("w", " "), lambda x: F.xxhash64(x)).alias("x")).join(table)
    order = F.array_sort(F.transform("x", lambda x: F.struct(F.get(F.col("_n"), bucket(x)).alias("n"), x.alias("x"))))
    ranked = hashed.select("c", F.size("x").alias("n"), F.slice(order, F.lit(1), F.size("x") - F.floor(F.size("x") * percent / 100).cast("int"))["x"].alias("first"), _parity(F.col("x")).alias("p"))
    prefix = ranked.select("c", "n", "p.*", F.posexplode("first").alias("i", "word"))
    a, b = (prefix.select("word", *(F.col(x).alias(f"{x}{side}") for x in ("c", "n", "i", "p0", "p1", "p2", "p3"))) for side in "ab")
    least = F.floor(percent * (F.col("na") + F.col("nb")) / (100 + percent)) + 1  # words that a pair must share
    spare = F.col("na") + F.col("nb") - 2 * least
    met = a.join(b, "word").where(
        (F.col("ca") < F.col("cb")) & (100 * F.least("na", "nb") > percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least) & (F.col("ia") + F.col("ib") <= spare)
        & (sum((F.bit_count(F.col(f"p{i}a").bitwiseXOR(F.col(f"p{i}b"))) for i in range(4)), F.lit(0)) <= spare)
    ).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    own = classes.select("c", "m", "w")
    full = met.join(own.toDF("a", "ma", "wa"), "a").join(own.toDF("b", "mb", "wb"), "b")
    sizes = full.select("a", "ma", "b", "mb", F.size(F.array_intersect(F.split("wa", " "), F.split("wb", " "))).alias("both"), F.size(F.split("wa", " ")).alias("x"), F.size(F.split("wb", " ")).alias("y"))
    linked = sizes.where(100 * F.col("both") > percent * (F.col("x") + F.col("y") - F.col("both")))
    each = linked.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("mb").alias("m")), F.struct(F.col("b").alias("c"), F.col("ma").alias("m")))).alias("e")).select("e.*")
    links = each.groupBy("c").agg(F.sum("m").alias("l"))
    return sets.select("k", "h").join(classes.select("h", "c", "m"), "h").join(links, "c", "left").select(F.col("k").alias(key), F.col("c").alias("class_id"), (F.col("m") - 1 + F.coalesce("l", F.lit(0))).alias("links"))


def forced(rows: DataFrame, by: str, threshold: float, score: str = "score") -> DataFrame:
    """Adds p, the predictions at a threshold; where a sample has none, its best goal (the lower of equal ones) is taken."""
    w = Window.partitionBy(by)
    best = F.max(F.struct(score, (-F.col("goal")).alias("g"))).over(w)
    return rows.withColumn("p", ((F.col(score) >= threshold) | ((F.max(score).over(w) < threshold) & (F.col("goal") == -best["g"]))).cast("int"))


def per_goal(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of each goal from long rows (goal, y, p) of 0 and 1."""
    n = lambda c: F.sum(c.cast("long"))
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.groupBy("goal").agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))


def micro_macro(rows: DataFrame, by: str) -> DataFrame:
    """Micro and macro precision, recall and F1 over goals, and the share of samples whose goals are all right."""
    g, tp, fp, fn = per_goal(rows), F.col("tp"), F.col("fp"), F.col("fn")
    s = lambda c: F.sum(c)
    counts = g.agg(
        F.round(ratio(s(tp), s(tp + fp)), 6).alias("micro_precision"), F.round(ratio(s(tp), s(tp + fn)), 6).alias("micro_recall"), F.round(ratio(2 * s(tp), s(2 * tp + fp + fn)), 6).alias("micro_f1"),
        F.round(F.avg(ratio(tp, tp + fp)), 6).alias("macro_precision"), F.round(F.avg(ratio(tp, tp + fn)), 6).alias("macro_recall"), F.round(F.avg(ratio(2 * tp, 2 * tp + fp + fn)), 6).alias("macro_f1"),
    )
    subset = rows.groupBy(by).agg(F.min((F.col("y") == F.col("p")).cast("int")).alias("ok")).agg(F.round(F.avg("ok"), 6).alias("subset_accuracy"))
    return counts.join(F.broadcast(subset), how="cross")  # one row each


def single_label(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted precision, recall, F1 and macro F2 from columns truth and predicted."""
    per = per_class(rows)
    f2 = ratio(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall"))
    known, n = per.where("support > 0"), F.sum("support")
    mean = lambda c, k: F.round(F.avg(c), 5).alias(k)
    weighed = lambda c, k: F.round(F.sum(F.col(c) * F.col("support")) / n, 5).alias(k)
    out = known.agg(*(mean(F.col(c), f"macro_{c}") for c in ("precision", "recall", "f1")), mean(f2, "macro_f2"), *(weighed(c, f"weighted_{c}") for c in ("precision", "recall", "f1")))
    return out.join(F.broadcast(rows.agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), 6).alias("accuracy"))), how="cross")


def cardinality(rows: DataFrame, by: str) -> DataFrame:
    """How many samples have 0 to 4 labels, or 5 and more; with the mean number of labels and its share of all goals."""
    per = rows.groupBy(by).agg(F.sum("y").alias("k"), F.count("*").alias("goals"))
    whole = per.agg(F.round(F.avg("k"), 6).alias("cardinality"), F.round(F.avg(F.col("k") / F.col("goals")), 6).alias("density"))
    return per.groupBy(F.least("k", F.lit(5)).alias("labels")).agg(F.count("*").alias("n")).join(F.broadcast(whole), how="cross")


def score_statistics(rows: DataFrame, by: list[str], score: str = "milli") -> DataFrame:
    """Smallest, largest, mean, population deviation and median of whole-numbered scores."""
    n, s, q = F.count("*"), F.sum(score), F.sum(F.col(score) * F.col(score))
    return rows.groupBy(*by).agg(n.alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.round(s / n, 4).alias("mean"), F.round(F.sqrt(spread(n, s, q)) / n, 4).alias("deviation"), F.median(score).alias("median"))


def compared(rows: DataFrame) -> DataFrame:
    """Of columns truth, first and second: how often both models agree, each is right, and both are."""
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("first") == F.col("truth"), F.col("second") == F.col("truth")
    return rows.agg(F.count("*").alias("n"), n(F.col("first") == F.col("second")).alias("agree"), n(a).alias("first_right"), n(b).alias("second_right"), n(a & b).alias("both_right"))


def cross_validated(rows: DataFrame, by: list[str], fold: str = "fold", steps: int = 100) -> DataFrame:
    """For each group and fold: the threshold with the best F1 on the other folds (the higher of equal ones), its F1 there and on the fold, and whether it keeps nine tenths of it.

    Counts are made once for each fold and step; those of the other folds are all less the fold's own.
    """
    counts = sweep(rows, [*by, fold], steps).select(*by, fold, "i", "tp", "fp", "fn")
    w = Window.partitionBy(*by, "i")
    f1 = lambda t, p, n: F.round(ratio(2 * t, 2 * t + p + n), 6)
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("tp", "fp", "fn")}
    both = counts.withColumns({"inside": f1(rest["tp"], rest["fp"], rest["fn"]), "outside": f1(F.col("tp"), F.col("fp"), F.col("fn"))})
    best = both.withColumn("r", F.row_number().over(Window.partitionBy(*by, fold).orderBy(F.desc("inside"), F.desc("i")))).where("r = 1")
    return best.select(*by, fold, "i", "inside", "outside", (F.col("outside") >= 0.9 * F.col("inside")).alias("holds"))


def boost_effects(rows: DataFrame) -> DataFrame:
    """Of rows (goal, y, before, after: is aligned): what only the boost aligns, and how much of that is wrong, by goal."""
    new = F.col("after") & ~F.col("before")
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("goal").agg(n(new).alias("new"), n(new & (F.col("y") == 1)).alias("right"), n(new & (F.col("y") != 1)).alias("wrong"))


def by_signature(rows: DataFrame, key: str, share: float) -> DataFrame:
    """A share of the samples of each set of labels, one at least, from long rows (key, goal, y)."""
    signature = F.array_join(F.array_sort(F.collect_list(F.when(F.col("y") == 1, F.col("goal")))).cast("array<string>"), ",")
    return stratified(rows.groupBy(key).agg(signature.alias("signature")), ["signature"], key, share)


def allocated(rows: DataFrame, tier: str, key: str, allocation: dict[str, int]) -> DataFrame:
    """So many rows of each tier, in a fixed pseudo-random order."""
    wanted = F.create_map(*(x for k, v in allocation.items() for x in (F.lit(k), F.lit(v))))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(tier).orderBy(order_key(key), key)))
    return ranked.where(F.col("_r") <= F.coalesce(wanted[F.col(tier).cast("string")], F.lit(0))).drop("_r")


def drawn(rows: DataFrame, key: str, n: int, without: DataFrame | None = None) -> DataFrame:
    """n rows in a fixed pseudo-random order, none whose key is in ``without``."""
    left = rows if without is None else rows.join(without.select(key), key, "left_anti")
    return left.orderBy(order_key(key), key).limit(n)


def test_split(rows: DataFrame, goal: str, key: str, share: float = 0.2) -> DataFrame:
    """A share of each goal's rows, one at least, is for testing."""
    w = Window.partitionBy(goal)
    place, n = F.row_number().over(w.orderBy(order_key(key), key)), F.count("*").over(w)
    return rows.withColumn("is_test", place <= F.greatest(F.lit(1), F.floor(n * share + 0.5)))


def training_pairs(rows: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """Each text with each variant of its goal's wording, and the batch that it goes to: no batch has a goal twice."""
    pairs = rows.join(goals, "goal")
    batch = F.row_number().over(Window.partitionBy("goal").orderBy(order_key(key), key, "variant")) - 1
    return pairs.withColumn("batch", batch)


def consensus(rows: DataFrame, item: str, rater: str, vote: str, score: str, raters: int, least: int = 3, first: str = "a", second: str = "b") -> DataFrame:
    """Items that all raters have judged: the votes in raters' order, the consensus, and the mean score."""
    n = lambda v: F.sum((F.col(vote) == v).cast("long"))
    per = rows.groupBy(item).agg(F.count_distinct(rater).alias("n_raters"), n(first).alias("n_first"), n(second).alias("n_second"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rater, vote))), lambda x: x[vote]), "").alias("votes"), F.round(F.avg(score), 6).alias("mean_score"))
    label = F.when(F.col("n_first") >= least, first).when(F.col("n_second") >= least, second).otherwise("neutral")
    return per.where(F.col("n_raters") == raters).select(item, "votes", label.alias("consensus"), "mean_score")


def missed(facts: DataFrame, targets: DataFrame, key: str, threshold, most: int = 200) -> DataFrame:
    """Per goal what its misses look like: true labels (key, goal, score, y) under the threshold, and how their best target (key, goal, target, score) does.

    Of a goal's misses ``most`` are looked at, in a fixed pseudo-random order: that is the feature's sample. Gives the goal's misses, those looked at, the share whose best target reaches the threshold, and both means.
    """
    misses = facts.where((F.col("y") == 1) & (F.col("score") < threshold))
    w = Window.partitionBy("goal")
    some = misses.withColumns({"_r": F.row_number().over(w.orderBy(order_key(key), key)), "misses": F.count("*").over(w)}).where(F.col("_r") <= most)
    best = targets.groupBy(key, "goal").agg(F.max("score").alias("best"))
    rows = some.join(best, [key, "goal"], "left").withColumn("reaches", F.coalesce(F.col("best") >= threshold, F.lit(False)).cast("int"))
    mean = lambda c: F.round(F.avg(c), 5)
    return rows.groupBy("goal").agg(F.first("misses").alias("misses"), F.count("*").alias("looked_at"), mean("reaches").alias("target_rate"), mean("score").alias("mean_score"), mean("best").alias("mean_target"))
