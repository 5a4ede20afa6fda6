"""Corrections of scores that words of a text make doubtful: an ordered program of rules for nine goals.

Scores stand side by side, one column s1 to s17 a goal; a goal without a score is null and stays so. A
module corrects one goal and is skipped where that goal has no score; each sees what the one before left.
A rule reads: goal, what must hold, kind, amount, method. Nothing is compared with words twice: each list is
looked up once a text, as a column of flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import correction_words as W
from ..functions import lexicons as L
from ..functions import text as T
from .alignment import threshold

GOALS = range(1, 18)
#: Flags that say whether a text has one of the words, or two different ones.
ONE = {
    "true17": W.TRUE_17, "local17": W.LOCAL_17, "not17": W.EXCLUDED_17, "17to11": W.TO_11_OF_17, "17to16": W.TO_16_OF_17, "17to8": W.TO_8_OF_17, "17to10": W.TO_10_OF_17, "17to9": W.TO_9_OF_17,
    "true11": W.TRUE_11, "not11": W.EXCLUDED_11, "11to3": W.TO_3_OF_11, "11to1": W.TO_1_OF_11, "11to8": W.TO_8_OF_11, "11play": W.PLAY_OF_11, "11to16": W.TO_16_OF_11,
    "works14": W.WORKS_14, "true14": W.TRUE_14,
    "true4": W.TRUE_4, "not4": W.EXCLUDED_4, "arts": ("arts",), "sports": ("sports",), "councillor": ("councillor",), "committee": ("committee",), "advocacy": ("advocacy",),
    "true6": W.TRUE_6, "not6": W.EXCLUDED_6, "6to11": W.TO_11_OF_6, "true8": W.TRUE_8, "not8": W.EXCLUDED_8, "true10": W.TRUE_10, "not10": W.EXCLUDED_10, "true12": W.TRUE_12, "not12": W.EXCLUDED_12,
    "true16": W.TRUE_16, "not16": W.EXCLUDED_16, "16to11": W.TO_11_OF_16, "16to12": W.TO_12_OF_16,
}
TWO = {"locals17": W.LOCAL_17, "marines14": W.TRUE_14}

#: Modules in their order. A condition may be a flag, its opposite (!), or either of two (|); "below" says that the module's goal has lost, "fair" that it began at 0.2 or more.
MODULES = {
    17: (
        (17, ("true17",), "add", 0.10, ""),
        (17, ("!true17",), "times", 0.6, "multiplier"), (17, ("!true17",), "add", -0.30, "multiplier"), (17, ("!true17", "not17"), "add", -0.20, "multiplier"), (17, ("!true17", "local17"), "add", -0.15, "multiplier"), (17, ("!true17",), "mark", None, "multiplier"),
        (11, ("!true17", "17to11"), "add", 0.15, "reassign"), (16, ("!true17", "17to16"), "add", 0.20, "reassign"), (8, ("!true17", "17to8"), "add", 0.15, "reassign"), (10, ("!true17", "17to10"), "add", 0.15, "reassign"), (9, ("!true17", "17to9"), "add", 0.15, "reassign"),
        (17, ("!true17",), "align", 0.85, "threshold"), (17, ("!true17", "locals17|not17"), "add", -0.30, "negative"),
    ),
    11: (
        (11, ("true11",), "add", 0.10, "bonus"), (11, ("!true11", "not11"), "add", -0.40, "bonus"), (11, ("!true11", "!not11"), "add", -0.35, "bonus"),
        (3, ("11to3",), "add", 0.10, "reassign"), (1, ("11to1",), "add", 0.10, "reassign"), (8, ("11to8",), "add", 0.10, "reassign"), (3, ("11play",), "add", 0.10, "reassign"), (16, ("11to16",), "add", 0.15, "reassign"),
    ),
    14: (
        (14, ("fair", "road14"), "add", -0.40, "road_penalty"), (14, ("fair", "works14"), "add", -0.30, "infrastructure_penalty"), (14, ("fair", "place14"), "add", -0.25, "place_penalty"),
        (14, ("fair", "true14"), "add", 0.15, "marine_bonus"), (14, ("fair", "marines14"), "restore", None, "marine_bonus"),
        (9, ("fair", "below"), "add", 0.15, "reassign"), (11, ("fair", "below"), "add", 0.10, "reassign"), (14, ("fair", "road14|works14|place14|true14"), "mark", None, ""),
    ),
    4: (
        (4, ("not4", "!true4"), "add", -0.35, "penalty"), (4, ("not4", "!true4"), "mark", None, "penalty"),
        (11, ("arts",), "add", 0.15, "reassign"), (3, ("sports",), "add", 0.15, "reassign"), (16, ("councillor",), "add", 0.15, "reassign"), (16, ("committee",), "add", 0.15, "reassign"), (16, ("advocacy",), "add", 0.15, "reassign"),
    ),
    6: ((6, ("not6", "!true6"), "add", -0.45, "penalty"), (6, ("not6", "!true6"), "mark", None, "penalty"), (11, ("not6", "6to11"), "add", 0.10, "reassign")),
    8: ((8, ("not8", "!true8"), "add", -0.40, "penalty"), (8, ("not8", "!true8"), "mark", None, "penalty"), (16, ("not8",), "add", 0.15, "reassign")),
    10: ((10, ("not10", "!true10"), "add", -0.40, "penalty"), (10, ("not10", "!true10"), "mark", None, "penalty"), (16, ("not10",), "add", 0.15, "reassign")),
    12: ((12, ("not12", "!true12"), "add", -0.40, "penalty"), (12, ("not12", "!true12"), "mark", None, "penalty"), (16, ("not12",), "add", 0.15, "reassign")),
    16: (
        (16, ("not16", "!true16"), "add", -0.40, "penalty"), (16, ("not16", "!true16"), "mark", None, "penalty"), (16, ("true16", "!not16"), "add", 0.15, "bonus"),
        (11, ("not16", "16to11"), "add", 0.10, "reassign"), (12, ("not16", "16to12"), "add", 0.10, "reassign"),
    ),
}


#: All words that flags look for.
_ALL = tuple(dict.fromkeys(w for words in (*ONE.values(), W.COAST_14, W.ROADS_14, W.VERBS_14, W.PLACES_14) for w in words))


def _some(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def road_by_the_sea(low: Column, known: Column) -> Column:
    """A word of the coast before one of roads, or within five words of one, or with a verb of works anywhere. ``known`` has the listed words of the text; only texts with both kinds are cut into words."""
    w, roads = T.tokens(low), F.array(*map(F.lit, W.ROADS_14))
    near = F.exists(F.transform(w, lambda x, i: x.rlike(_some(W.COAST_14)) & F.arrays_overlap(F.slice(w, F.greatest(i - 4, F.lit(1)), i + 6 - F.greatest(i - 5, F.lit(0))), roads)), lambda hit: hit)
    both = T.any_of(known, W.COAST_14) & T.any_of(known, W.ROADS_14)
    return F.when(both, T.any_of(known, W.VERBS_14) | low.rlike(f"(?:{_some(W.COAST_14)}) (?:{_some(W.ROADS_14)})") | near).otherwise(False)


def place_by_the_sea(low: Column, known: Column) -> Column:
    """A word with a place's name: beside a road within three words, or after a mark of a location. Only texts with such a name are cut into words."""
    w, single = T.tokens(low), [p for p in W.PLACES_14 if " " not in p]

    def at(x, i):
        before, after = F.array_join(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " "), F.array_join(F.slice(w, i + 2, F.lit(3)), " ")
        return x.rlike(_some(single)) & (before.rlike(_some(W.ROADS_14 + W.WHERE_14)) | after.rlike(_some(W.ROADS_14)))

    return F.when(T.any_of(known, single), F.exists(F.transform(w, at), lambda hit: hit)).otherwise(False)


def flags(text: Column, known: Column) -> dict[str, Column]:
    """``known`` is what ``T.present`` finds of all listed words."""
    low = F.lower(text)
    return {k: T.any_of(known, v) for k, v in ONE.items()} | {k: T.count_of(known, v) >= 2 for k, v in TWO.items()} | {"road14": road_by_the_sea(low, known), "place14": place_by_the_sea(low, known)}


def wide(facts: DataFrame, by: list[str], goal: str = "goal", score: str = "score") -> DataFrame:
    """Long facts (by..., goal, score) to one row with s1 to s17, null where a goal is missing."""
    return facts.groupBy(*by).agg(*(F.max(F.when(F.col(goal) == g, F.col(score).cast("double"))).alias(f"s{g}") for g in GOALS))


def _holds(condition: str, goal: int) -> Column:
    if "|" in condition:
        one, *others = condition.split("|")
        return _holds(one, goal) | _holds("|".join(others), goal)
    if condition.startswith("!"):
        return ~_holds(condition[1:], goal)
    if condition == "below":
        return F.col(f"s{goal}") < F.col("_began")
    return F.col("_began") >= 0.2 if condition == "fair" else F.col(f"_flag_{condition}")


def corrected(rows: DataFrame, text: str = "text", mode: str = "hybrid", modules=tuple(MODULES), methods: dict[int, str] | None = None, judged: str = "s") -> DataFrame:
    """s1 to s17 corrected, with a1 to a17 (is aligned) and c1 to c17 (a correction was applied).

    ``modules`` are those switched on, always run in the fixed order; ``methods`` names the one method of a module that is used ('all' by
    default). Alignment is that of the scores as they came, or of columns with another prefix (``judged``), such as unrounded similarities: corrections don't renew it, but for goal 17, which needs 0.85 before its last step.
    """
    methods = methods or {}
    known = {m: {method for *_, method in rules} | {"all"} for m, rules in MODULES.items()}
    for m, method in methods.items():
        if method not in known[m]:
            raise ValueError(f"unknown method {method} of goal {m}")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = flags(whole, F.col("_known"))
    out = rows.withColumn("_known", T.present(F.lower(whole), _ALL))
    out = out.withColumns({f"_flag_{k}": c for k, c in found.items()}).drop("_known")  # columns of their own: fields of a struct would be worked out again at each use
    out = out.withColumns({f"a{g}": F.col(f"{judged}{g}") >= threshold(F.lit(g), mode) for g in GOALS} | {f"c{g}": F.lit(False) for g in GOALS})
    for m, rules in MODULES.items():
        if m not in modules:
            continue
        out = out.withColumn("_began", F.col(f"s{m}"))
        for goal, needs, kind, amount, method in rules:
            if method and methods.get(m, "all") not in (method, "all"):
                continue
            name, on = f"s{goal}", F.col("_began").isNotNull()
            for c in needs:
                on &= _holds(c, m)
            score = F.col(name)
            if kind == "mark":
                out = out.withColumn(f"c{goal}", F.when(on, True).otherwise(F.col(f"c{goal}")))
            elif kind == "align":
                out = out.withColumn(f"a{goal}", F.when(on, score >= amount).otherwise(F.col(f"a{goal}")))
            else:
                new = {"add": lambda s, x: F.least(F.lit(1.0), s + x) if x > 0 else F.greatest(F.lit(0.0), s + x), "times": lambda s, x: F.greatest(F.lit(0.0), s * x), "restore": lambda s, x: F.col("_began")}[kind](score, amount)
                out = out.withColumn(name, F.when(on & score.isNotNull(), new).otherwise(score))
    return out.drop(*(f"_flag_{k}" for k in found), "_began")


def boosted(rows: DataFrame, text: str = "text", mode: str = "hybrid", boosts=L.BOOSTS) -> DataFrame:
    """Corrected rows with the keyword boost: a boosted goal's alignment is renewed; goal 14 gains nothing once it was corrected."""
    low, new = F.lower(F.coalesce(F.col(text), F.lit(""))), {}
    for g, (words, gain) in boosts.items():
        on = T.any_of(low, words) & F.col(f"s{g}").isNotNull() & (~F.col(f"c{g}") if g == 14 else F.lit(True))
        score = F.when(on, F.least(F.lit(1.0), F.col(f"s{g}") + gain)).otherwise(F.col(f"s{g}"))
        new |= {f"s{g}": score, f"a{g}": F.when(on, score >= threshold(F.lit(g), mode)).otherwise(F.col(f"a{g}"))}
    return rows.withColumns(new)


def summary(rows: DataFrame) -> DataFrame:
    """With num_aligned, top_goal (the lowest of equal ones) and top_score."""
    best = F.greatest(*(F.col(f"s{g}") for g in GOALS))
    top = F.coalesce(*(F.when(F.col(f"s{g}") == best, g) for g in GOALS))
    aligned = sum((F.coalesce(F.col(f"a{g}"), F.lit(False)).cast("int") for g in GOALS), F.lit(0))
    return rows.withColumns({"num_aligned": aligned, "top_goal": top, "top_score": best})


def co_requirements(text: Column) -> dict[str, Column]:
    """What goal 11 asks of a text beside its score."""
    low = F.lower(text)
    return {"has_action": T.any_of(low, W.ACTION_11), "has_community": T.any_of(low, W.TOWN_11), "has_sustainability": T.any_of(low, W.TRUE_11), "has_negative": T.any_of(low, W.EXCLUDED_11)}
