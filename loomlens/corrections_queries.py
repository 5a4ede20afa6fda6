"""Queries of the score corrections, over activities made from orders, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import correction_words as W
from .functions import lexicons as L
from .operators import corrections as C
from .plans.facts import table

#: Each activity's text is of five phrases picked by its number, among them all words of the corrections.
PHRASES = sorted({w for words in C.ONE.values() for w in words} | set(W.PLACES_14 + W.COAST_14 + W.VERBS_14 + W.ROADS_14 + W.ACTION_11 + W.TOWN_11) | {w for words, _ in L.BOOSTS.values() for w in words}) + [f"{w} on" for w in W.COAST_14] + ["We met at", "Plans for"]
PICKS = ((7, 1), (13, 5), (101, 17), (31, 11), (3, 2))


def activities(spark, sf_dir):
    """(activity_id, text, s1 to s17) of every order; some goals are missing."""
    orders, n = table(spark, sf_dir, "orders"), len(PHRASES)
    words, i = F.array(*map(F.lit, PHRASES)), F.col("o_orderkey")
    text = F.concat_ws(" ", *(F.get(words, ((i * a + b) % n).cast("int")) for a, b in PICKS))
    scores = (F.when((i + g) % 11 != 0, ((i * 31 + g * 17) % 100) / 100.0).alias(f"s{g}") for g in C.GOALS)
    return orders.select(i.alias("activity_id"), text.alias("text"), *scores)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, {_q(w)})" for w in words) + ")"


def _regex(words) -> str:
    return _q("|".join(w.replace(".", r"\.") for w in words))


def _activities_sql() -> str:
    n, listed = len(PHRASES), "[" + ", ".join(map(_q, PHRASES)) + "]"
    text = " || ' ' || ".join(f"v[(o_orderkey * {a} + {b}) % {n} + 1]" for a, b in PICKS)
    scores = ", ".join(f"CASE WHEN (o_orderkey + {g}) % 11 <> 0 THEN ((o_orderkey * 31 + {g * 17}) % 100) / 100.0::DOUBLE END AS s{g}" for g in C.GOALS)
    return f"WITH x AS (SELECT o_orderkey AS activity_id, lower({text}) AS t, {scores} FROM orders, (SELECT {listed} AS v))"


def _flags_sql(judged: str = "s") -> str:
    one = ", ".join(f'{_any(v)} AS "{k}"' for k, v in C.ONE.items())
    two = ", ".join(f"{' + '.join(f'contains(t, {_q(w)})::INT' for w in v)} >= 2 AS \"{k}\"" for k, v in C.TWO.items())
    roads = "[" + ", ".join(map(_q, W.ROADS_14)) + "]"
    near = f"len(list_filter(range(len(w)), lambda i: regexp_matches(w[i + 1], {_regex(W.COAST_14)}) AND list_has_any(w[greatest(i - 4, 1):i + 6], {roads}))) > 0"
    road = f"regexp_matches(t, '(?:{'|'.join(W.COAST_14)}) (?:{'|'.join(W.ROADS_14)})') OR {near} OR ({_any(W.VERBS_14)} AND {_any(W.COAST_14)} AND {_any(W.ROADS_14)})"
    before, after = "coalesce(array_to_string(w[greatest(i - 2, 1):i], ' '), '')", "coalesce(array_to_string(w[i + 2:i + 4], ' '), '')"
    place = f"len(list_filter(range(len(w)), lambda i: regexp_matches(w[i + 1], {_regex([p for p in W.PLACES_14 if ' ' not in p])}) AND (regexp_matches({before}, {_regex(W.ROADS_14 + W.WHERE_14)}) OR regexp_matches({after}, {_regex(W.ROADS_14)})))) > 0"
    aligned = ", ".join(f"{judged}{g} >= {L.THRESHOLDS['hybrid'][1][g - 1]} AS a{g}, false AS c{g}" for g in C.GOALS)
    return f", y AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda z: z <> '') AS w FROM x), r0 AS (SELECT *, {one}, {two}, ({road}) AS road14, ({place}) AS place14, {aligned}, NULL::DOUBLE AS began FROM y)"


def _holds(c: str, m: int) -> str:
    if "|" in c:
        return "(" + " OR ".join(_holds(x, m) for x in c.split("|")) + ")"
    if c.startswith("!"):
        return f"NOT {_holds(c[1:], m)}"
    return {"below": f"s{m} < began", "fair": "began >= 0.2::DOUBLE"}.get(c, f'"{c}"')


def _rules_sql(modules) -> tuple[str, str]:
    out, last = [], "r0"

    def add(column, expression):
        nonlocal last
        out.append(f", r{len(out) + 1} AS (SELECT * REPLACE ({expression} AS {column}) FROM {last})")
        last = f"r{len(out)}"

    for m, rules in C.MODULES.items():
        if m not in modules:
            continue
        add("began", f"s{m}")
        for goal, needs, kind, amount, _ in rules:
            on, s = " AND ".join(["began IS NOT NULL", *(_holds(c, m) for c in needs)]), f"s{goal}"
            if kind == "mark":
                add(f"c{goal}", f"CASE WHEN {on} THEN true ELSE c{goal} END")
            elif kind == "align":
                add(f"a{goal}", f"CASE WHEN {on} THEN {s} >= {amount}::DOUBLE ELSE a{goal} END")
            else:
                new = {"times": f"greatest(0.0::DOUBLE, {s} * {amount}::DOUBLE)", "restore": "began", "add": f"least(1.0::DOUBLE, {s} + {amount}::DOUBLE)" if (amount or 0) > 0 else f"greatest(0.0::DOUBLE, {s} + ({amount})::DOUBLE)"}[kind]
                add(s, f"CASE WHEN {on} AND {s} IS NOT NULL THEN {new} ELSE {s} END")
    return "".join(out), last


def _boost_sql(last: str) -> tuple[str, str]:
    parts = []
    for g, (words, gain) in L.BOOSTS.items():
        on = f"{_any(words)} AND s{g} IS NOT NULL" + (" AND NOT c14" if g == 14 else "")
        new = f"least(1.0::DOUBLE, s{g} + {gain}::DOUBLE)"
        parts += [f"CASE WHEN {on} THEN {new} ELSE s{g} END AS s{g}", f"CASE WHEN {on} THEN {new} >= {L.THRESHOLDS['hybrid'][1][g - 1]} ELSE a{g} END AS a{g}"]
    return f", b AS (SELECT * REPLACE ({', '.join(parts)}) FROM {last})", "b"


_SHOWN = ", ".join(f"round(s{g}, 6) AS s{g}" for g in C.GOALS)


def _shown():
    return [F.round(f"s{g}", 6).alias(f"s{g}") for g in C.GOALS]


def module(m: int):
    def run(spark, sf_dir):
        return C.corrected(activities(spark, sf_dir), modules=(m,)).select("activity_id", *_shown(), F.col(f"a{m}").alias("is_aligned"), F.col(f"c{m}").alias("correction_applied"))

    rules, last = _rules_sql((m,))
    return run, _activities_sql() + _flags_sql() + rules + f" SELECT activity_id, {_SHOWN}, a{m} AS is_aligned, c{m} AS correction_applied FROM {last}"


def chain():
    def run(spark, sf_dir):
        done = C.summary(C.boosted(C.corrected(activities(spark, sf_dir))))
        return done.select("activity_id", *_shown(), "num_aligned", "top_goal", F.round("top_score", 6).alias("top_score"), "c14")

    rules, last = _rules_sql(tuple(C.MODULES))
    boost, last = _boost_sql(last)
    best = "greatest(" + ", ".join(f"s{g}" for g in C.GOALS) + ")"
    count = " + ".join(f"coalesce(a{g}, false)::INT" for g in C.GOALS)
    top = "CASE " + " ".join(f"WHEN s{g} = {best} THEN {g}" for g in C.GOALS) + " END"
    return run, _activities_sql() + _flags_sql() + rules + boost + f" SELECT activity_id, {_SHOWN}, {count} AS num_aligned, {top} AS top_goal, round({best}, 6) AS top_score, c14 FROM {last}"


def requirements():
    def run(spark, sf_dir):
        return activities(spark, sf_dir).select("activity_id", *(c.alias(k) for k, c in C.co_requirements(F.col("text")).items()))

    lists = {"has_action": W.ACTION_11, "has_community": W.TOWN_11, "has_sustainability": W.TRUE_11, "has_negative": W.EXCLUDED_11}
    return run, _activities_sql() + " SELECT activity_id, " + ", ".join(f"{_any(v)} AS {k}" for k, v in lists.items()) + " FROM x"


QUERIES = {f"correction_goal_{m}": module(m) for m in C.MODULES} | {"correction_chain": chain(), "co_requirements": requirements()}
