"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations


def rounded(part: str, whole: str, scale: int) -> str:
    """As in operators.rollups: halves up, in whole numbers."""
    return f"((({2_000_000 // scale} * {part})::BIGINT + {whole}) // (2 * {whole}))::DOUBLE / 1e6"


MEAN = rounded("sum(milli)", "count(*)", 1000)
SHARE = rounded("sum(is_aligned::INT)", "count(*)", 1)


def yearly(by: str, facts: str) -> str:
    """Table y (by, goal, year, score): the mean over reports, council and year, of each report's mean, in whole numbers of millionths."""
    own = f"{by}, " if by else ""
    return f""", m AS (SELECT {own}council, goal, year, ((2000 * sum(milli))::BIGINT + count(*)) // (2 * count(*)) AS m FROM {facts} GROUP BY {own}council, goal, year),
y AS (SELECT {own}goal, year, ((2 * sum(m))::BIGINT + count(*)) // (2 * count(*)) / 1e6 AS score FROM m GROUP BY {own}goal, year)"""


def fitted(by: str, rows: str) -> str:
    """Table q (by, n, slope, r2, p_value) of least squares of score by year; p by the closed sum of Student's t for whole degrees of freedom."""
    return (
        f", s AS (SELECT {by}, count(*) AS n, regr_slope(score, year) AS b, regr_r2(score, year) AS r FROM {rows} GROUP BY {by} HAVING count(*) > 1), t AS (SELECT {by}, n, round(b, 8) AS slope, CASE WHEN b = 0 THEN 0 ELSE r END AS r FROM s), p AS (SELECT {by}, n, slope, r, CASE WHEN n = 2 THEN NULL WHEN r <= 0 THEN 1.0 WHEN r >= 1 THEN 0.0 ELSE atan(sqrt(r / (1 - r))) END AS a FROM t), "
        f"q AS (SELECT {by}, n, slope, round(r, 6) AS r2, round(CASE WHEN n = 2 THEN 0.0 WHEN r <= 0 THEN 1.0 WHEN r >= 1 THEN 0.0 WHEN (n - 2) % 2 = 1 THEN 1 - 2 / pi() * (a + CASE WHEN n = 3 THEN 0 ELSE sin(a) * list_sum(list_transform(range(1, (n - 1) // 2), lambda j: pow(cos(a), 2 * j - 1) * coalesce(list_product(list_transform(range(1, j), lambda i: 2.0 * i / (2 * i + 1))), 1))) END) ELSE 1 - sin(a) * list_sum(list_transform(range(0, (n - 2) // 2), lambda j: pow(cos(a), 2 * j) * coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2.0 * i - 1) / (2 * i))), 1))) END, 6) AS p_value FROM p)"
    )
