"""The library's rules under names that SQL can use.

Scalar functions are SQL's own, so that Catalyst puts their bodies in place: nothing leaves the JVM. Table functions are small Python classes that
Spark calls row by row; both are defined within functions, so that executors get them with the query and need no installed package.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.udtf import UserDefinedTableFunction

from .functions import lexicons as L


def _case(column: str, cases: dict, otherwise) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}D" for k, v in cases.items()) + f" ELSE {otherwise}D END"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def scalar_functions() -> dict[str, str]:
    """Name to what follows it in CREATE FUNCTION."""
    thresholds = " ".join(f"WHEN mode = '{m}' THEN {_case('goal', dict(enumerate(t, 1)), d)}" for m, (d, t) in L.THRESHOLDS.items())
    boosts = " ".join(f"WHEN goal = {g} AND {_any('lower(body)', terms)} THEN {gain}D" for g, (terms, gain) in L.BOOSTS.items())
    weights = " ".join(f"WHEN section = '{s}' THEN {_case('goal', w, 1.0)}" for s, w in L.SECTION_WEIGHTS.items())
    sections = " ".join(f"WHEN {_any('lower(body)', terms)} THEN '{name}'" for name, terms in L.SECTIONS)
    return {
        "goal_threshold": f"(goal INT, mode STRING) RETURNS DOUBLE RETURN CASE {thresholds} END",
        "model_weight": f"(goal INT) RETURNS DOUBLE RETURN {_case('goal', dict(enumerate(L.MODEL_WEIGHTS, 1)), 0.5)}",
        "keyword_gain": f"(goal INT, body STRING) RETURNS DOUBLE RETURN CASE {boosts} ELSE 0D END",
        "section_weight": f"(section STRING, goal INT) RETURNS DOUBLE RETURN CASE {weights} ELSE 1D END",
        "section_of": f"(body STRING) RETURNS STRING RETURN CASE {sections} ELSE 'general' END",
        "normalized_text": r"(body STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(lower(body), '(?U)[^\\w\\s-]', ' '), '\\s+', ' '))",
        "slug_of": "(body STRING) RETURNS STRING RETURN trim(BOTH '-' FROM regexp_replace(lower(body), '[^a-z0-9]+', '-'))",
        "rating_of": "(activity DOUBLE, council DOUBLE) RETURNS STRING RETURN CASE WHEN least(activity, council) >= 0.7 THEN 'high' WHEN least(activity, council) >= 0.5 THEN 'medium' ELSE 'low' END",
    }


def html_cells() -> UserDefinedTableFunction:
    """A table function of a page's HTML: (table_no, row_no, col_no, is_header, value), with cells repeated over the rows and columns that they span.

    Tables are numbered in the order in which they begin, nested ones too; text goes to the innermost cell. Missing end tags are taken as given. A rowspan of 0 goes to the table's
    end. Script and style are no text; white space is squeezed. Null gives no row.
    """
    from pyspark.sql.functions import udtf

    class Cells:
        def eval(self, html: str):
            from html.parser import HTMLParser

            class Tables(HTMLParser):
                def __init__(self):
                    super().__init__()
                    self.open, self.done, self.count, self.mute = [], [], 0, 0

                def handle_starttag(self, tag, attrs):
                    if tag == "table":
                        self.open.append({"no": self.count, "rows": [], "row": None, "cell": None})
                        self.count += 1
                    elif tag in ("script", "style"):
                        self.mute += 1
                    elif self.open and tag in ("tr", "td", "th"):
                        t = self.open[-1]
                        t["cell"] = None
                        if tag == "tr" or t["row"] is None:
                            t["row"] = []
                            t["rows"].append(t["row"])
                        if tag != "tr":
                            spans = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isascii() and v.isdigit()}
                            t["cell"] = [tag == "th", [], min(max(spans.get("colspan", 1), 1), 1000), min(spans.get("rowspan", 1) or 65534, 65534)]
                            t["row"].append(t["cell"])
                    elif tag == "br":
                        self.handle_data(" ")

                def handle_endtag(self, tag):
                    if tag in ("script", "style"):
                        self.mute = max(0, self.mute - 1)
                    elif self.open:
                        t = self.open[-1]
                        if tag in ("td", "th", "tr"):
                            t["cell"] = None
                        if tag == "tr":
                            t["row"] = None
                        if tag == "table":
                            self.done.append(self.open.pop())

                def handle_data(self, data):
                    if self.open and self.open[-1]["cell"] is not None and not self.mute:
                        self.open[-1]["cell"][1].append(data)

            if html is None:
                return
            found = Tables()
            found.feed(html)
            found.close()
            for t in sorted(found.done + found.open, key=lambda t: t["no"]):
                below: dict[int, list] = {}  # column to what still reaches down into it: rows left, header, value
                for r, row in enumerate(t["rows"]):
                    col, cells = 0, iter(row)
                    while True:
                        if col in below:
                            rest = below[col]
                            yield t["no"], r, col, rest[1], rest[2]
                            rest[0] -= 1
                            if not rest[0]:
                                del below[col]
                            col += 1
                            continue
                        cell = next(cells, None)
                        if cell is None:
                            if not any(c > col for c in below):
                                break
                            col += 1
                            continue
                        head, text, wide, deep = cell
                        value = " ".join("".join(text).split())
                        for _ in range(wide):
                            if col in below:
                                break  # cells don't overlap: what reaches down has the place
                            yield t["no"], r, col, head, value
                            if deep > 1:
                                below[col] = [deep - 1, head, value]
                            col += 1

    return udtf(Cells, returnType="table_no: int, row_no: int, col_no: int, is_header: boolean, value: string")


def split_candidates() -> UserDefinedTableFunction:
    """A table function of any table: its columns but the text's, and one row for each sentence with enough words.

    SELECT * FROM split_candidates(TABLE(docs), 'text', 5): the columns of the result follow from those of the argument.
    """
    from pyspark.sql.functions import udtf

    @udtf
    class Split:
        def __init__(self):
            import re

            self.ends = re.compile(r"(?<=[.!?])\s+").split

        @staticmethod
        def analyze(rows, text, least):
            from pyspark.sql.types import IntegerType, StringType, StructType
            from pyspark.sql.udtf import AnalyzeResult

            if not rows.isTable or text.value not in rows.dataType.fieldNames():
                raise ValueError("split_candidates takes a table, the name of its text column, and the least number of words")
            out = StructType([f for f in rows.dataType.fields if f.name != text.value])
            return AnalyzeResult(schema=out.add("pos", IntegerType()).add("statement", StringType()).add("n_words", IntegerType()))

        def eval(self, row, text, least):
            body = row[text]
            own = [row[k] for k in row.asDict() if k != text]
            at = 0
            for part in self.ends(body) if body else ():
                n = len(part.split())
                if n >= least:
                    yield (*own, at, part.strip(), n)
                    at += 1

    return Split


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, under their own names."""
    for name, rest in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    spark.udtf.register("html_cells", html_cells())
    spark.udtf.register("split_candidates", split_candidates())
