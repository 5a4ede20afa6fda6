"""Pages of a document: contents pages, lines that are no content, where the accounts begin, sections, what is left.

A page is a row (document, page number, text). Detectors are flags of a page; a document's earliest page of the first
detector that finds any is one combined aggregation, so that a document of many pages is no burden to a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as LN
from ..functions import text as T

# Heads of a contents page.
CONTENTS_HEADS = ("table of contents", "contents", "index")

# Titles of the part that holds a report's accounts.
ACCOUNT_TITLES = (
    "annual financial report", "certification of the financial statements", "independent audit report", "independent auditor's report", "auditor's independence declaration",
    "statement of comprehensive income", "statement of financial position", "statement of cash flows", "statement of changes in equity", "notes to the financial statements",
    "notes to and forming part of the financial statements", "consolidated financial report",
)

# Weaker signs of accounts, and signs of an audit beside a certification.
ACCOUNT_SIGNS = ("general purpose financial statements", "special purpose financial statements", "certified financial statements", "audited financial statements", "income statement", "balance sheet")
CERTIFICATION = "certification of the financial statements"
AUDIT_SIGNS = ("opinion", "audit", "compliance", "accounting standard", "true and fair", "internal control")

# Patterns of a section's heading, whatever the case.
HEADINGS = (
    r"^\s*(?:CHAPTER\s+)?(\d+[.:]?)\s+([A-Z][A-Z\s\-]+)",
    r"^\s*([A-Z][A-Z\s\-]{3,50})\s*$",
    r"^\s*(?:Section\s+)?(\d+)\.?\s+([A-Z][A-Za-z\s\-]+)",
    r"^\s*(About\s+This\s+Report|Annual\s+Report|Chief\s+Executive|Mayoral|Director|Financial|Performance|Governance|Community|Sustainability|Environment|Planning|Infrastructure|Corporate)",
)


def paged(docs: DataFrame, key: str, text: str = "text", lines: int = 40) -> DataFrame:
    """(key, page_number from 1, text): form feeds end a page, else so many lines make one."""
    whole = F.col(text)
    by_lines = LN.let(F.split(whole, "\n"), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(lines)), lambda i: F.array_join(F.slice(x, i, lines), "\n")))
    parts = F.when(whole.contains("\f"), F.split(whole, "\f")).otherwise(by_lines)
    return docs.where(whole.isNotNull()).select(key, F.posexplode(parts).alias("i", "text")).select(key, (F.col("i") + 1).alias("page_number"), "text")


def is_contents(page: Column, heads=CONTENTS_HEADS) -> Column:
    """A contents head within the first 500 characters."""
    return T.any_of(F.left(F.lower(page), F.lit(500)), heads)


def is_contents_by_entries(page: Column, heads=CONTENTS_HEADS) -> Column:
    """A page that opens with a contents head and has three lines, of its first fifteen, of over ten characters that end in a number."""
    top = F.regexp_replace(F.left(F.lower(page), F.lit(200)), r"^\s+", "")
    opens = reduce(lambda a, b: a | b, (top.startswith(h) for h in heads))
    entries = F.filter(F.slice(F.split(page, "\n"), 1, 15), lambda x: LN.let(LN.stripped(x), lambda s: (F.length(s) > 10) & s.rlike(r".\d+$")))
    return opens & (F.size(entries) >= 3)


def is_entry(line: Column) -> Column:
    """A short line of up to nine words before a number at its end, as contents have."""
    before = LN.stripped(F.regexp_replace(line, r"\d+\s*$", ""))
    return F.when(F.length(line) < 100, line.rlike(r"^\W*+\w.*\d\s*$") & (before != "") & (F.size(T.tokens(before)) < 10)).otherwise(False)


def is_running_head(line: Column) -> Column:
    """Ends in a year or span of years and a page number, after a word."""
    return line.rlike(r"^\W*+\w.*20\d{2}[-–]?\d{0,2}\s+\d+\s*$")


def is_page_mark(line: Column) -> Column:
    """A number by itself, Page n, or n of m."""
    return line.rlike(r"(?i)^\d+$|^page\s+\d+$|^\d+\s+of\s+\d+$")


def content(page: Column) -> Column:
    """A page without blank lines, entries of contents, running heads and page marks."""
    keep = lambda x: LN.let(LN.stripped(x), lambda s: (s != "") & ~is_entry(s) & ~is_running_head(s) & ~is_page_mark(s))
    return F.array_join(F.filter(F.split(page, "\n"), keep), "\n")


def cleaned(pages: DataFrame, contents: Callable[[Column], Column] = is_contents) -> DataFrame:
    """Pages that aren't contents, with what is content on them; pages of which nothing is left go."""
    return pages.where(~contents(F.col("text"))).withColumn("text", content(F.col("text"))).where("text <> ''")


def account_passes(page: Column, titles=ACCOUNT_TITLES, signs=ACCOUNT_SIGNS, certification: str = CERTIFICATION, audit=AUDIT_SIGNS) -> list[Column]:
    """Three detectors of a page of accounts, the surest first: a title at the top, a certification beside signs of an audit, several titles and signs."""
    low = F.lower(page)
    head = F.slice(F.split(LN.stripped(low), "\n"), 1, 3)
    first = LN.stripped(F.get(head, 0))
    titled = reduce(lambda a, b: a | b, (first.startswith(t) | F.array_contains(head, t) for t in titles))
    certified = low.contains(certification) & T.any_of(low, audit)
    n = T.count_of(low, titles)
    return [titled, certified, (n >= 2) | ((n >= 1) & (T.count_of(low, signs) >= 2))]


def accounts_start(pages: DataFrame, key: str, **how) -> DataFrame:
    """(key, pages, start): the earliest page that the first detector with any finds; null if none does."""
    flags = account_passes(F.col("text"), **how)
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.coalesce(*(F.min(F.when(p, F.col("page_number"))) for p in flags)).alias("start"))


def without_accounts(pages: DataFrame, key: str, **how) -> DataFrame:
    """Pages before the one where the accounts begin, which a document's other pages don't change."""
    start = accounts_start(pages, key, **how).select(F.col(key).alias("_key"), "start")
    return pages.join(start, pages[key].eqNullSafe(F.col("_key"))).where("start is null or page_number < start").select(*pages.columns)


def text_without_accounts(text: Column, titles=ACCOUNT_TITLES, least: float = 0.2) -> Column:
    """A text cut before the first line that is a title, if that is its first place and stands after a fifth of the text."""
    places = F.array(*(F.call_function("locate", F.lit(f"\n{t}\n"), F.lower(text)) - 1 for t in titles))
    late = F.filter(places, lambda p: (p >= 0) & (p / F.length(text) > least))
    return F.when(F.size(late) > 0, F.left(text, F.array_min(late))).otherwise(text)


def is_heading(line: Column) -> Column:
    """One of the patterns, or capitals throughout: over 10 and under 80 characters, no table row, not figures alone."""
    s = LN.stripped(line)
    capitals = (s == F.upper(s)) & s.rlike(r"\p{Lu}") & F.length(s).between(11, 79) & ~s.contains("|") & ~F.translate(s, ".,", "").rlike(r"^\d+$")
    return (s != "") & (s.rlike("(?i)" + "|".join(HEADINGS)) | capitals)


def sectioned(docs: DataFrame, key: str, text: str = "text", heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """(key, section from 0, title, start_line, end_line, content) of each text: lines up to the next heading; sections without lines are left out.

    A section's end_line is the number of the heading after it, null for the last. Sections are cut out of the row's own lines.
    """

    def cut(own: Column) -> Column:
        at = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: heading(F.get(own, i))))
        ends = lambda a: F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.array(F.size(own)))

        def part(a: Column, z: Column) -> Column:
            title = F.when(a < 0, F.lit("Introduction")).otherwise(LN.stripped(F.get(own, a)))
            inner = F.array_join(F.slice(own, a + 2, z - a - 1), "\n")
            return F.struct(title.alias("title"), F.greatest(a, F.lit(0)).alias("start_line"), F.when(z < F.size(own), z).alias("end_line"), inner.alias("content"), (z - a - 1).alias("n"))

        return F.filter(LN.let(at, lambda a: F.zip_with(a, ends(a), part)), lambda s: s["n"] > 0)

    parts = LN.let(F.split(F.col(text), "\n"), cut)
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("section", "s")).select(key, "section", "s.title", "s.start_line", "s.end_line", "s.content")
