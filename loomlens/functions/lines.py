"""Lines that a page broke, put together again: pairwise rules as Catalyst expressions, and runs of lines in linear time.

Each rule looks at a line and the one before it. What was joined before a line matters only by its last word and last character, and these are the
last line's own, so that nothing has to be folded: the places where a run begins are filtered from the lines' numbers, and each run is cut out and
joined once. All of it works within a row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that lean on what comes before or after them, by rule.
LEANING_WORDS = (
    "to", "of", "with", "and", "in", "on", "for", "at", "by", "from", "as", "that", "which", "who", "whom", "whose", "where", "when",
    "this", "these", "those", "some", "any", "each", "every", "both", "few", "many", "most", "other", "another",
)
SMALL_WORDS = ("and", "or", "but", "the", "a", "of", "in", "to")
OPENING_WORDS = ("to", "of", "with", "and", "in", "on", "for", "at", "by", "from", "the", "a", "an", "that", "which", "who", "whom", "whose")
CONNECTING_WORDS = ("to", "of", "with", "and", "in", "on", "for", "at", "by", "from", "as", "that", "which", "who", "where", "when")

# Abbreviations whose full stop ends no line's sentence, for lines and for paragraphs.
LINE_ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "ave", "blvd", "rd", "inc", "ltd", "corp", "llc", "eg", "ie", "etc", "vol", "vols",
    "pg", "pp", "ed", "eds", "no", "nos", "fig", "figs", "et", "al", "cf", "vs", "dept", "govt", "council",
)
PARAGRAPH_ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "etc", "eg", "ie", "vs")

#: No word of the lists is as long; a longer word is cut and equals none.
_LOOK = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_word(line: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(line, F.lit(_LOOK)), r"^\s*(\S+)", 1))


def last_word(line: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(line, F.lit(_LOOK)), r"(\S+)\s*$", 1))


def ends_sentence(line: Column, abbreviations) -> Column:
    """Ends in a closing mark that isn't an abbreviation's."""
    return line.rlike(r"[.!?]\s*$") & ~F.regexp_replace(last_word(line), r"[.!?]+$", "").isin(*abbreviations)


def is_short_title(line: Column) -> Column:
    """Fewer than ten words, a capital first, and no small word in second or third place."""
    words = F.filter(F.split(F.left(line, F.lit(2000)), r"\s+"), lambda w: w != "")
    small = lambda i: F.coalesce(F.lower(F.get(words, i)).isin(*SMALL_WORDS), F.lit(False))
    return (F.size(words) < 10) & (F.length(line) <= 2000) & line.rlike(r"^\p{Lu}") & ~small(1) & ~small(2)


def breaks_sentence(before: Column, line: Column) -> Column:
    """Whether a stripped line begins something new after the one before; blank lines stand alone."""
    leans = last_word(before).isin(*LEANING_WORDS) | line.rlike(r"^\p{Ll}") | first_word(line).isin(*LEANING_WORDS)
    return (before == "") | (line == "") | (~leans & (ends_sentence(before, LINE_ABBREVIATIONS) | is_short_title(line)))


def breaks_paragraph_line(before: Column, line: Column) -> Column:
    """The stricter rule within a paragraph: a line is joined only for a reason."""
    joined = before.rlike("[:\\-–—]$") | line.rlike(r"^\p{Ll}") | first_word(line).isin(*OPENING_WORDS) | last_word(before).isin(*CONNECTING_WORDS)
    return (before == "") | (line == "") | ends_sentence(before, PARAGRAPH_ABBREVIATIONS) | ~joined


def breaks_topic(before: Column, line: Column) -> Column:
    """A blank line, or a line of over twenty characters with a capital first after a closing mark."""
    return (before == "") | (line == "") | (before.rlike(r"[.!?]\s*$") & line.rlike(r"^\p{Lu}") & (F.length(line) > 20))


def runs(lines: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """Array of texts: lines up to where ``breaks`` says that something new begins, joined by spaces; empty ones are left out. No lines, or null, give none."""

    def cut(own: Column) -> Column:
        n = F.size(own)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | breaks(F.get(own, i - 1), F.get(own, i)))
        texts = lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(n)), lambda a, z: F.array_join(F.slice(own, a + 1, z - a), " "))
        return F.when(n > 0, F.filter(let(first, texts), lambda t: t != "")).otherwise(F.array().cast("array<string>"))

    return let(lines, cut)


def stripped_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), stripped)


def dehyphenated(paragraph: Column) -> Column:
    """A paragraph's lines, stripped, blank ones but a first left out, with words joined that a hyphen at a line's end parts."""
    lines = let(stripped_lines(paragraph), lambda x: F.concat(F.slice(x, 1, 1), F.filter(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda w: w != "")))
    return F.split(F.regexp_replace(F.array_join(lines, "\n"), "-\n", ""), "\n")


def _by_paragraph(text: Column, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.split(text, "\n\n"), lambda p: F.when(stripped(p) == "", F.array().cast("array<string>")).otherwise(of(p)))


def sentence_runs(text: Column) -> Column:
    """Array of paragraphs, each an array of statements put together from lines."""
    return _by_paragraph(text, lambda p: runs(stripped_lines(p), breaks_sentence))


def paragraph_runs(text: Column) -> Column:
    """The same by the stricter rule, with words joined at hyphens."""
    return _by_paragraph(text, lambda p: runs(dehyphenated(p), breaks_paragraph_line))


def rebuilt(text: Column) -> Column:
    """A text with each paragraph on one line; blank paragraphs stay."""
    return F.array_join(F.transform(F.split(text, "\n\n"), lambda p: F.when(stripped(p) == "", F.lit("")).otherwise(F.array_join(stripped_lines(p), " "))), "\n\n")


def rebuilt_paragraphs(text: Column) -> Column:
    """The same with words joined at hyphens and without blank lines within a paragraph; a paragraph of one line stays as it is."""
    one = lambda p: F.when(stripped(p) == "", F.lit("")).when(~p.contains("\n"), p).otherwise(F.array_join(dehyphenated(p), " "))
    return F.array_join(F.transform(F.split(text, "\n\n"), one), "\n\n")


def topic_paragraphs(text: Column) -> Column:
    """Paragraphs of a text's lines, by blank lines and by capitals after closing marks."""
    return runs(stripped_lines(text), breaks_topic)
