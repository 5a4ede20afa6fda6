"""Text rules as Catalyst expressions: cleaning, sentences, filters and scores of candidate statements."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def any_of(text: Column, terms) -> Column:
    """Whether a text has any of the terms as a substring."""
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


def count_of(text: Column, terms) -> Column:
    """How many of the terms a text has as a substring."""
    return reduce(lambda a, b: a + b, (text.contains(t).cast("int") for t in terms), F.lit(0))


def tree(words) -> str:
    """A pattern of the longest of the words that stand at a place, by their letters one after another."""
    ends, by = "" in words, defaultdict(set)
    for w in words:
        if w:
            by[w[0]].add(w[1:])
    each = "|".join(re.escape(c) + tree(rest) for c, rest in sorted(by.items()))
    return f"(?:{each})?" if each and ends else f"(?:{each})" if len(by) > 1 else each


def present(text: Column, terms) -> Column:
    """Those of the terms that stand in a text, one a line: it has a term as a substring just if the text has.

    All of them are found in one pass, the longest at each place; a shorter one at the same place is its beginning. Worth it for more than some sixty terms.
    """
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({tree(set(terms))}))"), F.lit(1))), "\n")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_header_footer(line: Column) -> Column:
    """A running head, a page number, or a short line of two to eight words that ends in a number that isn't a year."""
    fixed = line.rlike("(?i)" + "|".join(L.HEADER_PATTERNS))
    before = F.trim(F.regexp_replace(line, r"\d+\s*$", ""))
    n = F.size(tokens(before))
    # Only short lines reach the patterns: on long ones they would go back and forth for ever.
    numbered = F.when(F.length(line) < 80, line.rlike(r"\w+.*?\d+\s*$") & n.between(2, 8) & ~line.rlike(r"(?:19|20)\d{2}\s*$")).otherwise(False)
    return (line == "") | fixed | numbered


def clean_text(text: Column) -> Column:
    """Without heads and feet, addresses of pages and mail, and leading bullets; white space becomes single spaces."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_header_footer(F.trim(x))), "\n")
    bare = F.regexp_replace(F.regexp_replace(kept, r"https?://\S+|www\.\S+", ""), r"\S+@\S+", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^(?:[•·\-–—*]\s*|\d+[.)]\s+)", ""))


#: A mark beside abbreviations while they are lowered, and letters that match those of an abbreviation whatever their case, with what stands for them.
_MARK, _ODD = "\ue000", ("ſıİ\u212a", "siik")


def held(text: Column, abbreviations) -> Column:
    """A text with its abbreviations in lower case, each with a block in place of its full stop.

    All of them are found in one pass and stand at the odd places between marks. A text that has the mark itself is passed over once for each abbreviation.
    """
    found = rf"(?iU)\b({'|'.join(abbreviations)})\."
    parts = F.split(F.regexp_replace(text, found, f"{_MARK}$1{_MARK}"), _MARK)
    marked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lower(F.translate(x, *_ODD)), F.lit("█"))).otherwise(x)), "")
    each = reduce(lambda t, a: F.regexp_replace(t, rf"(?iU)\b{a}\.", f"{a}█"), abbreviations, text)
    return F.when(text.contains(_MARK), each).otherwise(marked)


def sentences(text: Column, least: int = 10, abbreviations=L.ABBREVIATIONS) -> Column:
    """Split after closing marks; what is left, trimmed, must be longer than ``least``. Abbreviations don't end a sentence and come out in lower case."""
    whole = held(text, abbreviations) if abbreviations else text
    back = (lambda s: F.trim(F.replace(s, F.lit("█"), F.lit(".")))) if abbreviations else (lambda s: F.trim(s))
    return F.filter(F.transform(F.split(whole, r"[.!?]+\s+"), back), lambda s: F.length(s) > least)


def paragraphs(text: Column) -> Column:
    """Split at blank lines; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def bullets(text: Column) -> Column:
    """Split at bullets, dashes and stars that white space follows; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\s*[•·\-–—*]\s+"), lambda p: F.trim(p)), lambda p: p != "")


def normalized(text: Column) -> Column:
    """Lower case, without marks but hyphens, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", " "), r"\s+", " "))


def summary_stats(text: Column) -> dict[str, Column]:
    """Words, sentences, paragraphs, mean length of words and of sentences (in words)."""
    w, s = tokens(text), F.flatten(F.transform(bullets(text), lambda s: sentences(s)))
    letters = F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    mean = lambda a, b: F.when(b > 0, F.round(a / b, 2)).otherwise(0.0)
    return {"word_count": F.size(w), "sentence_count": F.size(s), "paragraph_count": F.size(paragraphs(text)), "avg_word_length": mean(letters, F.size(w)), "avg_sentence_length": mean(F.size(w), F.size(s))}


def page_text(text: Column) -> Column:
    """A page without form feeds, no-break and zero-width spaces, with single spaces and at most one blank line in a row."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, " ​\f", " "), "[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def has_action_verb(text: Column, verbs=L.PRIORITY_VERBS + L.STANDARD_VERBS) -> Column:
    """Whether one of the verbs stands in the text as a word."""
    return F.lower(text).rlike(r"(?U)\b(?:" + "|".join(verbs) + r")\b")


def simple_confidence(text: Column) -> Column:
    """Without a parse: .9 with a priority verb, .7 with an ordinary one, .3 with only a weak one, else .5. Verbs are found as substrings."""
    own = present(F.lower(text), L.PRIORITY_VERBS + L.STANDARD_VERBS + L.WEAK_VERBS)
    choose = lambda low: F.when(any_of(low, L.PRIORITY_VERBS), 0.9).when(any_of(low, L.STANDARD_VERBS), 0.7).when(any_of(low, L.WEAK_VERBS), 0.3).otherwise(0.5)
    return F.get(F.transform(F.array(own), choose), 0)


def section_category(title: Column, titles=L.SECTION_TITLES) -> Column:
    """The first family with a word in a section's title, or null."""
    low, out = F.lower(title), F.lit(None).cast("string")
    for name, words in reversed(titles):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def rating(is_activity: Column, is_council: Column) -> Column:
    """high with both at .7 or more, medium with both at .5 or more, else low."""
    least = F.least(is_activity, is_council)
    return F.when(least >= 0.7, "high").when(least >= 0.5, "medium").otherwise("low")


def joined_sentences(parts: Column, openers, most_words: int) -> Column:
    """Joins a sentence to the one before if its first word leans on it, up to ``most_words`` words.

    Sentences that don't lean begin chains; these are cut out by their places, and a chain that fits as a whole is joined at once. Only
    a chain with too many words is folded.
    """
    leans = lambda s: F.lower(F.get(F.split(s, " "), 0)).isin(*openers)
    count = lambda s: F.size(tokens(s))

    def step(done, s):
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (count(last) + count(s) <= most_words)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(done, F.array(s)))

    def one(chain):
        total = F.aggregate(chain, F.lit(0), lambda n, s: n + count(s))
        return F.when((F.size(chain) == 1) | (total <= most_words), F.array(F.array_join(chain, " "))).otherwise(F.aggregate(chain, F.array().cast("array<string>"), step))

    def chains(own):
        n = F.size(own)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~leans(F.get(own, i)))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(n))
        cut = F.get(F.transform(F.array(first), lambda at: F.zip_with(at, ends(at), lambda a, z: F.slice(own, a + 1, z - a))), 0)
        return F.when(n > 0, F.flatten(F.transform(cut, one))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(parts), chains), 0)


def gated(text: Column, literals, test: Column) -> Column:
    """``test``, which only a text with one of the literals can pass. It isn't evaluated for others."""
    has = any_of(text, literals)
    return F.when(has, test).otherwise(has)


def needed(pattern: str) -> tuple[str, ...]:
    """Runs of small letters of which whatever matches the pattern must have one: the longest outside its groups, or if there is none those of a group's alternatives; empty if nothing is sure."""
    bare = re.sub(r"\\.", "\n", re.sub(r"\[[^]]*\]", "\n", pattern))
    nested = re.search(r"\([^()]*\(", bare)
    flat, groups = None, [] if nested else re.findall(r"\(([^()]*)\)(?![?*{])", bare)
    while bare != flat:
        flat, bare = bare, re.sub(r"\([^()]*\)", "\n", bare)
    longest = lambda p: max(re.split(r"[^a-z]+", re.sub(r"[^\n](?=[?*{])", "\n", p)), key=len)
    if "|" in bare:
        return ()
    options = [tuple(map(longest, g.split("|"))) for g in groups]
    return (longest(bare),) if longest(bare) else max(options, key=lambda words: min(map(len, words)), default=())


def matches_any(text: Column, patterns, flags: str = "") -> Column:
    """Whether one of the patterns matches. Each is tried only on texts with the letters that it needs; patterns that need the same ones are tried together."""
    groups = defaultdict(list)
    for p in patterns:
        groups[needed(p)].append(p)

    def each(words, own):
        test = text.rlike(flags + "|".join(own))
        if all(p.startswith(f"^{w}") for p in own for w in words) and words:
            return F.when(text.startswith(words[0]), test).otherwise(text.startswith(words[0]))
        return gated(text, words, test) if words and all(words) else test

    return reduce(lambda a, b: a | b, (each(*g) for g in groups.items()))


def count_letters(text: Column, kind: str = "L") -> Column:
    return F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", ""))


def looks_like_table(text: Column) -> Column:
    # Both sides of an "or" may be evaluated: nothing there may divide by zero, and the pattern of two years and a sum is tried on texts with just two, as three are enough by themselves.
    digits, size = F.regexp_count(text, F.lit(r"[0-9]")), F.length(F.replace(text, F.lit(" ")))
    n = lambda p: F.regexp_count(text, F.lit(p))
    year = r"\b(?:19|20)\d{2}\b"
    return (
        ((size > 0) & (F.try_divide(digits, size) > 0.15)) | (n(r"\|") >= 2) | (n("\t") >= 2) | (n(r"\*") >= 3) | (n("%") >= 2) | (n(year) >= 3) | (n("Award") >= 2) | (n("Winner") >= 2) | (n("§") >= 2)
        | F.when(n(year) == 2, text.rlike(year + ".*" + year + r".*\$")).otherwise(False) | text.contains("$ '000") | text.contains("000 $")
    )


def is_mostly_numbers(text: Column) -> Column:
    words = tokens(text)
    numbers = F.filter(words, lambda w: w.rlike(r"^[,.$%*|+\-]*[0-9][0-9,.$%*|+\-]*$"))
    return (F.size(words) == 0) | (F.try_divide(F.size(numbers), F.size(words)) > 0.35)


def has_meaningful_content(text: Column) -> Column:
    real = F.filter(tokens(text), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$"))
    return (count_letters(text) >= 20) & (F.size(real) >= 5)


def is_fragmented_start(text: Column) -> Column:
    words = tokens(F.lower(text))
    first, second = F.get(words, 0), F.get(words, 1)
    return F.coalesce(first.isin(*L.DEPENDENT_STARTERS) | (first.isin(*L.DEMONSTRATIVES) & second.isin("includes", "include", "includes:", "include:")), F.lit(False))


def is_structural(text: Column) -> Column:
    """Tables of contents, heads with a year and a page, capitals, addresses of pages, disclaimers, lists of years."""
    low = F.lower(text)
    n = lambda p: F.regexp_count(text, F.lit(p))
    # The head is tried once a line, from the line's first letter or digit.
    head = gated(text, ("20",), text.rlike(r"(?U)(?:^|\n)[^\w\n]*+\w[^\n]*20\d{2}[-–]?\d{0,2}\s+\d+\s*$"))
    letters = count_letters(text)
    address = gated(low, ("http", "www.", ".au"), low.rlike(r"https?://\S|www\.\S|\S\.(?:gov|com|org)\.au"))
    return (
        gated(low, L.CONTENTS, n(r"(?Umd)\b\d+\s*$") >= 2) | head | ((letters > 0) & (F.try_divide(count_letters(text, "Lu"), letters) > 0.7))
        | address | any_of(low, L.DISCLAIMERS) | gated(text, ("19", "20"), n(r"(?U)\b(?:19|20)\d{2}\b") >= 3)
    )


def is_non_activity(text: Column) -> Column:
    """Accounts, audit reports, compliance, lists of staff and mere description."""
    return matches_any(F.lower(text), L.NON_ACTIVITY, "(?U)")


def has_outcome(text: Column) -> Column:
    return text.rlike("(?iU)" + "|".join(L.OUTCOMES))


def is_generic(text: Column) -> Column:
    """Without a priority verb, a council's word or service, a goal's term, an outcome or another body's name."""
    low = F.lower(text)
    named = any_of(low, L.SPECIFIC_TERMS)
    return F.when(named, False).otherwise(~(gated(low, L.PRIORITY_VERBS, low.rlike(r"(?U)\b(?:" + "|".join(L.PRIORITY_VERBS) + r")\b")) | named | has_outcome(text)))


FILTERS = {
    "looks_like_table": looks_like_table, "is_mostly_numbers": is_mostly_numbers, "lacks_content": lambda t: ~has_meaningful_content(t), "is_structural": is_structural,
    "is_fragmented_start": is_fragmented_start, "is_non_activity": is_non_activity, "is_generic": is_generic,
}


def passes(text: Column, filters=FILTERS) -> Column:
    return ~reduce(lambda a, b: a | b, (f(text) for f in filters.values()))


def section_type(text: Column, sections=L.SECTIONS) -> Column:
    """The first section, in order, with a keyword in the text."""
    low, out = F.lower(text), F.lit("general")
    for name, terms in reversed(sections):
        out = F.when(any_of(low, terms), name).otherwise(out)
    return out


def relevance(text: Column, goal_terms, specific=L.SPECIFICITY, outcome: float = 0.06) -> Column:
    low, words = F.lower(text), tokens(text)
    share = F.try_divide(F.size(F.filter(words, lambda w: w.rlike("[0-9]"))), F.size(words))
    score = 0.3 + F.least(count_of(low, goal_terms) * 0.04, F.lit(0.16))
    score = (score + F.when(has_outcome(text), outcome).otherwise(0.0) if outcome else score) + F.least(count_of(low, specific) * 0.02, F.lit(0.08))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.least(score * F.when(share > 0.25, 0.6).when(share > 0.15, 0.8).otherwise(1.0), F.lit(1.0)), 4))


def tier(valid: Column, verb: Column, confidence: Column) -> Column:
    return F.when(valid & verb & (confidence >= 0.6), "A").when((confidence >= 0.4) | (valid & ~verb), "B").otherwise("C")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def report_identity(name: Column) -> dict[str, Column]:
    """state, council, setting and year of a file name such as State_Some_Council_Urban_2023.csv."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "_")
    return {"state": F.get(parts, 0), "council": F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 3, F.lit(0))), " "), "setting": F.element_at(parts, -2), "year": F.element_at(parts, -1)}


def html_text(html: Column) -> Column:
    """Tags and what scripts and styles hold become spaces; white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def mention(text: Column, pattern: str) -> Column:
    """The first sentence with the pattern, up to its closing mark, or null. Sentences are cut first, so that long texts without marks take linear time."""
    ends = F.filter(F.split(text, "(?<=[.!?])"), lambda s: s.rlike(rf"(?i)(?:{pattern})[^.!?]*[.!?]$"))
    return F.nullif(F.trim(F.get(ends, 0)), F.lit(""))


def context(text: Column, statement: Column, around: int = 100, lead: int = 50) -> Column:
    """What stands around a statement in its source, found by its first characters; null if it isn't there."""
    at = F.call_function("locate", F.substring(statement, 1, lead), text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(statement) + around))


def broken_letters(text: Column) -> Column:
    """Runs of three or more single letters set apart, per word: a mark of bad character recognition. A text without words has none."""
    return F.regexp_count(text, F.lit(r"(?:\b[A-Za-z] ){2,}[A-Za-z]\b")) / F.greatest(F.size(tokens(text)), F.lit(1))
