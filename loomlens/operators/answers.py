"""What a language model answered, as rows: JSON objects out of fenced text, and numbered lines completed to the expected sequence.

All of it is expressions over an answer's own text; models aren't called here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as LN
from ..functions import text as T

#: What an answer is asked to hold.
OBJECT = "label string, category string, entities array<string>, summary string"
LABELS = ("ACTION", "POLICY", "NEUTRAL")
_LABEL = rf"\[({'|'.join(LABELS)})\]"
STRICT = rf"(?i)Sentence\s+(\d+)\s*:\s*Reasoning:\s*(.+?)\s*\|\s*Category:\s*{_LABEL}"
LOOSE = r"(?i)^(?:Sentence\s+)?(\d+)\s*[:.)]\s*"


def unfenced(answer: Column) -> Column:
    """What stands in the first fence, or all."""
    after = lambda mark: F.substring_index(F.substring(answer, F.instr(answer, mark) + len(mark), F.length(answer)), "```", 1)
    return LN.stripped(F.when(answer.contains("```json"), after("```json")).when(answer.contains("```"), after("```")).otherwise(answer))


def plain_label(text: Column) -> Column:
    """The first four words, the first letter a capital and all others small; of fewer words the first thirty characters as they stand."""
    w = T.tokens(text)
    four = F.array_join(F.slice(w, 1, 4), " ")
    return F.when(F.size(w) >= 4, F.concat(F.upper(F.left(four, F.lit(1))), F.lower(F.substring(four, 2, 1_000_000)))).otherwise(F.left(text, F.lit(30)))


def labelled(rows: DataFrame, answer: str, text: str) -> DataFrame:
    """``rows`` with label, category, entities, summary, and llm_error where the answer is null, empty or no JSON object; then they come from the text itself."""
    body = unfenced(F.col(answer))
    got = F.from_json(body, OBJECT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = rows.withColumn("_got", F.when(body.rlike(r"(?s)^\{.*\}$"), got))
    failed = F.col("_got").isNull() | F.col("_got._corrupt").isNotNull()
    short = F.when(F.length(text) > 100, F.concat(F.left(F.col(text), F.lit(100)), F.lit("..."))).otherwise(F.col(text))
    return read.withColumns({
        "label": F.when(failed, plain_label(F.col(text))).otherwise(F.coalesce("_got.label", F.lit(""))), "category": F.when(failed, "General").otherwise(F.coalesce("_got.category", F.lit("General"))),
        "entities": F.when(failed, F.array().cast("array<string>")).otherwise(F.coalesce("_got.entities", F.array().cast("array<string>"))), "summary": F.when(failed, short).otherwise(F.coalesce("_got.summary", F.lit(""))),
        "llm_error": failed,
    }).drop("_got")


def numbered(rows: DataFrame, key: str, answer: str, expected: str) -> DataFrame:
    """(key, number, label, reasoning) for each number from 1 to ``expected``: by the strict form, whose last answer to a number counts, else by a looser line, whose first does, else PARSE_ERROR.

    A null answer answers nothing.
    """
    all_ = lambda k: F.regexp_extract_all(F.col("_a"), F.lit(STRICT), F.lit(k))
    triple = lambda n, r, c: F.struct(n.try_cast("long").alias("n"), LN.stripped(r).alias("reasoning"), F.upper(c).alias("label"))
    strict = F.zip_with(F.arrays_zip(all_(1).alias("n"), all_(2).alias("r")), all_(3), lambda a, c: triple(a["n"], a["r"], c))

    def loose(line: Column) -> Column:
        rest = F.regexp_replace(line, LOOSE, "")
        label = F.upper(F.regexp_extract(line, "(?i)" + _LABEL, 1))
        bare = F.regexp_replace(rest, rf"\s*\|\s*Category:\s*\[(?:{'|'.join(LABELS)})\]\s*$", "")
        return F.struct(F.regexp_extract(line, LOOSE, 1).try_cast("long").alias("n"), LN.stripped(F.regexp_replace(LN.stripped(bare), r"(?i)^Reasoning:\s*", "")).alias("reasoning"), label.alias("label"))

    lines = F.filter(F.transform(F.split(F.col("_a"), "\n"), lambda x: LN.stripped(x)), lambda x: x.rlike(LOOSE) & x.rlike("(?i)" + _LABEL))
    read = rows.select(key, F.col(expected).cast("int").alias("_n"), F.coalesce(F.col(answer), F.lit("")).alias("_a")).withColumns({"_strict": strict, "_loose": F.transform(lines, loose)})
    each = read.where("_n > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("number"), "_strict", "_loose")
    of = lambda c, at: F.try_element_at(F.filter(c, lambda x: x["n"] == F.col("number")), F.lit(at))
    got = F.coalesce(of("_strict", -1), of("_loose", 1))
    return each.select(key, "number", F.coalesce(got["label"], F.lit("PARSE_ERROR")).alias("label"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning"))
