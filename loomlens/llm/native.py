"""Words of whole texts as Catalyst expressions, for the operators that use no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The Kelvin sign, the one letter beyond ASCII whose lower case is ASCII, and a letter without case that stands for it.
KELVIN, KRA = "\u212a", "\u0138"
#: What stands between words: all ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lowered(word: Column) -> Column:
    """Lower case. Letters beyond ASCII are lowered too, but none becomes ASCII: words that are equal when only ASCII
    is lowered stay equal, and an ASCII word has no equals but its own. Others that this makes equal are told apart when
    a match is confirmed."""
    return F.lower(F.replace(word, F.lit(KELVIN), F.lit(KRA)))


def words(text: Column) -> Column:
    """Words in the lower case of ``lowered``."""
    return F.transform(F.filter(F.split(F.replace(text, F.lit(KELVIN), F.lit(KRA)), BETWEEN), lambda w: w != ""), F.lower)


def exact_words(text: Column) -> Column:
    """Words with only ASCII letters lowered."""
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 (rows of one key are equal), doc_id and text, empty where it is null."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("k1"), F.hash(text, doc_id).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


KEYS = ["k1", "k2"]

