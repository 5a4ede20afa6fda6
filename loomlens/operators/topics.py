"""Topics of texts and groups of vectors, by MLlib."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lda(docs: DataFrame, k: int = 5, rounds: int = 20, terms: int = 8, text: str = "text", vocabulary: int = 500) -> DataFrame:
    """topic, place, word, weight: the leading words of each topic."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    words = docs.select(F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: F.length(w) >= 4).alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, maxDF=0.95).fit(words)
    fitted = LDA(k=k, maxIter=rounds, seed=42, optimizer="online").fit(model.transform(words))
    names = F.array(*map(F.lit, model.vocabulary))
    topics = fitted.describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "x"))
    return topics.select("topic", "place", F.get(names, F.col("x.termIndices")).alias("word"), F.col("x.termWeights").alias("weight"))


def kmeans(vectors: DataFrame, key: str, embedding: str, k: int = 10, rounds: int = 20) -> DataFrame:
    """key and cluster of every vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    return KMeans(k=k, maxIter=rounds, seed=42).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))
