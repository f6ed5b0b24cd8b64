"""Abbreviations learned from a corpus, without labels.

A word that nearly always has a full stop behind it is likelier an abbreviation than one that
ends sentences now and then. The evidence is a log likelihood ratio between two rates of stops:
that of all words, and one close to always. Short words and words with stops inside need less of
it, and every occurrence without a stop counts against a long word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Letters, single stops inside, and a stop behind.
TOKEN = r"\p{L}+(?:\.\p{L}+)*\.?"
#: The rate of stops behind an abbreviation, the score from which a word is one, and how many
#: are returned at most by ``abbreviations``.
ALWAYS, LEAST_SCORE, MOST = 0.99, 0.3, 2000


def stop_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, stopped and bare: occurrences of each lower-cased word with a stop and without."""
    tokens = df.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).alias("t"))
    stop = F.endswith("t", F.lit("."))
    word = F.lower(F.when(stop, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")))
    return tokens.groupBy(word.alias("word")).agg(F.count_if(stop).alias("stopped"), F.count_if(~stop).alias("bare"))


def abbreviation_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """word, stopped, bare and score of every word that ever has a stop behind it."""
    counts = stop_counts(df, text)
    totals = counts.agg(F.struct(F.sum("stopped").alias("s"), F.sum("bare").alias("b")).alias("t"))
    k, n = F.col("stopped").cast("double"), (F.col("stopped") + F.col("bare")).cast("double")
    rate = F.col("t.s") / (F.col("t.s") + F.col("t.b"))
    # a corpus whose words all have stops tells nothing
    null = k * F.log(rate) + F.when(n > k, (n - k) * F.log(F.nullif(1 - rate, F.lit(0.0)))).otherwise(0.0)
    always = k * F.log(F.lit(ALWAYS)) + (n - k) * F.log(F.lit(1 - ALWAYS))
    size = F.length(F.replace(F.col("word"), F.lit("."), F.lit(""))).cast("double")
    inner = F.length("word") - size
    score = 2 * (always - null) * F.exp(-size) * (inner + 1) * F.pow(size, -F.col("bare"))
    return counts.withColumn("t", totals.scalar()).filter("stopped > 0").select("word", "stopped", "bare", score.alias("score"))


def abbreviations(df: DataFrame, text: str = "text", least: float = LEAST_SCORE, most: int = MOST) -> list[str]:
    """The words with the highest scores, at most ``most``, for ``cleaning.sentences``."""
    best = abbreviation_scores(df, text).filter(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most)
    return [r["word"] for r in best.collect()]
