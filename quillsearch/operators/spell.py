"""Spelling: corrections by shared deletions, and words that are two words written as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..plans.index import Index
from ..shipping import shipped


def corrections(index: Index, words: DataFrame) -> DataFrame:
    """(word, corrected, distance) of the distinct words: distance 0 if the dictionary has the word, -1 if nothing is near.

    Words and dictionary meet where they agree after leaving out up to two letters (three for long words), and each meeting
    is measured. The dictionary's side of the meeting lies in buckets that no call moves; words far longer than any term are never taken apart.
    """
    words = words.select("word").where("word is not null").distinct()
    vocabulary = index.vocabulary
    known = words.join(vocabulary, F.col("word") == F.col("term"), "left_semi")
    cap = F.when(F.length("word") >= L.LOOSE_MIN_QUERY, L.LOOSE_EDITS).otherwise(L.EDITS)
    open_words = words.join(vocabulary, F.col("word") == F.col("term"), "left_anti").withColumn("cap", cap)
    open_words = open_words.where((F.length("word") >= L.MIN_CORRECTABLE) & (F.length("word") <= F.lit(index.longest_term) + F.col("cap")))
    asked = open_words.select("word", "cap", F.explode(F.when(F.col("cap") == L.LOOSE_EDITS, T.deletes(F.col("word"), L.LOOSE_EDITS)).otherwise(T.deletes(F.col("word"), L.EDITS))).alias("variant"))
    pairs = asked.join(index.deletions, "variant").select("word", "cap", "term", "df").distinct()
    measured = shipped(pairs).withColumn("distance", T.edit_distance(F.col("word"), F.col("term"), F.col("cap")))
    fair = (F.col("distance") <= L.EDITS) | (F.col("distance") <= L.LOOSE_RATIO * F.greatest(F.length("word"), F.length("term")))
    best = Window.partitionBy("word").orderBy("distance", F.desc("df"), "term")
    found = measured.where((F.col("distance") <= F.col("cap")) & fair).withColumn("r", F.row_number().over(best)).where("r = 1").select("word", F.col("term").alias("corrected"), "distance")
    done = known.select("word", F.col("word").alias("corrected"), F.lit(0).alias("distance")).unionByName(found)
    return words.join(done, "word", "left").select("word", F.coalesce("corrected", "word").alias("corrected"), F.coalesce("distance", F.lit(-1)).alias("distance"))


def compounds(index: Index, words: DataFrame) -> DataFrame:
    """(word, left, right) of words that are two dictionary words: the cut with the most frequent rarer half, the leftmost of equals."""
    least = L.MIN_COMPOUND_PART
    cuts = words.select("word").distinct().where(F.length("word") >= 2 * least).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("cut"))
    halves = cuts.select("word", "cut", F.substring("word", F.lit(1), F.col("cut")).alias("left"), F.substring("word", F.col("cut") + 1, F.length("word")).alias("right"))
    used = index.terms.where(F.col("df") >= L.MIN_FREQUENCY)
    side = lambda name: used.select(F.col("term").alias(name), F.col("df").alias(f"{name}_df"))
    both = halves.join(side("left"), "left").join(side("right"), "right")
    best = Window.partitionBy("word").orderBy(F.desc(F.least("left_df", "right_df")), "cut")
    return both.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "left", "right")
