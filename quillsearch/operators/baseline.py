"""The baseline engine: synonyms, stop words, every word a substring, the first 500 rows; found through a trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..plans.bitmaps import common, documents, slabs, united
from ..plans.index import Index
from ..scratch import written
from ..shipping import shipped
from .search import pages, search


#: Trigrams of a word whose document sets are ANDed before its places are verified; the rarest.
RAREST = 4


def asked_grams(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, key, needed, block, bits, few) for (query_id, word): the document sets whose common documents may hold all words of a query.

    A word goes by its rarest trigrams; one of fewer letters by all trigrams that begin with it, any of which will do (key).
    """
    words = asked.select("word").distinct()
    long = words.where(F.length("word") >= 3).select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3))))).alias("gram"))
    rank = Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "gram")
    rare = long.join(index.gram_sizes, "gram", "left").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= RAREST).select("word", "gram")
    short = words.where(F.length("word") < 3)
    begun = index.gram_sizes.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("word")).join(short, "word").distinct()
    keys = asked.join(rare, "word").select("query_id", F.col("gram").alias("key"), "gram").distinct()
    keys = keys.unionByName(asked.join(begun, "word").select("query_id", F.concat(F.lit(" "), "word").alias("key"), "gram").distinct())
    # a word that no row holds still counts as needed
    needed = keys.select("query_id", "key").unionByName(asked.join(short, "word").select("query_id", F.concat(F.lit(" "), "word").alias("key"))).distinct().groupBy("query_id").agg(F.count("*").alias("needed"))
    return keys.join(needed, "query_id").join(index.gram_sets, "gram").select("query_id", "key", "needed", "block", "bits", "few")


def old_search(index: Index, queries: DataFrame, limit: int = 10, cap: int = L.BASELINE_CAP) -> DataFrame:
    """(query_id, rank, doc, n) over the index's cards: the first cap matches in order of doc; n is how many those are.

    A row matches if all words are anywhere in its text. Trigrams meet by equality and their document sets are ANDed; what is left is
    verified on the text, which a word's own trigrams may be scattered over. A query without words has no matches.
    """
    asked = written(shipped(queries).select("query_id", F.explode(F.array_distinct(T.baseline_tokens(F.col("raw")))).alias("word")), "baseline-words")
    met = documents(slabs(common(united(asked_grams(index, asked), "query_id", "key", "needed"), "needed", "query_id"), index.slab_bits).drop("n"), index.slab_bits)
    words = asked.groupBy("query_id").agg(F.collect_list("word").alias("words"))  # as many as a query has
    true = met.join(index.blobs, "doc").join(words, "query_id").where(F.forall("words", lambda w: F.contains(F.col("blob"), w))).select("query_id", "doc")
    place = Window.partitionBy("query_id").orderBy("doc")
    first = true.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= cap)
    first = first.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("rank") <= limit)
    return first.select("query_id", "rank", "doc", "n")


def compare(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, old_n, new_n, strategy): both engines on the same queries."""
    old = old_search(index, queries, limit).groupBy("query_id").agg(F.max("n").alias("old_n"))
    new = search(index, queries, limit).groupBy("query_id").agg(F.count("*").alias("new_n"), F.max("strategy").alias("strategy"))
    return queries.select("query_id").join(old, "query_id", "left").join(new, "query_id", "left").select("query_id", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"), "strategy")


def replay(index: Index, log: DataFrame, limit: int = L.MAX_RESULTS) -> DataFrame:
    """(query_id, query, times, old_n, new_n, strategy, fixed) for log (query_id, query, times, results): the log played against the engine."""
    per = pages(index, log.select("query_id", F.col("query").alias("raw")), limit)
    per = per.select("query_id", F.col("n").alias("new_n"), "strategy", F.startswith(F.coalesce("message", F.lit("")), F.lit("Showing results for")).alias("fixed"))
    return written(log.join(per, "query_id", "left").select("query_id", "query", "times", F.col("results").alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"), "strategy", F.coalesce("fixed", F.lit(False)).alias("fixed")), "replayed")
