"""What a query means: its terms after aliases, splitting and correction, the groups of words that may stand for a term, and the
facets it names. All queries at once; what only depends on a word is worked out once for each distinct word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..plans.index import Index
from ..scratch import written
from ..shipping import shipped
from .spell import compounds, corrections


@dataclass
class Understood:
    """terms (query_id, pos, term); fixes (query_id, at, word, corrected); groups (term, member); facets (query_id, kind, value,
    source, pos)."""

    queries: DataFrame
    terms: DataFrame
    fixes: DataFrame
    groups: DataFrame
    facets: DataFrame


def query_words(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, pos, word): at most ten words of the first 120 characters, aliases replaced."""
    words = T.tokenise(F.substring("raw", 1, L.MAX_QUERY_CHARS))
    if index.lexicons.aliases:
        names = F.create_map(*[F.lit(x) for pair in index.lexicons.aliases.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(names, w), w))
    return shipped(queries).select("query_id", F.posexplode(F.slice(words, 1, L.MAX_TOKENS)).alias("pos", "word"))


def bases(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, i, base): base forms in order."""
    return words.select(F.col(column).alias("word"), F.posexplode(T.word_variants(F.col(column))).alias("i", "base"))


def understand(index: Index, queries: DataFrame) -> Understood:
    """queries: (query_id, raw)."""
    words = written(query_words(index, queries), "query-words")
    distinct = words.select("word").distinct()
    facet_words = index.words.select("word").distinct()
    plain = distinct.join(facet_words, "word", "left_anti")
    fixed = written(corrections(index, plain).join(index.terms.select(F.col("term").alias("word"), "df"), "word", "left"), "corrections")
    lost = fixed.where("df is null and distance < 0")
    split = compounds(index, lost)
    read = fixed.join(split, "word", "left").select("word", "left", F.when(F.col("left").isNotNull(), F.array("left", "right")).otherwise(F.array("corrected")).alias("parts"), "distance", "corrected", "right")
    placed = words.join(read, "word", "left").select("query_id", "pos", "word", F.coalesce("parts", F.array("word")).alias("parts"), "left", "right", "distance", "corrected")
    each = placed.select("query_id", "pos", "word", "left", "right", "distance", "corrected", F.posexplode("parts").alias("part", "term"))
    order = Window.partitionBy("query_id").orderBy("pos", "part")
    each = written(each.withColumn("tpos", F.row_number().over(order) - 1), "placed-words")
    terms = each.where(F.col("tpos") < L.MAX_TOKENS).select("query_id", F.col("tpos").alias("pos"), "term")
    splits = each.where("left is not null and part = 0").select("query_id", F.col("pos").alias("at"), "word", F.concat_ws(" ", "left", "right").alias("corrected"))
    changes = each.where((F.col("tpos") < L.MAX_TOKENS) & F.col("left").isNull() & (F.col("distance") > 0)).select("query_id", (F.col("pos") + 100).alias("at"), "word", "corrected")
    fixes = splits.unionByName(changes).groupBy("query_id", "word", "corrected").agg(F.min("at").alias("at"))  # splits are noted first

    distinct_terms = terms.select(F.col("term").alias("word")).distinct()
    variant = index.variants.where("status = 'kept'").select("word", "target")
    of_variant = distinct_terms.join(F.broadcast(variant), "word").select("word", F.col("target").alias("lead"))
    of_variant = written(of_variant, "variant-leads")
    known = bases(distinct_terms).join(index.terms.select(F.col("term").alias("base")), "base")
    of_base = known.groupBy("word").agg(F.min_by("base", "i").alias("lead"))
    leads = distinct_terms.select("word", F.col("word").alias("lead")).unionByName(of_variant).unionByName(of_base).distinct()
    grown = index.prefix_terms(leads.select(F.col("lead").alias("word"))).select(F.col("word").alias("lead"), "term")
    groups = leads.select(F.col("word").alias("term"), F.col("lead").alias("member")).unionByName(leads.join(grown, "lead").select(F.col("word").alias("term"), F.col("term").alias("member"))).distinct()

    named = distinct_terms.join(index.words, "word").select("word", "kind", "value", "at")
    own = distinct_terms.select("word", F.lit(-2).alias("i"), F.col("word").alias("form"))
    forms = own.unionByName(of_variant.select("word", F.lit(-1).alias("i"), F.col("lead").alias("form"))).unionByName(bases(distinct_terms).select("word", "i", F.col("base").alias("form")))
    led = forms.join(index.occasion_of.select(F.col("word").alias("form"), "section"), "form").groupBy("word").agg(F.min_by("section", "i").alias("value"))
    of_word = named.unionByName(led.select("word", F.lit("occasion").alias("kind"), "value", F.lit(1 << 20).alias("at")))
    met = terms.join(of_word, terms.term == of_word.word).select("query_id", "kind", "value", F.col("term").alias("source"), F.struct("pos", "at").alias("place"))
    first = met.groupBy("query_id", "kind", "value").agg(F.min_by("source", "place").alias("source"), F.min("place").alias("place"))
    return Understood(queries, terms, written(fixes, "fixes"), written(groups, "groups"), written(first, "query-facets"))


def nearest_occasion(index: Index, u: Understood) -> DataFrame:
    """(query_id, section, n): the section whose words a query shares most, the first by name of equals."""
    shared = u.terms.select("query_id", "term").distinct().join(index.occasion_terms, "term").groupBy("query_id", "section").agg(F.count("*").alias("n"))
    best = shared.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "section")).alias("b"))
    return best.select("query_id", "b.section", (-F.col("b.m")).alias("n"))
