"""Completions from a query log and the catalogue's tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..plans.index import Index
from ..scratch import written
from ..shipping import shipped
from .search import search


# Fixed value: what is never offered.
REJECTED = r"""(?i)[<>"'`;\\|${}()\[\]/]|script|alert|passwd|\bs's\b|\+"""


def suggestable(phrase: Column) -> Column:
    """Safe and sensible to offer."""
    probe = phrase.rlike(REJECTED)
    return F.length(phrase).between(3, 40) & ~probe & phrase.rlike(r"\A[a-z0-9 &.,'-]+\z") & ~F.replace(phrase, F.lit(" "), F.lit("")).rlike(r"\A[0-9]+\z")


def offered(log: DataFrame) -> DataFrame:
    """(phrase, offered): the normalised queries of a log and whether any may be offered; numbers, probes and what is too short or long may not."""
    phrases = shipped(log).select(T.normalise(F.col("query")).alias("phrase")).distinct()
    return phrases.select("phrase", suggestable(F.col("phrase")).alias("offered"))


def canonical(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, key, usual): each word as the form that the catalogue uses most, and whether the dictionary has all words."""
    words = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("pos", "word"))
    own = words.select("word").distinct()
    forms = own.select("word", F.lit(-1).alias("i"), F.col("word").alias("form")).unionByName(own.select("word", F.posexplode(T.word_variants(F.col("word"))).alias("i", "form")))
    counted = forms.join(index.terms.select(F.col("term").alias("form"), "df"), "form", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = counted.groupBy("word").agg(F.max_by("form", F.struct("df", -F.col("i"))).alias("form"), F.max(F.when(F.col("i") == -1, F.col("df"))).alias("df"))
    parts = words.join(best, "word").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("parts"), F.bool_and(F.col("df") >= L.MIN_FREQUENCY).alias("usual"))
    return parts.select("phrase", F.array_join(F.transform("parts", lambda x: x["form"]), " ").alias("key"), "usual")


def build(index: Index, log: DataFrame | None = None, verify: bool = True) -> DataFrame:
    """(phrase, weight) from log (query, times) and tags. Spellings of one phrase are merged under the one of most weight, the log's
    first; what no tag backs is offered only if a search finds something."""
    raw = index.tag_phrases.select("phrase", (F.col("n") * L.TAG_WEIGHT).alias("weight"), F.lit(1).alias("seq"))
    if log is not None:
        asked = shipped(log).select(T.normalise(F.col("query")).alias("phrase"), (F.col("times") * L.LOG_WEIGHT).alias("weight"), F.lit(0).alias("seq"))
        raw = asked.unionByName(raw)
    raw = written(raw.where(suggestable(F.col("phrase"))), "suggestable")
    keyed = raw.join(canonical(index, raw).where("usual"), "phrase")
    merged = keyed.groupBy("key").agg(F.sum("weight").alias("weight"), F.max_by("phrase", F.struct("weight", -F.col("seq"), "phrase")).alias("surface"))
    if verify:
        merged = written(merged, "merged")
        tags = index.tag_phrases.select(F.col("phrase").alias("key"))
        unbacked = merged.join(tags, "key", "left_anti").select(F.col("key").alias("query_id"), F.col("surface").alias("raw"))
        alive = search(index, unbacked, limit=1).where("not fallback").select(F.col("query_id").alias("key"))
        merged = merged.join(tags.unionByName(alive).distinct(), "key", "left_semi")
    return merged.groupBy(F.col("surface").alias("phrase")).agg(F.round(F.sum("weight"), 9).alias("weight"))


@dataclass
class Completions:
    """What completes a prefix, worked out for every prefix that there is.

    tops (kind, key, phrase, weight): the best limit + 1 phrases that begin with key (kind 0, of all or of the first window in order) or have a word
    that does (kind 1); one more than are shown, as what was typed is no completion of itself. prefixes (prefix, word) and phrases (word, phrase,
    weight) lead from the last of several words to the phrases that the words before it are looked for in."""

    limit: int
    tops: DataFrame
    prefixes: DataFrame
    phrases: DataFrame


def prefixes_of(rows: DataFrame, column: str, least: int, name: str) -> DataFrame:
    """rows with a row for each prefix of column of least characters or more."""
    long = rows.where(F.length(column) >= least)
    return long.withColumn(name, F.explode(F.transform(F.sequence(F.lit(least), F.length(column)), lambda n: F.substring(column, F.lit(1), n))))


def completions(suggestions: DataFrame, limit: int = L.SUGGEST_LIMIT, window: int | None = L.SUGGEST_WINDOW) -> Completions:
    """suggestions: (phrase, weight). window: how many phrases in order, of those that begin with a key, come before those with a word that does, as in the
    engine this one matches; None: all of them, the heaviest first however many there are. No window sees more of a key's rows than each task's first few: the order that a window cuts at is applied
    before its exchange too."""
    best = Window.partitionBy("key").orderBy(F.desc("weight"), F.length("phrase"), "phrase")
    top = lambda rows, kind: rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit + 1).select(F.lit(kind).alias("kind"), "key", "phrase", "weight")
    begun = prefixes_of(suggestions.select("phrase", "weight"), "phrase", L.SUGGEST_MIN_CHARS, "key")
    if window is not None:
        begun = begun.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("phrase"))).where(F.col("i") <= window)
    phrases = written(suggestions.select(F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"), "phrase", "weight"), "phrase-words")
    held = prefixes_of(phrases, "word", L.SUGGEST_MIN_CHARS, "key").select("key", "phrase", "weight").distinct()
    prefixes = written(prefixes_of(phrases.select("word").distinct(), "word", 1, "prefix").select("prefix", "word"), "word-prefixes")
    return Completions(limit, written(top(begun, 0).unionByName(top(held, 1)), "completions"), prefixes, phrases)


def suggest(table: Completions, typed: DataFrame, limit: int = L.SUGGEST_LIMIT) -> DataFrame:
    """(typed_id, rank, phrase) for typed (typed_id, typed): phrases that begin with what was typed, then phrases with a word that begins
    with its last word and all words before anywhere; heavier, shorter, then in order. limit is at most that of the table. One
    typed word is one lookup of its key; more words also go by the words that their last one begins."""
    if limit > table.limit:
        raise ValueError(f"the table holds completions for limits up to {table.limit}")
    t = shipped(typed).select("typed_id", T.normalise(F.col("typed")).alias("t")).where(F.length("t") >= L.SUGGEST_MIN_CHARS).withColumn("ws", F.split("t", " "))
    alone = F.size("ws") == 1
    keys = F.when(alone, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    direct = t.select("typed_id", "t", F.explode(keys).alias("kind"), F.col("t").alias("key")).join(table.tops, ["kind", "key"]).select("typed_id", "t", "phrase", "weight", "kind")
    several = t.where(~alone).select("typed_id", "t", F.slice("ws", 1, F.size("ws") - 1).alias("heads"), F.element_at("ws", -1).alias("prefix"))
    inner = several.join(table.prefixes, "prefix").join(table.phrases, "word").where(F.forall("heads", lambda h: F.contains(F.col("phrase"), h)))
    hits = direct.unionByName(inner.select("typed_id", "t", "phrase", "weight", F.lit(1).alias("kind")))
    hits = hits.where("phrase <> t").groupBy("typed_id", "phrase").agg(F.min("kind").alias("kind"), F.max("weight").alias("weight"))
    order = Window.partitionBy("typed_id").orderBy("kind", F.desc("weight"), F.length("phrase"), "phrase")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("typed_id", "rank", "phrase")
