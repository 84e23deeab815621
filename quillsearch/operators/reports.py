"""Reports on search quality (over replay()) and on the state of a catalogue, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T

# What the audits look for.
HUMOUR_TAGS = "funny humor humour hilarious joke jokes lol comedy silly laugh".split()
TYPOS = [("aniversary", "anniversary"), ("chrismas", "christmas"), ("birthdya", "birthday"), ("freind", "friend"), ("congradulations", "congratulations")]
AUDIT_QUERIES = ["funny birthday card for wife", "happy birthday card for my beautiful mom", "animated birthday", "flash card", "belated birthday sorry", "wedding congratulations", "romantic anniversary for husband", "sorry card for friend", "birthday card for boss", "cute love card for girlfriend"]
CAP_WORDS = "birthday love christmas anniversary friend thank wedding funny mother".split()


def number(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def zero_rate(replayed: DataFrame) -> DataFrame:
    empty = lambda n: F.when(F.col(n) == 0, 1).otherwise(0)
    return replayed.agg(F.count("*").alias("queries"), number(F.col("times")).alias("searches"), number(empty("old_n")).alias("old_zero"), number(empty("new_n")).alias("new_zero"), number(empty("old_n") * F.col("times")).alias("old_volume"), number(empty("new_n") * F.col("times")).alias("new_volume"))


def regressions(replayed: DataFrame) -> DataFrame:
    return replayed.where((F.col("old_n") > 0) & (F.col("new_n") == 0) & (T.strip(F.col("query")) != "")).select("query_id", "times", "old_n").orderBy(F.desc("times"))


def still_zero(replayed: DataFrame) -> DataFrame:
    return replayed.where("old_n = 0 and new_n = 0").select("query_id", "times").orderBy(F.desc("times"))


def rescued(replayed: DataFrame) -> DataFrame:
    return replayed.where("old_n = 0 and new_n > 0").select("query_id", "times", "new_n", "strategy").orderBy(F.desc("times"))


def over_matching(replayed: DataFrame, total: int) -> DataFrame:
    return replayed.where(F.col("old_n") > total * L.OVER_MATCH).select("query_id", "times", "old_n", F.round(100.0 * F.col("old_n") / total, 6).alias("share"))


def strategy_mix(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("strategy").agg(number(F.col("times")).alias("searches")).orderBy(F.desc("searches"))


def mean_year(results: DataFrame) -> DataFrame:
    """(query_id, mean_year) of search results; undated rows count as year 0."""
    return results.groupBy("query_id").agg(F.round(F.avg("year"), 6).alias("mean_year"))


def correction_rate(replayed: DataFrame) -> DataFrame:
    return replayed.agg(number(F.when(F.col("fixed"), F.col("times")).otherwise(0)).alias("corrected"), number(F.col("times")).alias("searches"))


def audit_rows(catalogue: DataFrame, live_only: bool = True) -> DataFrame:
    """Served rows, excluded labels among them, with blob (what the baseline's index holds) and year."""
    rows = catalogue.where("status_id = '1' and invalid_card = '0'") if live_only else catalogue
    slug = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")), F.lit(".html"), F.lit(""))
    parts = [F.coalesce(c, F.lit("")) for c in ("card_title", "card_description", "card_tags")] + [slug("q1_value"), slug("card_page_url"), F.coalesce("dev_id", F.lit(""))]
    return rows.withColumns({"blob": F.lower(F.concat_ws(" ", *parts)), "year": T.year(F.col("card_created_date"))})


def stop_word_damage(rows: DataFrame) -> DataFrame:
    stops = F.array(*[F.lit(w) for w in L.BASELINE_STOP_WORDS])
    kept = F.size(F.filter(F.regexp_extract_all(F.lower("card_title"), F.lit("([a-z0-9']+)")), lambda w: ~F.array_contains(stops, w)))
    return rows.agg(F.count("*").alias("cards"), number(F.when(kept == 0, 1).otherwise(0)).alias("none_left"), number(F.when(kept == 1, 1).otherwise(0)).alias("one_left"))


def _tagged(rows: DataFrame, words: list[str]) -> Column:
    tags = F.lower(F.coalesce("card_tags", F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(tags, w))


def tone_precision(rows: DataFrame, word: str = "funny", leak: str = r"\bfun(-|\s|ny|ni)", tags: list[str] | None = None) -> DataFrame:
    """How many rows hold the word, how many of them by a tag of its meaning, and how many rows a stemmer would add."""
    genuine = _tagged(rows, tags or HUMOUR_TAGS)
    has = F.contains("blob", F.lit(word))
    one = lambda c: number(F.when(c, 1).otherwise(0))
    return rows.agg(one(has).alias("matched"), one(has & genuine).alias("genuine"), one(has & ~genuine).alias("prose_only"), one(F.col("blob").rlike(leak) & ~genuine).alias("leaked"))


def leak_sections(rows: DataFrame, leak: str = r"\bfun(-|\s|ny|ni)", tags: list[str] | None = None, top: int = 8) -> DataFrame:
    return rows.where(F.col("blob").rlike(leak) & ~_tagged(rows, tags or HUMOUR_TAGS)).groupBy(T.section(F.col("q1_value")).alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(top)


def misspellings(rows: DataFrame, typos: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows that hold a typo, those that hold it in a tag, and rows that hold the right word: one pass for all pairs."""
    tags = F.lower(F.coalesce("card_tags", F.lit("")))
    count = lambda c, w: F.when(F.contains(c, F.lit(w)), 1).otherwise(0)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("typo"), F.lit(b).alias("correct"), count(F.col("blob"), a).alias("h"), (count(F.col("blob"), a) * count(tags, a)).alias("t"), count(F.col("blob"), b).alias("r")) for a, b in typos or TYPOS]))
    return rows.select(each.alias("x")).groupBy("x.typo", "x.correct").agg(number(F.col("x.h")).alias("hits"), number(F.col("x.t")).alias("via_tags"), number(F.col("x.r")).alias("correct_hits"))


def strict_and(rows: DataFrame, queries: list[str] | None = None) -> DataFrame:
    """(query, words, dropped, matches) of the baseline on a few queries."""
    asked = rows.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries or AUDIT_QUERIES)], "i int, query string")
    asked = asked.withColumn("words", T.baseline_tokens(F.col("query"))).withColumn("all_words", F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9']+)")))
    names = F.create_map(*[F.lit(x) for pair in L.BASELINE_SYNONYMS.items() for x in pair])
    stops = F.array(*[F.lit(w) for w in L.BASELINE_STOP_WORDS])
    asked = asked.withColumn("dropped", F.filter("all_words", lambda w: F.array_contains(stops, F.coalesce(F.element_at(names, w), w))))
    known = {r.i: r.words for r in asked.select("i", "words").collect()}  # the stated queries
    tests = [F.when(F.forall(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(F.col("blob"), w)), F.lit(i)) for i, ws in known.items() if ws]
    hits = rows.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("i")).groupBy("i").agg(F.count("*").alias("matches"))
    return asked.join(hits, "i", "left").select("query", F.array_join("words", " ").alias("words"), F.array_join("dropped", " ").alias("dropped"), F.coalesce("matches", F.lit(0)).alias("matches"))


def encoding(texts: DataFrame, column: str, top: int = 8) -> DataFrame:
    """(artefact, n, affected): the most frequent codes left in texts, and how many rows have any."""
    found = texts.select(T.artefacts(F.col(column)).alias("a"))
    affected = found.agg(number(F.when(F.size("a") > 0, 1).otherwise(0)).alias("affected"))
    counts = found.select(F.explode("a").alias("artefact")).groupBy("artefact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artefact").limit(top)
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(affected.withColumn("one", F.lit(1))), "one").select("artefact", "n", "affected")


def candidate_cap(rows: DataFrame, words: list[str] | None = None, cap: int = L.BASELINE_CAP) -> DataFrame:
    """(word, matches, capped_year, all_year): upper median year of a word's first matches by number and of all. Years are counted
    first, so a group is as large as there are years."""
    tests = [F.when(F.contains("blob", F.lit(w)), F.lit(w)) for w in words or CAP_WORDS]
    met = rows.select(F.col("card_number").try_cast("long").alias("number"), "year", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("word"))
    placed = met.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("number")))
    by_year = placed.groupBy("word", "year").agg(F.count("*").alias("n"), number(F.when(F.col("r") <= cap, 1).otherwise(0)).alias("c"))
    spread = lambda n: F.flatten(F.collect_list(F.when((F.col("year") > 0) & (F.col(n) > 0), F.array(F.struct("year", F.col(n).alias("n"))))))

    def median(col: str) -> Column:
        s = F.sort_array(F.col(col))
        half = F.floor(F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["n"]) / 2)
        walk = F.aggregate(s, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("year")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["year"], F.when(a["seen"] + x["n"] > half, x["year"])).alias("year")))
        return walk["year"]

    per = by_year.groupBy("word").agg(F.sum("n").alias("matches"), spread("c").alias("cs"), spread("n").alias("ns"))
    return per.select("word", "matches", (F.col("matches") > cap).alias("capped"), median("cs").alias("capped_year"), median("ns").alias("all_year")).where("all_year is not null and capped_year is not null")


def tag_coverage(rows: DataFrame) -> DataFrame:
    has = F.when(T.strip(F.col("card_tags")) != "", 1).otherwise(0)
    return rows.groupBy(F.when(F.col("year") <= 2010, "<=2010").otherwise(">=2011").alias("created")).agg(F.count("*").alias("cards"), number(has).alias("tagged"))


def tag_quality(rows: DataFrame) -> DataFrame:
    tagged = rows.where(T.strip(F.col("card_tags")) != "")
    tags = tagged.select(F.explode(F.split("card_tags", ",")).alias("t")).select(F.lower(T.strip(F.col("t"))).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))
    one = lambda c: number(F.when(c, 1).otherwise(0))
    a = tags.agg(F.count("*").alias("tags"), one(F.col("n") == 1).alias("singletons"), one(F.col("tag").rlike(r"\S\s+\S")).alias("phrases"))
    same = tagged.groupBy(T.strip(F.col("card_tags")).alias("s")).agg(F.count("*").alias("n")).agg(number(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("identical"), number(F.col("n")).alias("tagged"))
    return a.withColumn("one", F.lit(1)).join(same.withColumn("one", F.lit(1)), "one").drop("one")


def status_profile(rows: DataFrame, own: str) -> DataFrame:
    """own: the developer whose share is reported."""
    share = lambda c: F.round(100.0 * F.avg(F.when(c, 1).otherwise(0)), 6)
    years = rows.where("year > 0").groupBy("status_id", "year").agg(F.count("*").alias("n"))
    w = Window.partitionBy("status_id")
    mid = years.withColumn("upto", F.sum("n").over(w.orderBy("year"))).withColumn("total", F.sum("n").over(w)).where("upto > floor(total / 2)").groupBy("status_id").agg(F.min("year").alias("median_year"))
    per = rows.groupBy("status_id").agg(F.count("*").alias("n"), share(T.strip(F.col("card_tags")) != "").alias("tagged"), F.countDistinct("dev_id").alias("developers"), share(F.col("dev_id") == own).alias("own"))
    return per.join(mid, "status_id", "left").select("status_id", "n", "tagged", F.coalesce("median_year", F.lit(0)).alias("median_year"), "developers", "own")


def index_cost(rows: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "card_title", "card_description", F.coalesce("card_tags", F.lit("")), F.replace("q1_value", F.lit("_"), F.lit(" "))))
    per = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("terms"), number(F.col("n")).alias("postings"))
