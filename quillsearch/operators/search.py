"""Ranked search with a relaxation ladder, for a whole table of queries at once.

A query's rungs go from all its terms and facets down to any of its words. Instead of running one rung after the other, the
documents that each asks for are ANDed and ORed from bitmaps, whose counts tell which rung is the last that is needed; a document is placed
by the first of its rungs. Relevance is put into tiers by the best score of all candidates of a rung, as if each rung were run whole: slabs of
documents with the best bounds are scored first, and those whose bound can change neither the tiers nor the results are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..plans.bitmaps import common, documents, slabs, united
from ..plans.index import Index
from ..scratch import written
from .understand import Understood, nearest_occasion, understand


def recency(year: Column, newest: int, boost: float = L.RECENCY_BOOST) -> Column:
    """1 for undated rows, up to 1 + boost for the newest, halving with age."""
    if not newest or boost <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0), F.lit(newest) - year)
    return F.when(year > 0, 1.0 + boost * F.pow(F.lit(0.5), age / L.RECENCY_HALF_LIFE)).otherwise(F.lit(1.0))


def term_weights(index: Index, u: Understood) -> DataFrame:
    """(query_id, term, multiplier): typed terms in full; completions at a discount unless far more frequent; the first group that has a completion decides."""
    typed = u.terms.groupBy("query_id", "term").agg(F.min("pos").alias("pos"))
    df = index.terms.select("term", "df")
    grown = typed.join(u.groups, "term").join(df.withColumnRenamed("df", "exact"), "term", "left").join(df.select(F.col("term").alias("member"), "df"), "member", "left")
    strong = F.coalesce("df", F.lit(0)) > F.greatest(F.coalesce("exact", F.lit(0)), F.lit(1)) * L.PREFIX_DOMINANCE
    multiplier = F.when(F.col("member") == F.col("term"), 1.0).when(strong, 1.0).otherwise(L.PREFIX_DISCOUNT)
    place = F.struct((F.col("member") != F.col("term")).alias("late"), "pos")
    return grown.groupBy("query_id", "member").agg(F.min_by(multiplier, place).alias("multiplier")).withColumnRenamed("member", "term")


def ordered_terms(index: Index, u: Understood) -> DataFrame:
    """(query_id, t, term): terms that no facet has used up, rarest first, as typed among equals."""
    used = u.facets.select("query_id", F.col("source").alias("term")).distinct()
    left = u.terms.join(used, ["query_id", "term"], "left_anti").join(index.terms.select("term", "idf"), "term", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.coalesce("idf", F.lit(0.0)), 9)), "pos")
    return left.select("query_id", "term", (F.row_number().over(order) - 1).alias("t"))


def ordered_facets(index: Index, u: Understood) -> DataFrame:
    """(query_id, k, kind, value, n, boost): by slot, then rarest first, as named among equals; n is 0 for a facet that no card has."""
    slot = F.create_map(*[F.lit(x) for pair in L.SLOT_PRIORITY.items() for x in pair])
    f = u.facets.join(index.facet_stats, ["kind", "value"], "left")
    order = Window.partitionBy("query_id").orderBy(F.element_at(slot, F.col("kind")), F.coalesce("n", F.lit(0)), "place")
    return f.select("query_id", "kind", "value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("boost", F.lit(0.0)).alias("boost"), (F.row_number().over(order) - 1).alias("k"))


def rungs(sizes: DataFrame) -> DataFrame:
    """(query_id, rung, strategy, need_t, need_k) from (query_id, n_t, n_k, n_terms): a query's ladder."""
    t, k = F.col("n_t"), F.col("n_k")
    step = lambda name, nt, nk: F.struct(name.alias("strategy"), nt.cast("int").alias("need_t"), nk.cast("int").alias("need_k"))
    when = lambda cond, arr: F.when(cond, arr).otherwise(F.array().cast("array<struct<strategy:string,need_t:int,need_k:int>>"))
    name = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    drops = F.transform(F.sequence(F.lit(1), t - 1), lambda d: step(name("dropped ", d.cast("string"), " weak term(s)"), t - d, k))

    def fewer(i: Column) -> Column:
        return F.concat(when(t > 0, F.array(step(name(i.cast("string"), " facet(s) + best term"), F.lit(1), i))), F.array(step(name(i.cast("string"), " facet(s) only"), F.lit(0), i)))

    ladder = F.concat(
        when(t > 0, F.array(step(F.lit("all terms"), t, k))),
        when(t > 1, drops),
        when((k > 0) & (t > 0), F.array(step(F.lit("facets + best term"), F.lit(1), k))),
        when(k > 0, F.array(step(F.lit("facets only"), F.lit(0), k))),
        when(k > 1, F.flatten(F.transform(F.sequence(k - 1, F.lit(1), F.lit(-1)), fewer))),
        when(t > 0, F.array(step(F.lit("best term only"), F.lit(1), F.lit(0)))),
        when(F.col("n_terms") > 0, F.array(step(F.lit("any term"), F.lit(0), F.lit(0)))),
    )
    return sizes.select("query_id", F.posexplode(ladder).alias("rung", "s")).select("query_id", "rung", "s.*")


@dataclass
class Rungs:
    """slabs (query_id, rung, slab, n, bits, facets, most): the documents of each rung that is needed, by slab, and a bound of their scores;
    weights (query_id, term, worth): what a unit of a term's weight adds to a document's score."""

    slabs: DataFrame
    weights: DataFrame


def rung_sets(index: Index, u: Understood, ts: DataFrame, ks: DataFrame, ladder: DataFrame, limit: int) -> DataFrame:
    """(query_id, rung, block, bits): the documents that each rung of a query asks for, up to the first rung that has limit of them alone."""
    typed = u.terms.select("query_id", "term").distinct()
    grown = typed.join(u.groups, "term").select("query_id", "term", F.col("member")).join(index.term_sets.withColumnRenamed("term", "member"), "member")
    of_term = united(grown, "query_id", "term")
    of_facet = united(ks.where("n > 0").join(index.facet_sets.drop("n"), ["kind", "value"]), "query_id", "k")
    steps = ladder.withColumn("any", (F.col("need_t") == 0) & ~F.col("active"))
    real = ks.where("n > 0").select("query_id", "k")
    with_k = steps.join(real, "query_id", "left").groupBy("query_id", "rung", "need_t", "need_k", "any").agg(F.count(F.when(F.col("k") < F.col("need_k"), 1)).alias("of_k"))
    needed = with_k.withColumn("needed", F.when(F.col("any"), 1).otherwise(F.col("need_t") + F.col("of_k")))
    keys = ["query_id", "rung", "needed", "block", "bits"]
    terms = needed.join(of_term.join(ts, ["query_id", "term"]), "query_id").where("t < need_t").select(*keys)
    facets = needed.join(of_facet, "query_id").where("k < need_k").select(*keys)
    anything = needed.where("any").join(of_term.groupBy("query_id", "block").agg(F.bitmap_or_agg("bits").alias("bits")), "query_id").select(*keys)
    met = written(common(terms.unionByName(facets).unionByName(anything), "needed", "query_id", "rung"), "rung-sets", plain=True)
    sizes = met.groupBy("query_id", "rung").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    enough = sizes.where(F.col("n") >= limit).groupBy("query_id").agg(F.min("rung").alias("last"))
    return met.join(enough, "query_id", "left").where(F.col("last").isNull() | (F.col("rung") <= F.col("last"))).drop("last")


def bounded(index: Index, u: Understood, found: DataFrame, ladder: DataFrame, boost: float) -> Rungs:
    """The slabs of rung_sets() with the best score that a document in them can have."""
    weights = term_weights(index, u).join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("idf") * F.col("multiplier")).alias("worth"))
    text = weights.join(index.bounds, "term").groupBy("query_id", "slab").agg(F.sum(F.col("worth") * F.col("most")).alias("text"))
    cut = slabs(found, index.slab_bits).join(ladder.select("query_id", "rung", "facets"), ["query_id", "rung"]).join(text, ["query_id", "slab"], "left").join(index.slab_years, "slab")
    most = (F.coalesce("text", F.lit(0.0)) + F.col("facets")) * recency(F.col("newest"), index.newest, boost) * (1 + 1e-9)
    return Rungs(written(cut.select("query_id", "rung", "slab", "n", "bits", "facets", most.alias("most")), "rung-slabs", plain=True), weights)


def scored(index: Index, r: Rungs, chosen: DataFrame, boost: float) -> DataFrame:
    """(query_id, rung, doc, value, first, number, title, year): all documents of the chosen slabs (query_id, slab), and the rung that places each."""
    mine = documents(r.slabs.drop("n", "most").join(chosen, ["query_id", "slab"]), index.slab_bits)
    lists = index.postings.select("term", "doc", "weight", F.shiftright("doc", index.slab_bits).alias("slab"))
    text = chosen.join(r.weights, "query_id").join(lists, ["term", "slab"]).groupBy("query_id", "doc").agg(F.sum(F.col("worth") * F.col("weight")).alias("text"))
    met = mine.join(text, ["query_id", "doc"], "left").join(index.docs.select("doc", "year", "title", "number"), "doc")
    met = met.withColumn("value", (F.coalesce("text", F.lit(0.0)) + F.col("facets")) * recency(F.col("year"), index.newest, boost))
    return met.withColumn("first", F.min("rung").over(Window.partitionBy("query_id", "doc"))).drop("text", "facets")


def promising(r: Rungs, limit: int) -> DataFrame:
    """(query_id, slab): for each rung the limit slabs of the best bounds."""
    best = Window.partitionBy("query_id", "rung").orderBy(F.desc("most"), "slab")
    return r.slabs.withColumn("i", F.row_number().over(best)).where(F.col("i") <= limit).select("query_id", "slab").distinct()


def unsettled(r: Rungs, seen: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """(query_id, slab): slabs that the first pass left out (done: those it took, seen: their documents) and that may still change the results.

    A slab can't if, for each rung that it has documents of, its bound is below the best value seen, so that the tiers stand, and in a tier
    below that of the limit-th document that this rung places.
    """
    tops = seen.groupBy("query_id", "rung").agg(F.max("value").alias("top"))
    placed = Window.partitionBy("query_id", "rung").orderBy(F.desc("value"))
    last = seen.where("rung = first").withColumn("i", F.row_number().over(placed)).where(F.col("i") == limit).select("query_id", "rung", F.col("value").alias("least"))
    ceilings = r.slabs.groupBy("query_id", "rung").agg(F.max("most").alias("ceiling"))
    tier = lambda a, b: F.floor(F.round(10 * F.col(a) / F.col(b), 9))
    out = r.slabs.join(done, ["query_id", "slab"], "left_anti").join(tops, ["query_id", "rung"], "left").join(last, ["query_id", "rung"], "left").join(ceilings, ["query_id", "rung"])
    settled = (F.col("most") < F.col("top")) & (tier("most", "top") < tier("least", "ceiling"))
    return out.where(~F.coalesce(settled, F.lit(False))).select("query_id", "slab").distinct()


def candidates(index: Index, u: Understood, ts: DataFrame, ks: DataFrame, ladder: DataFrame, limit: int, boost: float) -> DataFrame:
    """scored() documents, enough of them that the first limit results of each query and the best value of each rung are among them."""
    r = bounded(index, u, rung_sets(index, u, ts, ks, ladder, limit), ladder, boost)
    chosen = written(promising(r, limit), "first-slabs", plain=True)
    seen = written(scored(index, r, chosen, boost), "seen", plain=True)
    more = unsettled(r, seen, chosen, limit)
    if more.isEmpty():
        return seen
    return written(seen.unionByName(scored(index, r, written(more, "more-slabs", plain=True), boost)), "scored", plain=True)


def by_number(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc, number) of the queries that are a card's number and nothing else."""
    cards = index.docs.where("number <> ''").groupBy("number").agg(F.max("doc").alias("doc"))
    bare = queries.select("query_id", T.strip(F.col("raw")).alias("number")).where(F.col("number").rlike("^[0-9]+$"))
    return bare.join(cards, "number").select("query_id", "doc", "number")


def pages(index: Index, queries: DataFrame, limit: int = L.MAX_RESULTS, **options) -> DataFrame:
    """(query_id, n, strategy, fallback, message): how each query's page comes about, of pages without a row too.

    A limit of 0 (or less, which counts as 0) asks for no rows: the ladder ends before its first rung, a query that shares a word with an occasion
    falls to the nearest one, others to the latest cards; a card's number still finds its card.
    """
    if limit > 0:
        head = F.max(F.struct("strategy", "fallback", "message")).alias("p")
        return search(index, queries, limit, **options).groupBy("query_id").agg(F.count("*").alias("n"), head).select("query_id", "n", "p.*")
    exact = written(by_number(index, queries), "card-numbers")
    numbers = exact.select("query_id", F.lit(1).cast("long").alias("n"), F.lit("card number").alias("strategy"), F.lit(False).alias("fallback"), F.concat(F.lit("Card "), "number", F.lit(".")).alias("message"))
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    u = understand(index, rest)
    read = rest.select("query_id").join(u.terms.select("query_id").distinct().withColumn("worded", F.lit(True)), "query_id", "left").join(nearest_occasion(index, u), "query_id", "left")
    strategy = F.when(F.col("worded").isNull(), "empty").when(F.col("section").isNotNull(), "nearest occasion").otherwise("latest")
    said = F.create_map(*[F.lit(x) for x in ("empty", "Showing the latest cards.", "nearest occasion", "No exact match. Showing the closest occasion.", "latest", "No matching cards. Showing the latest additions.")])
    none = read.select("query_id", F.lit(0).cast("long").alias("n"), strategy.alias("strategy"), F.lit(True).alias("fallback"), F.element_at(said, strategy).alias("message"))
    return numbers.unionByName(none)


def search(index: Index, queries: DataFrame, limit: int = L.MAX_RESULTS, popularity: DataFrame | None = None, boost: float = L.RECENCY_BOOST) -> DataFrame:
    """(query_id, rank, doc, number, title, strategy, fallback, message, why): up to limit rows for each of queries (query_id, raw).

    Every query is answered: a card number with its card, others down the ladder, what nothing matches or holds no word with
    the newest cards (fallback). popularity (number, score) breaks ties in place of the year.
    """
    exact = written(by_number(index, queries), "card-numbers")
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    u = understand(index, rest)
    ts, ks = written(ordered_terms(index, u), "text-terms"), written(ordered_facets(index, u), "ranked-facets")
    sums = ks.select("query_id", (F.col("k") + 1).alias("need_k"), F.sum("boost").over(Window.partitionBy("query_id").orderBy("k")).alias("facets"), F.max(F.col("n") > 0).over(Window.partitionBy("query_id").orderBy("k")).alias("active"))
    n_terms = u.terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    sizes = n_terms.join(ts.groupBy("query_id").agg(F.count("*").alias("n_t")), "query_id", "left").join(ks.groupBy("query_id").agg(F.count("*").alias("n_k")), "query_id", "left").na.fill(0)
    ladder = rungs(sizes).join(sums, ["query_id", "need_k"], "left").select("query_id", "rung", "strategy", "need_t", "need_k", F.coalesce("facets", F.lit(0.0)).alias("facets"), F.coalesce("active", F.lit(False)).alias("active"))
    ladder = written(ladder, "ladder")
    met = candidates(index, u, ts, ks, ladder, limit, boost)
    tops = met.groupBy("query_id", "rung").agg(F.max("value").alias("top"))
    met = met.where("rung = first").join(tops, ["query_id", "rung"]).join(ladder.select("query_id", "rung", "strategy", "need_k"), ["query_id", "rung"])
    met = met.withColumn("tier", F.floor(F.round(10 * F.col("value") / F.col("top"), 9)))
    if popularity is not None:
        met = met.join(popularity.select(F.col("number"), F.col("score").alias("popular")), "number", "left").withColumn("tiebreak", F.coalesce("popular", F.lit(0)).cast("double"))
    else:
        met = met.withColumn("tiebreak", F.col("year").cast("double"))
    place = Window.partitionBy("query_id").orderBy("rung", F.desc("tier"), F.desc("tiebreak"), "title", "doc")
    hits = written(met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit), "hits", plain=True)
    landed = hits.where("rank = 1").select("query_id", F.col("strategy").alias("landed"))
    fixes = u.fixes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "corrected"))).alias("f")).select("query_id", F.array_join(F.transform("f", lambda x: F.concat(x["word"], F.lit(" → "), x["corrected"])), ", ").alias("fixed"))
    message = F.when(F.col("fixed").isNotNull(), F.concat(F.lit("Showing results for "), "fixed")).when(F.col("landed") != "all terms", F.concat(F.lit("Broadened your search ("), "landed", F.lit(")")))
    found = hits.join(landed, "query_id").join(fixes, "query_id", "left").join(explained(index, u, ks, hits), ["query_id", "doc"], "left")
    found = found.select("query_id", "rank", "doc", F.col("landed").alias("strategy"), F.lit(False).alias("fallback"), message.alias("message"), F.coalesce("why", F.lit("")).alias("why"))
    numbers = exact.select("query_id", F.lit(1).alias("rank"), "doc", F.lit("card number").alias("strategy"), F.lit(False).alias("fallback"), F.concat(F.lit("Card "), "number", F.lit(".")).alias("message"), F.concat(F.lit("card number "), "number").alias("why"))
    none = rest.join(landed, "query_id", "left_anti").join(n_terms, "query_id", "left")
    empty = F.col("n_terms").isNull()
    floor = F.broadcast(index.latest(limit))  # limit rows
    newest = none.withColumn("one", F.lit(1)).join(floor.withColumn("one", F.lit(1)), "one")
    newest = newest.select("query_id", "rank", "doc", F.when(empty, "empty").otherwise("latest").alias("strategy"), F.lit(True).alias("fallback"), F.when(empty, "Showing the latest cards.").otherwise("No matching cards. Showing the latest additions.").alias("message"), F.concat(F.lit("newest ("), F.col("year").cast("string"), F.lit(")")).alias("why"))
    out = found.unionByName(numbers).unionByName(newest)
    return out.join(index.docs.select("doc", "number", "title", "year"), "doc").select("query_id", "rank", "doc", "number", "title", "year", "strategy", "fallback", "message", "why")


def explained(index: Index, u: Understood, ks: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc, why): the facets of its rung that a result has, and the first four typed terms that it holds."""
    of_facets = hits.select("query_id", "doc", "need_k").join(ks, "query_id").where("k < need_k").join(index.facets, ["kind", "value", "doc"]).groupBy("query_id", "doc").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("kind", F.lit("="), "value").alias("s")))).alias("fs"))
    of_terms = hits.select("query_id", "doc").join(u.terms, "query_id").join(index.postings.select("term", "doc"), ["term", "doc"]).groupBy("query_id", "doc").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("term").alias("s")))).alias("ts"))
    join = lambda c, sep: F.array_join(F.transform(c, lambda x: x["s"]), sep)
    both = of_facets.join(of_terms, ["query_id", "doc"], "full_outer")
    return both.select("query_id", "doc", F.concat_ws(", ", F.when(F.col("fs").isNotNull(), join("fs", ", ")), F.when(F.col("ts").isNotNull(), F.concat(F.lit("matched "), join(F.slice("ts", 1, 4), "+")))).alias("why"))
