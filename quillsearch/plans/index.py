"""The index of a catalogue: live rows, weighted postings, term statistics, facets and derived lexicons, all DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..scratch import bucketed, written
from ..shipping import shipped
from .bitmaps import pairs_met, sets


def rows_frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def live(cards: DataFrame, excluded_labels: tuple[str, ...] = ("Y",)) -> DataFrame:
    """Rows that are served. A null label is no excluded one."""
    kept = ~F.coalesce(F.col("card_label_type"), F.lit("")).isin(list(excluded_labels)) if excluded_labels else F.lit(True)
    return cards.where((F.col("status_id") == "1") & (F.col("invalid_card") == "0") & kept)


#: Words of a phrase that it is met by, at most; phrases that are sent to each task, at most.
LEAD, PHRASES = 8, 1_000_000
#: Characters of a text by which rows are dealt to ranges: the driver gets a sample of them.
RANGE_CHARS = 64
#: Bits of an id of Spark's that count within a task's rows; those above are the task's number.
ID_BITS = 33


def range_keys() -> list[Column]:
    """What rows are dealt by, in step with the order of numbered() and short whatever the texts: a text's first letters, the next text's only where
    these are all of it."""
    keys, whole = [F.col("card_number").try_cast("long").asc_nulls_last()], F.lit(True)
    for c in ("card_number", "card_title", "card_description"):
        keys.append(F.when(whole, F.coalesce(F.substring(c, 1, RANGE_CHARS), F.lit(""))).asc_nulls_last())
        whole = whole & (F.coalesce(F.length(c), F.lit(0)) <= RANGE_CHARS)
    return keys


def numbered(cards: DataFrame) -> DataFrame:
    """cards with doc: their position by number, then by text of the number and title. A total order stands in for file order,
    which distributed files don't have. The ranges are written in order before anything is counted: dealt again, rows may fall into others. The texts
    are moved and written once; a row's position is where its range starts and its place in it, which each reader adds up."""
    order = [F.col("card_number").try_cast("long").asc_nulls_last(), F.col("card_number"), F.col("card_title"), F.col("card_description")]
    sorted_ = cards.repartitionByRange(*range_keys()).sortWithinPartitions(*order)
    ranged = written(sorted_.withColumn("__at", F.monotonically_increasing_id()), "ranged-cards")
    part, place = F.shiftright("__at", ID_BITS), F.col("__at").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    sizes = ranged.select(part.alias("__p")).groupBy("__p").agg(F.count("*").alias("n"))  # one row for each range
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "range-starts")
    here = ranged.withColumns({"__p": part, "__i": place})
    return here.join(F.broadcast(starts), "__p").withColumn("doc", F.col("__base") + F.col("__i")).drop("__p", "__i", "__at", "__base")


def held(build, plain: bool = True):
    """A property that is written once: several queries read it, and what follows plans from a table."""

    def get(self: Index) -> DataFrame:
        return written(build(self), build.__name__, plain=plain)

    get.__doc__ = build.__doc__
    return cached_property(get)


def packed(build):
    """A held property with a row or an entry for each word of each card: compressed, as it would be a multiple of the texts."""
    return held(build, plain=False)


@dataclass
class Index:
    """slab_bits: scores are bounded for 2^slab_bits documents at a time. block_terms: terms of a block of the sorted dictionary, about. piece_pairs: pairs
    of terms that are counted together in a block of documents, about."""

    cards: DataFrame
    lexicons: L.Lexicons
    slab_bits: int = 10
    block_terms: int = 4096
    piece_pairs: int = 200_000

    def _few(self, rows: list[tuple], schema: str) -> DataFrame:
        return rows_frame(self.cards, rows, schema)

    @held
    def docs(self) -> DataFrame:
        """(doc, number, title, description, url, category, section, year, label, ...) of each card."""
        c = shipped(self.cards)
        keep = [F.col(x) for x in ("card_title", "card_description", "card_tags", "card_music_extn", "card_thumb_extn", "card_bigimage_extn")]
        return c.select("doc", F.col("card_number").alias("number"), T.decode_entities(F.col("card_title")).alias("title"), T.decode_entities(F.col("card_description")).alias("description"), F.col("card_page_url").alias("url"), F.col("q1_value").alias("category"), T.section(F.col("q1_value")).alias("section"), T.year(F.col("card_created_date")).alias("year"), F.col("card_label_type").alias("label"), *keep)

    @cached_property
    def total(self) -> int:
        return self.cards.count()

    @cached_property
    def newest(self) -> int:
        return self.docs.agg(F.max("year")).first()[0] or 0

    @packed
    def card_words(self) -> DataFrame:
        """(doc, section, fields): of each field of a card its distinct words in order, and how often each is there."""
        c = shipped(self.cards)
        fields = {
            "title": T.tokenise(F.col("card_title")),
            "description": T.tokenise(F.col("card_description")),
            "tags": T.tokenise(F.replace(F.coalesce("card_tags", F.lit("")), F.lit(","), F.lit(" "))),
            "category": T.category_tokens(F.col("q1_value")),
            "url": T.url_tokens(F.col("card_page_url")),
        }
        return c.select("doc", T.section(F.col("q1_value")).alias("section"), F.array(*[F.struct(F.lit(name).alias("field"), T.counted(words).alias("words")) for name, words in fields.items()]).alias("fields"))

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc, section, field, term, tf), a row for each distinct word of a field."""
        return self.card_words.select("doc", "section", F.explode("fields").alias("f")).select("doc", "section", "f.field", F.explode("f.words").alias("w")).select("doc", "section", "field", "w.term", "w.tf")

    @packed
    def postings(self) -> DataFrame:
        """(term, doc, weight): field-weighted, saturated counts. The words of a card's fields are put together where the card lies."""
        weight = F.create_map(*[F.lit(x) for pair in L.FIELD_WEIGHTS.items() for x in pair])
        saturated = lambda tf: tf * (L.TF_SATURATION + 1) / (tf + L.TF_SATURATION)
        parts = F.flatten(F.transform("fields", lambda f: F.transform(f["words"], lambda w: F.struct(w["term"].alias("term"), (F.element_at(weight, f["field"]) * saturated(w["tf"])).alias("part")))))
        total = lambda run: F.aggregate(run, F.lit(0.0), lambda s, x: s + x["part"])
        summed = T.by_runs(F.sort_array(parts), lambda x: x["term"], lambda run: F.struct(run[0]["term"].alias("term"), total(run).alias("weight")))
        return self.card_words.select("doc", F.explode(summed).alias("w")).select("w.term", "doc", "w.weight")

    @held
    def terms(self) -> DataFrame:
        """(term, df, idf)."""
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        return df.withColumn("idf", F.log(1 + (F.lit(self.total) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    @packed
    def term_sets(self) -> DataFrame:
        """(term, block, n, bits, few): the documents of each term as bitmaps or short lists."""
        return sets(self.postings.select("term", "doc"), "term")

    @held
    def bounds(self) -> DataFrame:
        """(term, slab, most): the largest weight of a term in each slab."""
        return self.postings.groupBy("term", F.shiftright("doc", self.slab_bits).alias("slab")).agg(F.max("weight").alias("most"))

    @held
    def slab_years(self) -> DataFrame:
        """(slab, newest): the latest year in each slab, 0 if nothing in it is dated."""
        return self.docs.groupBy(F.shiftright("doc", self.slab_bits).alias("slab")).agg(F.max("year").alias("newest"))

    @held
    def facet_sets(self) -> DataFrame:
        """(kind, value, block, n, bits, few)."""
        return sets(self.facets, "kind", "value")

    def pair_sizes(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) of terms with n, how many documents hold both. The terms' sets of a block of documents and the pairs meet in a task, so that no set is
        copied to each of its pairs; many pairs are cut to pieces of about piece_pairs by their first term, and a set goes to the pieces that ask for it."""
        asked = written(shipped(pairs).select("a", "b").distinct(), "pairs")
        pieces = max(1, -(-asked.count() // self.piece_pairs))
        cut = asked.withColumn("piece", F.pmod(F.xxhash64("a"), F.lit(pieces)).cast("int"))
        terms = cut.select(F.explode(F.array("a", "b")).alias("term"), F.col("piece").alias("of")).distinct()
        sets = self.term_sets.join(terms, "term").select("term", "block", "bits", "few", "of")
        blocks = F.broadcast(self.term_sets.select(F.col("block").alias("at")).distinct())
        dealt = cut.crossJoin(blocks)
        both = dealt.groupBy("at", "piece").cogroup(sets.groupBy("block", "of")).applyInPandas(pairs_met, "a string, b string, n long")
        return pairs.join(both.groupBy("a", "b").agg(F.sum("n").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term, df) of the terms that a word may be corrected to."""
        return self.terms.where(F.col("df") >= L.MIN_FREQUENCY).select("term", "df")

    @cached_property
    def longest_term(self) -> int:
        return self.vocabulary.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]

    @cached_property
    def deletions(self) -> DataFrame:
        """(variant, term, df): each term of the vocabulary without up to two of its letters (three of a long term), dealt to buckets by variant once."""
        deep = F.length("term") >= L.LOOSE_MIN_TERM
        variants = F.when(deep, T.deletes(F.col("term"), L.LOOSE_EDITS)).otherwise(T.deletes(F.col("term"), L.EDITS))
        return bucketed(self.vocabulary.where(F.length("term") >= L.MIN_CORRECTABLE).select(F.explode(variants).alias("variant"), "term", "df"), "deletions", "variant")

    @held
    def blobs(self) -> DataFrame:
        """(doc, blob): the text that the baseline engine looks words up in, lower-cased and not normalised."""
        parts = [F.coalesce(c, F.lit("")) for c in (F.col("card_title"), F.col("card_description"), F.col("card_tags"), F.replace("q1_value", F.lit("_"), F.lit(" ")), F.col("card_page_url"))]
        return self.cards.select("doc", F.lower(F.concat_ws(" ", *parts)).alias("blob"))

    @held
    def gram_sets(self) -> DataFrame:
        """(gram, block, n, bits, few): the documents whose blob holds three characters in a row; two line feeds follow a blob, so that
        each of its characters begins one."""
        padded = self.blobs.select("doc", F.concat("blob", F.lit("\n\n")).alias("b"))
        grams = padded.where(F.length("b") > 2).select("doc", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("b") - 2), lambda i: F.substring("b", i, F.lit(3))))).alias("gram"))
        return sets(grams, "gram")

    @held
    def gram_sizes(self) -> DataFrame:
        """(gram, df)."""
        return self.gram_sets.groupBy("gram").agg(F.sum("n").alias("df"))

    @cached_property
    def words(self) -> DataFrame:
        """(kind, value, word, at) of the facet words; as many as the lexicons hold."""
        return F.broadcast(self._few(self.lexicons.entries(), "kind string, value string, word string, at int"))

    @held
    def facets(self) -> DataFrame:
        """(kind, value, doc): tones and recipients from tags and title only, formats from columns, the section as occasion."""
        evidence = self.tokens.where(F.col("field").isin("tags", "title")).select("doc", F.col("term").alias("word")).distinct()
        named = evidence.join(self.words.where(F.col("kind") != "format"), "word").select("kind", "value", "doc").distinct()
        label = F.col("card_label_type")
        of = lambda value, cond: self.cards.where(cond).select(F.lit("format").alias("kind"), F.lit(value).alias("value"), "doc")
        of_columns = of("animated", label == "A").unionByName(of("flash", label == "F")).unionByName(of("musical", T.strip(F.col("card_music_extn")) != ""))
        occasions = self.cards.select(F.lit("occasion").alias("kind"), T.section(F.col("q1_value")).alias("value"), "doc")
        return named.unionByName(of_columns).unionByName(occasions)

    @held
    def facet_stats(self) -> DataFrame:
        """(kind, value, n, boost)."""
        reference = F.log(F.lit(1 + self.total / 100.0))
        return self.facets.groupBy("kind", "value").agg(F.count("*").alias("n")).withColumn("boost", L.FACET_BOOST * F.least(F.log(1 + F.lit(self.total) / F.col("n")) / reference, F.lit(L.FACET_SELECTIVITY_CAP)))

    @cached_property
    def tag_phrases(self) -> DataFrame:
        """(phrase, n): occurrences, so that a phrase a card has twice counts twice."""
        return shipped(self.cards).select(F.explode(F.split(F.coalesce("card_tags", F.lit("")), ",")).alias("t")).select(T.normalise(F.col("t")).alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("n"))

    def phrase_matches(self, phrases: DataFrame) -> DataFrame:
        """(phrase, doc, section) for phrases (phrase): documents whose title and description, read as one text, hold its words one after the other. Texts are cut
        into runs of as many words as the phrases have, each once a document; up to PHRASES phrases are sent to the texts, more meet them by
        a shuffle. A phrase of over LEAD words meets by its first ones and is looked for in the text. A phrase without words has no match."""
        words = shipped(phrases).select("phrase").distinct().select("phrase", T.tokenise(F.col("phrase")).alias("ws")).where(F.size("ws") > 0)
        long = F.size("ws") > LEAD
        asked = written(words.select("phrase", F.least(F.size("ws"), F.lit(LEAD)).alias("n"), F.array_join(F.slice("ws", 1, LEAD), " ").alias("run"), F.when(long, F.array_join("ws", " ")).alias("whole")), "phrases")
        lengths = sorted((r.n, r.rows, r.whole) for r in asked.groupBy("n").agg(F.count("*").alias("rows"), F.count("whole").alias("whole")).collect())  # LEAD rows
        text = T.tokenise(F.concat_ws(" ", "card_title", "card_description"))
        starts = lambda w, n: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        runs = lambda w, n: F.transform(starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))
        every = lambda w: F.array_distinct(F.concat(*[runs(w, n) for n, _, _ in lengths], F.array().cast("array<string>")))
        cut = self.cards.select("doc", T.section(F.col("q1_value")).alias("section"), F.explode(F.flatten(F.transform(F.array(text), every))).alias("run"))
        few = sum(rows for _, rows, _ in lengths) <= PHRASES
        met = cut.join(F.broadcast(asked) if few else asked, "run")
        out = met.where("whole is null").select("phrase", "doc", "section")
        if any(whole for _, _, whole in lengths):
            texts = self.cards.select("doc", F.concat(F.lit(" "), F.array_join(text, " "), F.lit(" ")).alias("text"))
            found = met.where("whole is not null").join(texts, "doc").where(F.contains("text", F.concat(F.lit(" "), "whole", F.lit(" "))))
            out = out.unionByName(found.select("phrase", "doc", "section"))
        return out

    @held
    def hints(self) -> DataFrame:
        """(section, phrase, total, here, best, best_count, status): claims that a phrase belongs to a section, counted on word borders in
        title and description. status: kept, dropped, or rare (too few to judge)."""
        claims = [(s, p) for s, ps in self.lexicons.hints.items() for p in ps]
        named = F.broadcast(self._few(claims, "claimed string, phrase string"))
        counts = self.phrase_matches(named.select("phrase")).groupBy("phrase", "section").agg(F.count("*").alias("n"))
        per = counts.join(named, "phrase").groupBy("claimed", "phrase").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("section") == F.col("claimed"), F.col("n")).otherwise(0)).alias("here"), F.min(F.struct((-F.col("n")).alias("m"), "section")).alias("top"))
        status = F.when(F.col("total") < L.HINT_MIN_TOTAL, "rare").when(F.col("here") / F.col("total") >= L.HINT_MIN_SHARE, "kept").otherwise("dropped")
        return per.select(F.col("claimed").alias("section"), "phrase", "total", "here", F.col("top.section").alias("best"), (-F.col("top.m")).alias("best_count"), status.alias("status"))

    @cached_property
    def occasion_scores(self) -> DataFrame:
        """(section, term, n, lift, score): words distinctive for a section's titles and tags."""
        words = self.tokens.where(F.col("field").isin("tags", "title")).select("doc", "section", "term").distinct()
        counts = words.groupBy("section", "term").agg(F.count("*").alias("n"))
        sizes = counts.groupBy("section").agg(F.sum("n").alias("size"), F.count("*").alias("distinct"))
        overall = counts.groupBy("term").agg(F.sum("n").alias("everywhere"))
        total = sizes.agg(F.coalesce(F.sum("distinct"), F.lit(1)).alias("total"))
        n_total = total.first().total  # sections' distinct words, not occurrences
        lift = (F.col("n") / F.col("size")) / F.greatest(F.col("everywhere") / F.lit(n_total), F.lit(1e-9))
        out = counts.where((F.length("term") >= L.LEXICON_MIN_LEN) & (F.col("n") >= L.LEXICON_MIN_COUNT)).join(sizes, "section").join(overall, "term").withColumn("lift", lift)
        return out.where(F.col("lift") > L.LEXICON_MIN_LIFT).select("section", "term", "n", "lift", F.round(F.col("lift") * F.log(1 + F.col("n")), 9).alias("score"))

    @cached_property
    def occasion_terms(self) -> DataFrame:
        """(section, term): the most distinctive words, the hints that held, and the section's own name if it reads as a word."""
        best = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("term"))
        top = self.occasion_scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= L.LEXICON_TOP).select("section", "term")
        sections = self.cards.select(T.section(F.col("q1_value")).alias("section")).distinct()
        own = sections.where((F.length("section") >= 3) & ~F.startswith("section", F.lit("e"))).select("section", F.col("section").alias("term"))
        held = self.hints.where("status = 'kept'").select("section", F.col("phrase").alias("term"))
        return top.unionByName(own).unionByName(held.join(sections, "section", "left_semi")).distinct()

    @held
    def occasion_of(self) -> DataFrame:
        """(word, section): words that lead to one section only."""
        words = self.occasion_terms.select("section", F.explode(F.split("term", " ")).alias("word")).where(F.length("word") >= 4)
        words = words.join(self.words.select("word").distinct(), "word", "left_anti")
        return words.groupBy("word").agg(F.countDistinct("section").alias("n"), F.min("section").alias("section")).where("n = 1").select("word", "section")

    @held
    def variants(self) -> DataFrame:
        """(word, target, status): spellings claimed to name the same; kept where both live in the same sections."""
        pairs = self._few(list(self.lexicons.variants.items()), "word string, target string")
        wanted = F.broadcast(pairs.select(F.explode(F.array("word", "target")).alias("term")).distinct())
        per = self.postings.join(wanted, "term").join(self.cards.select("doc", T.section(F.col("q1_value")).alias("section")), "doc").groupBy("term", "section").agg(F.count("*").alias("n"))
        shape = per.groupBy("term").agg(F.sum("n").alias("df"), F.min(F.struct((-F.col("n")).alias("m"), "section"))["section"].alias("main"), F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("in"))  # as long as there are sections
        a, b = shape.select(*[F.col(c).alias(f"a_{c}") for c in shape.columns]), shape.select(*[F.col(c).alias(f"b_{c}") for c in shape.columns])
        both = pairs.join(a, pairs.word == a.a_term, "left").join(b, pairs.target == b.b_term, "left")
        shared = F.aggregate(F.map_entries("a_in"), F.lit(0).cast("long"), lambda s, e: s + F.when(F.map_contains_key(F.col("b_in"), e["key"]), e["value"]).otherwise(0))
        status = F.when(F.col("a_df").isNull() | F.col("b_df").isNull(), "one spelling is not in the catalogue").when(F.col("b_df") <= F.col("a_df"), "target is the rarer spelling").when(F.col("a_main") != F.col("b_main"), "different dominant section").when(shared / F.col("a_df") < L.VARIANT_MIN_SHARE, "sections mostly disagree").otherwise("kept")
        return both.select("word", "target", status.alias("status"))

    @cached_property
    def newest_cards(self) -> DataFrame:
        """(place, doc): newest first, then the largest number, then doc."""
        order = [F.desc("year"), F.col("number").try_cast("long").desc_nulls_last(), F.asc("doc")]
        return self.docs.orderBy(*order)

    def latest(self, limit: int) -> DataFrame:
        """(rank, doc) of the limit newest cards."""
        top = self.newest_cards.limit(limit).select("doc", "year", "number")
        order = Window.orderBy(F.desc("year"), F.col("number").try_cast("long").desc_nulls_last(), F.asc("doc"))
        return top.select("doc", "year", F.row_number().over(order).alias("rank"))

    @held
    def term_blocks(self) -> DataFrame:
        """(block, k, term, df): the dictionary in order, dealt by ranges to blocks; k is a term's first letters, as many as a prefix has at least."""
        n = max(1, -(-self.terms.count() // self.block_terms))
        ranged = self.terms.select("term", "df").repartitionByRange(n, "term").sortWithinPartitions("term")
        return ranged.select(F.spark_partition_id().alias("block"), F.substring("term", 1, L.PREFIX_MIN).alias("k"), "term", "df")

    @held
    def term_fences(self) -> DataFrame:
        """(k, block, lo, hi): the first and the last term of each block, by their first letters."""
        return self.term_blocks.groupBy("k", "block").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))

    def prefix_terms(self, words: DataFrame) -> DataFrame:
        """(word, term, df, r) for (word): of the first 400 terms in order that begin with it, the 24 most frequent. A word's fences give the blocks where its
        terms may lie, so letters that many terms begin with are as many blocks as they take."""
        long = words.where(F.length("word") >= L.PREFIX_MIN).distinct().withColumn("k", F.substring("word", 1, L.PREFIX_MIN))
        reached = long.join(self.term_fences, "k").where((F.col("hi") >= F.col("word")) & ((F.col("lo") <= F.col("word")) | F.startswith("lo", F.col("word"))))
        hits = reached.select("word", "block").join(self.term_blocks, "block").where(F.startswith("term", F.col("word")))
        first = hits.withColumn("i", F.row_number().over(Window.partitionBy("word").orderBy("term"))).where(F.col("i") <= L.PREFIX_WINDOW)
        return first.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("df"), "term"))).where(F.col("r") <= L.PREFIX_LIMIT).select("word", "term", "df", "r")


def build_index(catalogue: DataFrame, lexicons: L.Lexicons | None = None, live_only: bool = True) -> Index:
    cards = live(catalogue) if live_only else catalogue
    return Index(numbered(cards), lexicons or L.Lexicons())
