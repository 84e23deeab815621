"""One query for each operator of the search engine over the tables at hand, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicons as L
from .functions import text as T
from .operators import baseline, reports, spell, suggest
from .operators.search import pages, recency, search
from .operators.understand import bases, understand
from .operators.understand import nearest_occasion as nearest
from .plans.catalogues import CATALOG_DOCS, CATALOG_PARTS, broad_log, docs_catalogue, parts_catalogue, parts_log
from .plans.index import Index, build_index, live
from .shipping import shipped
from .search_sql import occasion_words, searched, understood
from .sources.catalogue import card_fields, filled, payload

_built: dict[tuple, object] = {}

#: Queries of the batch searches over the parts catalogue: plain, misspelt, written together, partial, a number, nothing, nonsense.
SEARCHES = ["small red widget", "wigdet", "widgetring", "hot plates", "smal gear", "widg musical", "promo blue gear", "17", "", "zzzzqqq", "flash cold rod", "gizom", "old anvil hot", "red red bolt", "animated blue ring", "wee red rod", "small red hot old blue gear bolt rod ring widget anvil plate", "gea", "warm plates promo widget"]
PREFIXES = ["the", "res", "ent", "inter", "tion", "que"]
MISSPELT = ["wigdet", "gizom", "plaet", "smal", "anvill", "widget", "xyz", "zzzzzzzz", "larg", "standrad"]
TYPED = ["sm", "small g", "red", "bo", "w", "gear", "hot pl"]


def once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]) -> object:
    """One build for each application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def docs_index(spark: SparkSession, d: str) -> Index:
    return once(spark, d, "docs", lambda: build_index(docs_catalogue(spark, d)))


def parts_index(spark: SparkSession, d: str) -> Index:
    return once(spark, d, "parts", lambda: build_index(parts_catalogue(spark, d), L.PART_LEXICONS))


def _words(spark: SparkSession, words: list[str], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"q{i:02d}", q) for i, q in enumerate(SEARCHES)], "query_id string, raw string")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "replay", lambda: baseline.replay(parts_index(spark, d), parts_log(spark, d)))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_rows(docs_catalogue(spark, d))


def live_filter(s, d):
    return live(docs_catalogue(s, d)).select("card_number", "card_label_type", T.year(F.col("card_created_date")).alias("year"), T.section(F.col("q1_value")).alias("section"))


def newest_cards(s, d):
    return docs_index(s, d).latest(20).join(docs_index(s, d).docs.select("doc", "number"), "doc").select(F.col("rank").cast("long"), "number", F.col("year").cast("long").alias("year"))


def number_lookup(s, d):
    found = search(parts_index(s, d), s.createDataFrame([("a", "17"), ("b", " 402 "), ("c", "100000000")], "query_id string, raw string"), limit=1)
    return found.where("strategy = 'card number'").select("query_id", "number", "title")


def tokenise_docs(s, d):
    fields = docs_index(s, d).card_words.select("doc", F.explode("fields").alias("f")).where(F.size("f.words") > 0)
    n = F.aggregate("f.words", F.lit(0).cast("long"), lambda n, w: n + w["tf"])
    return fields.select("doc", "f.field", n.alias("n"), F.size("f.words").cast("long").alias("terms"))


def postings(s, d):
    return docs_index(s, d).postings.select("term", "doc", F.round("weight", 9).alias("weight"))


def term_pair_and(s, d):
    ix = docs_index(s, d)
    words = shipped(ix.cards).select(T.tokenise(F.col("card_title")).alias("w"))
    pairs = words.where(F.size("w") > 1).select(F.element_at("w", 1).alias("a"), F.element_at("w", 2).alias("b")).distinct()
    return ix.pair_sizes(pairs)


def term_idf(s, d):
    return docs_index(s, d).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def facet_members(s, d):
    return parts_index(s, d).facets


def facet_boost(s, d):
    return parts_index(s, d).facet_stats.select("kind", "value", "n", F.round("boost", 9).alias("boost"))


def tag_phrases(s, d):
    return docs_index(s, d).tag_phrases


def occasion_lexicon(s, d):
    return docs_index(s, d).occasion_scores.select("section", "term", "n", F.round("lift", 9).alias("lift"), F.round("score", 6).alias("score"))


def occasion_of(s, d):
    return docs_index(s, d).occasion_of


def hint_validation(s, d):
    return parts_index(s, d).hints


def _title_phrases(ix):
    words = shipped(ix.cards).select(T.tokenise(F.col("card_title")).alias("w"))
    return words.select(F.explode(F.array(F.slice("w", 1, 2), F.slice("w", 3, 3))).alias("p")).where(F.size("p") > 1).select(F.array_join("p", " ").alias("phrase")).distinct()


def phrase_matches(s, d):
    """How many documents of each section hold the first two words of any title, or the three after them, in a row."""
    ix = docs_index(s, d)
    return ix.phrase_matches(_title_phrases(ix)).groupBy("phrase", "section").agg(F.count("*").alias("n"))


def variant_validation(s, d):
    return parts_index(s, d).variants


def recency_factor(s, d):
    ix = docs_index(s, d)
    return ix.docs.select("number", F.round(recency(F.col("year"), ix.newest), 9).alias("factor"))


def prefix_terms(s, d):
    return docs_index(s, d).prefix_terms(_words(s, PREFIXES)).select("word", "term", "df", F.col("r").cast("long").alias("r"))


def symspell_deletes(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return part.select("word", F.explode(T.deletes(F.col("word"), 2)).alias("variant"))


def word_variants(s, d):
    return bases(docs_index(s, d).terms.select(F.col("term").alias("word"))).select("word", F.col("i").cast("long").alias("i"), "base")


def spell_correct(s, d):
    return spell.corrections(parts_index(s, d), _words(s, MISSPELT)).select("word", "corrected", F.col("distance").cast("long").alias("distance"))


def compound_split(s, d):
    return spell.compounds(parts_index(s, d), _words(s, ["widgetring", "smallgear", "redbolt", "anvilanvil", "sofa", "gizmorodx"]))


def understand_terms(s, d):
    return understand(parts_index(s, d), _batch(s)).terms.select("query_id", F.col("pos").cast("long").alias("pos"), "term")


def understand_facets(s, d):
    f = understand(parts_index(s, d), _batch(s)).facets
    return f.select("query_id", "kind", "value", "source", F.col("place.pos").cast("long").alias("pos"))


def understand_groups(s, d):
    return understand(parts_index(s, d), _batch(s)).groups


def nearest_occasion(s, d):
    return nearest(parts_index(s, d), understand(parts_index(s, d), _batch(s)))


def mean_year(s, d):
    return reports.mean_year(search(parts_index(s, d), _batch(s), limit=10))


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def ladder_search(s, d):
    return _longs(search(parts_index(s, d), _batch(s), limit=10).drop("doc"), "rank", "year")


def ladder_strategy(s, d):
    return search(parts_index(s, d), _batch(s), limit=1).select("query_id", "strategy", "fallback", "message")


def popularity_ranked(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("number"), F.col("p_retailprice").alias("score"))
    return search(parts_index(s, d), _batch(s), limit=5, popularity=part, boost=0.0).select("query_id", F.col("rank").cast("long").alias("rank"), "number", "strategy")


def suggest_build(s, d):
    log = parts_log(s, d).select("query", "times")
    return once(s, d, "suggest", lambda: suggest.build(parts_index(s, d), log))


def _completed(s, d, typed):
    table = once(s, d, "completions", lambda: suggest.completions(suggest_build(s, d), window=None))
    return suggest.suggest(table, typed).select("typed_id", F.col("rank").cast("long").alias("rank"), "phrase")


def suggest_lookup(s, d):
    return _completed(s, d, s.createDataFrame([(str(i), t) for i, t in enumerate(TYPED)], "typed_id string, typed string"))


def suggest_prefixes(s, d):
    """All prefixes of all part names and of their words the other way round, typed at once."""
    names = s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    typed = suggest.prefixes_of(names.unionByName(names.select(turned.alias("name"))), "name", 1, "typed").select(F.col("typed").alias("typed_id"), "typed").distinct()
    return _completed(s, d, typed)


def baseline_search(s, d):
    ix = parts_index(s, d)
    return baseline.old_search(ix, _batch(s), 10).join(ix.docs.select("doc", "number"), "doc").select("query_id", F.col("rank").cast("long").alias("rank"), "number", F.col("n").cast("long").alias("n"))


def compare_old_new(s, d):
    return _longs(baseline.compare(parts_index(s, d), _batch(s)), "old_n", "new_n")


def compare_log(s, d):
    """Both engines on each query of a whole log."""
    return _longs(baseline.compare(parts_index(s, d), parts_log(s, d).select("query_id", F.col("query").alias("raw"))), "old_n", "new_n")


def json_payload(s, d):
    rows = docs_index(s, d).docs.withColumns({"why": F.lit(""), "facets": F.lit(None).cast("map<string,array<string>>")})
    return rows.select(*[c for c in card_fields()]).select("number", "occasion", "subcat", "page", "thumb_extn", "big_extn", F.col("year").cast("long").alias("year"))


def json_results(s, d):
    ix = parts_index(s, d)
    rows = payload(ix, search(ix, _batch(s), limit=3))
    of = lambda name: F.get_json_object("json", f"$.{name}").alias(name)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), *map(of, ["number", "title", "q1", "occasion", "subcat", "page", "thumb_extn", "big_extn", "year", "why", "facets"]))


def eval_zero_rate(s, d):
    return reports.zero_rate(_replayed(s, d))


def eval_regressions(s, d):
    return reports.regressions(_replayed(s, d))


def eval_still_zero(s, d):
    return reports.still_zero(_replayed(s, d))


def eval_fixed(s, d):
    return _longs(reports.rescued(_replayed(s, d)), "new_n")


def eval_overmatch(s, d):
    return reports.over_matching(_replayed(s, d), parts_index(s, d).total)


def _unpaged(s, d):
    return once(s, d, "unpaged", lambda: baseline.replay(parts_index(s, d), broad_log(s, d), limit=0))


def eval_unpaged(s, d):
    """A log played for no rows: what each page would be."""
    return _longs(_unpaged(s, d).select("query_id", "times", "old_n", "new_n", "strategy"), "old_n", "new_n", "times")


def eval_regressions_unpaged(s, d):
    return reports.regressions(_unpaged(s, d))


def eval_still_zero_unpaged(s, d):
    return reports.still_zero(_unpaged(s, d))


def eval_overmatch_broad(s, d):
    return reports.over_matching(_unpaged(s, d), parts_index(s, d).total)


def pages_of_none(s, d):
    """What the batch's pages say with a limit of 0."""
    return pages(parts_index(s, d), _batch(s), 0)


def suggest_filter(s, d):
    """Which of the part names, and of what is made of them as a log may hold it, may be offered."""
    name = F.col("p_name")
    forms = F.array(name, F.concat(name, F.lit(" <script>x")), F.concat(F.lit("Alert: "), name), F.concat(name, F.lit("/etc/passwd")), F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_size").cast("string")), F.substring(name, 1, 2), F.repeat(F.concat(name, F.lit(" ")), 5), F.concat(name, F.lit("'s size "), F.col("p_size").cast("string")))
    return suggest.offered(s.read.parquet(f"{d}/part.parquet").select(F.explode(forms).alias("query")))


def url_templates(s, d):
    """Addresses of pictures and pages of each card, from templates."""
    fields = {c: F.col(c) for c in ("number", "q1", "page", "thumb_extn")}
    cards = docs_index(s, d).docs.withColumns({"why": F.lit(""), "facets": F.lit(None).cast("map<string,array<string>>")}).select(*card_fields())
    return cards.select("number", filled("https://images.example/{q1}/{number}_small.{thumb_extn}", fields).alias("image"), filled("/cards/{page}?n={number}&x={unknown}", fields).alias("link"))


def eval_strategy_mix(s, d):
    return reports.strategy_mix(_replayed(s, d))


def eval_corrections(s, d):
    return reports.correction_rate(_replayed(s, d))


def audit_stopwords(s, d):
    return reports.stop_word_damage(_audit(s, d))


def audit_precision(s, d):
    return reports.tone_precision(_audit(s, d), "the", r"\bthe(-|\s|re)", ["the", "and"])


def audit_leaks(s, d):
    return reports.leak_sections(_audit(s, d), r"\bthe(-|\s|re)", ["the", "and"])


def audit_misspell(s, d):
    return reports.misspellings(_audit(s, d), [("teh", "the"), ("adn", "and"), ("thta", "that"), ("qeu", "que")])


def audit_strict_and(s, d):
    return reports.strict_and(_audit(s, d), ["the card", "and that", "mom of the", "que la e-card", "happy card", "idiot"])


def audit_encoding(s, d):
    return reports.encoding(s.read.parquet(f"{d}/pages.parquet"), "html")


def audit_cap(s, d):
    r = reports.candidate_cap(_audit(s, d), ["the", "que", "der", "tion", "zzzz"], 100)
    return r.select("word", F.col("matches").cast("long").alias("matches"), "capped", F.col("capped_year").cast("long").alias("capped_year"), F.col("all_year").cast("long").alias("all_year"))


def audit_tags(s, d):
    return reports.tag_coverage(_audit(s, d))


def audit_tag_quality(s, d):
    return reports.tag_quality(_audit(s, d))


def audit_status(s, d):
    r = reports.status_profile(reports.audit_rows(docs_catalogue(s, d), live_only=False), "src1")
    return r.withColumn("median_year", F.col("median_year").cast("long"))


def audit_index_cost(s, d):
    return reports.index_cost(_audit(s, d))


_NAMES = """live_filter newest_cards number_lookup tokenise_docs postings term_pair_and term_idf facet_members facet_boost tag_phrases occasion_lexicon
occasion_of hint_validation phrase_matches variant_validation recency_factor prefix_terms symspell_deletes word_variants spell_correct compound_split
understand_terms understand_facets understand_groups nearest_occasion mean_year ladder_search ladder_strategy popularity_ranked suggest_build suggest_lookup suggest_prefixes baseline_search compare_old_new compare_log
json_payload json_results eval_zero_rate eval_regressions eval_still_zero eval_fixed eval_overmatch eval_strategy_mix eval_unpaged eval_regressions_unpaged eval_still_zero_unpaged eval_overmatch_broad pages_of_none suggest_filter url_templates
eval_corrections audit_stopwords audit_precision audit_leaks audit_misspell audit_strict_and audit_encoding audit_cap audit_tags
audit_tag_quality audit_status audit_index_cost""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}

# ---- SQL that says the same, for another engine -------------------------------------------------------------------------

_DOCS = f"cd as ({CATALOG_DOCS.format(documents='documents', labels='labels')}), ld as (select row_number() over (order by cast(card_number as bigint)) - 1 as doc, * from cd where status_id = '1' and invalid_card = '0' and card_label_type <> 'Y'), au as (select *, lower(concat_ws(' ', card_title, card_description, card_tags, replace(replace(q1_value, '_', ' '), '.html', ''), replace(replace(card_page_url, '_', ' '), '.html', ''), dev_id)) as blob, cast(substring(card_created_date, 1, 4) as bigint) as year from cd where status_id = '1' and invalid_card = '0')"
_PARTS = f"cp as ({CATALOG_PARTS.format(part='part')}), lp as (select row_number() over (order by cast(card_number as bigint)) - 1 as doc, split_part(q1_value, '_', 1) as section, * from cp where card_label_type <> 'Y')"


def _fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(table: str) -> str:
    one = lambda field, text: f"select doc, split_part(q1_value, '_', 1) as section, '{field}' as field, unnest(string_split({_fold(text)}, ' ')) as term from {table}"
    url = one("url", "replace(replace(replace(card_page_url, '.html', ''), '_', ' '), '-', ' ')")
    plain = " union all ".join([one("title", "card_title"), one("description", "card_description"), one("tags", "replace(card_tags, ',', ' ')"), one("category", "replace(q1_value, '_', ' ')")])
    return f"tk as (select * from ({plain}) where term <> '' union all select doc, section, field, coalesce(nullif(regexp_replace(term, '[0-9]+$', ''), ''), term) from ({url}) where term <> '')"


_WEIGHTS = "case field " + " ".join(f"when '{f}' then {w}" for f, w in L.FIELD_WEIGHTS.items()) + " end"
_POST = f"tf as (select doc, term, field, count(*) as tf from tk group by all), po as (select term, doc, sum({_WEIGHTS} * tf * 2.2 / (tf + 1.2)) as weight from tf group by all), te as (select term, count(*) as df from po group by all)"
_WITH_D = f"with {_DOCS}, {_tokens('ld')}, {_POST}"
_WITH_P = f"with {_PARTS}, {_tokens('lp')}, {_POST}"
_FACETS = """fw(kind, value, word) as (values ('tone', 'warm', 'hot'), ('tone', 'cool', 'cold'), ('recipient', 'red', 'red'), ('recipient', 'blue', 'blue')),
fa as (select distinct kind, value, doc from tk join fw on term = word where field in ('tags', 'title')
 union all select 'format', case card_label_type when 'A' then 'animated' else 'flash' end, doc from lp where card_label_type in ('A', 'F')
 union all select 'format', 'musical', doc from lp where trim(card_music_extn) <> '' union all select 'occasion', section, doc from lp)"""
_SCORES = """w as (select distinct doc, section, term from tk where field in ('tags', 'title')), c as (select section, term, count(*) as n from w group by all),
z as (select section, sum(n) as size, count(*) as distinct_words from c group by all), g as (select term, sum(n) as everywhere from c group by all),
sc as (select section, term, n, (n / size) / greatest(everywhere / (select sum(distinct_words) from z), 1e-9) as lift from c join z using (section) join g using (term) where length(term) >= 4 and n >= 3)"""
_STOPS = "[" + ", ".join(f"'{w}'" for w in L.BASELINE_STOP_WORDS) + "]"
_FACET_WORDS = "[" + ", ".join(f"'{e[2]}'" for e in L.Lexicons().entries()) + "]"
_QUERIES_SQL = "qs(query_id, raw) as (values " + ", ".join(f"('q{i:02d}', '{q}')" for i, q in enumerate(SEARCHES)) + ")"
_SUFFIX_CASE = "case " + " ".join(f"when length(term) > {len(s) + 2} and term like '%{s}' then {len(s)}" for s in L.SUFFIXES) + " end"
_TAGS = "lower(card_tags)"
_LOG = "ln as (select p_name as name, count(*) as times, case when min(p_partkey) % 4 = 0 then 0 else count(*) end as results from part group by p_name), lg as (select name as query_id, times, results from ln union all select substring(name, 2, 1) || substring(name, 1, 1) || substring(name, 3), times, 0 from ln union all select reverse(name), 1, 0 from ln)"

ORACLES = {
    "live_filter": f"with {_DOCS} select card_number, card_label_type, cast(substring(card_created_date, 1, 4) as int) as year, split_part(q1_value, '_', 1) as section from ld",
    "newest_cards": f"with {_DOCS}, n as (select card_number as number, cast(substring(card_created_date, 1, 4) as bigint) as year, row_number() over (order by substring(card_created_date, 1, 4) desc, cast(card_number as bigint) desc) as rank from ld) select rank, number, year from n where rank <= 20",
    "number_lookup": f"with {_PARTS}, q(query_id, number) as (values ('a', '17'), ('b', '402'), ('c', '100000000')) select query_id, number, card_title as title from q join lp on card_number = number",
    "tokenise_docs": f"with {_DOCS}, {_tokens('ld')} select doc, field, count(*) as n, count(distinct term) as terms from tk group by all",
    "postings": f"{_WITH_D} select term, doc, round(weight, 9) as weight from po",
    "term_pair_and": f"{_WITH_D}, pw as (select list_filter(string_split({_fold('card_title')}, ' '), lambda x: x <> '') as w from ld), pa as (select distinct w[1] as a, w[2] as b from pw where len(w) > 1), n as (select a, b, count(*) as n from pa join po x on x.term = a join po y on y.term = b and y.doc = x.doc group by all) select a, b, coalesce(n, 0) as n from pa left join n using (a, b)",
    "term_idf": f"{_WITH_D} select term, df, round(ln(1 + ((select count(*) from ld) - df + 0.5) / (df + 0.5)), 9) as idf from te",
    "facet_members": f"with {_PARTS}, {_tokens('lp')}, {_FACETS} select kind, value, doc from fa",
    "facet_boost": f"with {_PARTS}, {_tokens('lp')}, {_FACETS}, n as (select kind, value, count(*) as n from fa group by all), t as (select count(*) as t from lp) select kind, value, n, round(12 * least(ln(1 + t / n) / ln(1 + t / 100.0), 1.6), 9) as boost from n, t",
    "tag_phrases": f"with {_DOCS}, p as (select {_fold('unnest(string_split(card_tags, chr(44)))')} as phrase from ld) select phrase, count(*) as n from p where phrase <> '' group by all",
    "occasion_lexicon": f"with {_DOCS}, {_tokens('ld')}, {_SCORES} select section, term, n, round(lift, 9) as lift, round(lift * ln(1 + n), 6) as score from sc where lift > 1.5",
    "occasion_of": f"with {_DOCS}, {_tokens('ld')}, {_SCORES}, r as (select section, term, row_number() over (partition by section order by round(lift * ln(1 + n), 9) desc, term desc) as r from sc where lift > 1.5), k as (select section, term from r where r <= 12 union select section, section from z where length(section) >= 3 and not starts_with(section, 'e')), o as (select term as word, count(distinct section) as n, min(section) as section from k where length(term) >= 4 and not list_contains({_FACET_WORDS}, term) group by term) select word, section from o where n = 1",
    "variant_validation": f"{_WITH_P}, v(word, target) as (values ('hot', 'cold'), ('plate', 'gear')), s as (select term, section, count(*) as n from po join lp using (doc) group by all), d as (select term, sum(n) as df, arg_min(section, struct_pack(m := -n, s := section)) as main from s group by all), h as (select word, target, sum(a.n) as shared from v join s a on a.term = word join s b on b.term = target and b.section = a.section group by all) select word, target, case when x.df is null or y.df is null then 'one spelling is not in the catalogue' when y.df <= x.df then 'target is the rarer spelling' when x.main <> y.main then 'different dominant section' when coalesce(shared, 0) / x.df < 0.9 then 'sections mostly disagree' else 'kept' end as status from v left join d x on x.term = word left join d y on y.term = target left join h using (word, target)",
    "spell_correct": f"{_WITH_P}, q(word) as (values {', '.join(f'({chr(39)}{w}{chr(39)})' for w in MISSPELT)}), v as (select term, df from te where df >= 3), c as (select word, term, df, damerau_levenshtein(word, term) as distance, case when length(word) >= 7 then 3 else 2 end as cap from q join v on length(term) >= 4 and length(word) >= 4), b as (select *, row_number() over (partition by word order by distance, df desc, term) as r from c where distance <= cap and (distance <= 2 or distance <= 0.3 * greatest(length(word), length(term)))) select q.word, coalesce(k.term, b.term, q.word) as corrected, cast(case when k.term is not null then 0 else coalesce(b.distance, -1) end as bigint) as distance from q left join v k on k.term = q.word left join b on b.word = q.word and b.r = 1",
    "recency_factor": f"with {_DOCS}, y as (select card_number as number, cast(substring(card_created_date, 1, 4) as int) as year from ld) select number, round(1 + 0.15 * power(0.5, ((select max(year) from y) - year) / 5.0), 9) as factor from y",
    "prefix_terms": f"{_WITH_D}, q(word) as (values {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PREFIXES)}), a as (select word, term, df, row_number() over (partition by word order by term) as i from q join te on starts_with(term, word)), b as (select word, term, df, row_number() over (partition by word order by df desc, term) as r from a where i <= 400) select word, term, df, r from b where r <= 24",
    "symspell_deletes": "with recursive w as (select distinct unnest(string_split(p_name, ' ')) as word from part), d as (select word, word as variant, 0 as k from w union select word, substring(variant, 1, i - 1) || substring(variant, i + 1) as variant, k + 1 from d, (select unnest(range(1, 40)) as i) where i <= length(variant) and k < 2) select distinct word, variant from d where variant <> ''",
    "word_variants": f"{_WITH_D}, s as (select term, {_SUFFIX_CASE} as cut from te), b as (select term as word, left(term, length(term) - cut) as stem from s where cut is not null), v as (select word, 0 as i, stem as base from b union all select word, 1, stem || 'e' from b union all select word, 2, left(stem, length(stem) - 1) from b where length(stem) > 2 and right(stem, 1) = substring(stem, length(stem) - 1, 1)) select word, cast(i as bigint) as i, base from v",
    "compound_split": f"{_WITH_P}, q(word) as (values ('widgetring'), ('smallgear'), ('redbolt'), ('anvilanvil'), ('sofa'), ('gizmorodx')), c as (select word, i, substring(word, 1, i) as l, substring(word, i + 1) as r from q, (select unnest(range(3, 30)) as i) where i <= length(word) - 3), b as (select word, l, r, row_number() over (partition by word order by least(a.df, z.df) desc, i) as k from c join te a on a.term = l join te z on z.term = r where a.df >= 3 and z.df >= 3) select word, l as \"left\", r as \"right\" from b where k = 1",
    "hint_validation": f"with {_PARTS}, h(claimed, phrase) as (values ('promo', 'small gear'), ('standard', 'hot')), b as (select section, ' ' || {_fold('card_title || chr(32) || card_description')} || ' ' as t from lp), n as (select claimed, phrase, section, count(*) as n from h join b on contains(t, ' ' || phrase || ' ') group by all), k as (select claimed, phrase, sum(n) as total, sum(case when section = claimed then n else 0 end) as here, max(n) as best_count from n group by all), f as (select claimed, phrase, min(section) as best from n join k using (claimed, phrase) where n = best_count group by all) select claimed as section, phrase, cast(total as bigint) as total, cast(here as bigint) as here, best, best_count, case when total < 3 then 'rare' when here / total >= 0.5 then 'kept' else 'dropped' end as status from k join f using (claimed, phrase)",
    "phrase_matches": f"with {_DOCS}, w as (select list_filter(string_split({_fold('card_title')}, ' '), lambda x: x <> '') as w from ld), ph as (select distinct array_to_string(p, ' ') as phrase from (select unnest([w[1:2], w[3:5]]) as p from w) where len(p) > 1), b as (select doc, split_part(q1_value, '_', 1) as section, ' ' || {_fold("card_title || ' ' || card_description")} || ' ' as t from ld) select phrase, section, count(*) as n from ph join b on contains(t, ' ' || phrase || ' ') group by all",
    "suggest_build": f"with {_PARTS}, {_LOG}, t as (select unnest(string_split(card_tags, ',')) as phrase from lp), a as (select name as phrase, times * 1.0 as w from ln union all select phrase, count(*) * 0.05 from t group by all) select phrase, round(cast(sum(w) as double), 9) as weight from a group by all",
    "baseline_search": f"with {_PARTS}, {_QUERIES_SQL}, tw as (select query_id, list_filter(regexp_extract_all(lower(raw), '[a-z0-9'']+'), lambda x: not list_contains({_STOPS}, x)) as ws from qs), bl as (select doc, card_number as number, lower(concat_ws(' ', card_title, card_description, card_tags, replace(q1_value, '_', ' '), card_page_url)) as blob from lp), m as (select query_id, number, row_number() over (partition by query_id order by doc) as rank from tw, bl where len(ws) > 0 and len(list_filter(ws, lambda x: not contains(blob, x))) = 0), k as (select *, least(count(*) over (partition by query_id), 500) as n from m) select query_id, rank, number, n from k where rank <= 10",
    "json_payload": f"with {_DOCS} select card_number as number, split_part(q1_value, '_', 1) as occasion, split_part(q1_value, '_', 2) as subcat, replace(card_page_url, '.html', '') as page, 'gif' as thumb_extn, 'png' as big_extn, cast(substring(card_created_date, 1, 4) as bigint) as year from ld",
    "audit_stopwords": f"with {_DOCS}, k as (select len(list_filter(regexp_extract_all(lower(card_title), '[a-z0-9'']+'), lambda x: not list_contains({_STOPS}, x))) as n from au) select count(*) as cards, count(*) filter (n = 0) as none_left, count(*) filter (n = 1) as one_left from k",
    "audit_precision": f"with {_DOCS}, k as (select contains(blob, 'the') as m, contains({_TAGS}, 'the') or contains({_TAGS}, 'and') as g, regexp_matches(blob, '\\bthe(-|\\s|re)') as l from au) select count(*) filter (m) as matched, count(*) filter (m and g) as genuine, count(*) filter (m and not g) as prose_only, count(*) filter (l and not g) as leaked from k",
    "audit_leaks": f"with {_DOCS} select split_part(q1_value, '_', 1) as section, count(*) as n from au where regexp_matches(blob, '\\bthe(-|\\s|re)') and not (contains({_TAGS}, 'the') or contains({_TAGS}, 'and')) group by all order by n desc, section limit 8",
    "audit_misspell": f"with {_DOCS}, t(typo, correct) as (values ('teh', 'the'), ('adn', 'and'), ('thta', 'that'), ('qeu', 'que')) select typo, correct, count(*) filter (contains(blob, typo)) as hits, count(*) filter (contains(blob, typo) and contains({_TAGS}, typo)) as via_tags, count(*) filter (contains(blob, correct)) as correct_hits from au, t group by all",
    "audit_strict_and": f"with {_DOCS}, q(query, words, dropped) as (values ('the card', '', 'the card'), ('and that', 'that', 'and'), ('mom of the', 'mother', 'of the'), ('que la e-card', 'que la', 'e card'), ('happy card', '', 'happy card'), ('idiot', 'idiot', '')) select query, words, dropped, count(*) filter (words <> '' and len(list_filter(string_split(words, ' '), lambda x: not contains(blob, x))) = 0) as matches from q, au group by all",
    "audit_encoding": "with a as (select regexp_extract_all(html, '%[0-9A-Fa-f]{2}|&#[0-9]+;|&[a-z]+;') as a from pages), c as (select unnest(a) as artefact from a) select artefact, count(*) as n, (select count(*) from a where len(a) > 0) as affected from c group by all order by n desc, artefact limit 8",
    "audit_cap": f"with {_DOCS}, w(word) as (values ('the'), ('que'), ('der'), ('tion'), ('zzzz')), m as (select word, year, row_number() over (partition by word order by cast(card_number as bigint)) as r from w join au on contains(blob, word)), l as (select word, count(*) as matches, list_sort(list(year) filter (year > 0)) as ys, list_sort(list(year) filter (year > 0 and r <= 100)) as cs from m group by all) select word, matches, matches > 100 as capped, cs[len(cs) // 2 + 1] as capped_year, ys[len(ys) // 2 + 1] as all_year from l",
    "audit_tags": f"with {_DOCS} select case when year <= 2010 then '<=2010' else '>=2011' end as created, count(*) as cards, count(*) filter (trim(card_tags) <> '') as tagged from au group by all",
    "audit_tag_quality": f"with {_DOCS}, t as (select regexp_replace(lower(unnest(string_split(card_tags, ','))), '^\\s+|\\s+$', '', 'g') as tag from au), c as (select tag, count(*) as n from t where tag <> '' group by all), s as (select regexp_replace(card_tags, '^\\s+|\\s+$', '', 'g') as s, count(*) as n from au group by all) select count(*) as tags, count(*) filter (n = 1) as singletons, count(*) filter (regexp_matches(tag, '\\S\\s+\\S')) as phrases, (select cast(coalesce(sum(n) filter (n > 1), 0) as bigint) from s) as identical, (select cast(sum(n) as bigint) from s) as tagged from c",
    "audit_status": f"with {_DOCS}, y as (select *, cast(substring(card_created_date, 1, 4) as bigint) as year from cd), l as (select status_id, count(*) as n, round(100.0 * avg(case when trim(card_tags) <> '' then 1 else 0 end), 6) as tagged, list_sort(list(year)) as ys, count(distinct dev_id) as developers, round(100.0 * avg(case when dev_id = 'src1' then 1 else 0 end), 6) as own from y group by all) select status_id, n, tagged, ys[len(ys) // 2 + 1] as median_year, developers, own from l",
    "audit_index_cost": f"with {_DOCS}, w as (select distinct card_number, unnest(regexp_extract_all(lower(concat_ws(' ', card_title, card_description, card_tags, replace(q1_value, '_', ' '))), '[a-z0-9]+')) as w from au) select count(distinct w) as terms, count(*) as postings from w",
}

_PARTS_ENGINE = f"{_WITH_P}, {_FACETS}"


def _nested(name: str) -> str:
    """The part of a query's SQL behind the tables that all share."""
    return "with " + ORACLES[name].removeprefix(_WITH_P + ", ").removeprefix(f"with {_PARTS}, ")


def _engine(queries: str, numbers: bool = True) -> str:
    """The common tables of a search; without numbers, a card number is a word like any other."""
    sql = f"{_PARTS_ENGINE}, {understood(queries, _fold, _nested('variant_validation'), _SCORES, _nested('hint_validation'))}"
    return sql if numbers else sql.replace("where regexp_matches(trim(raw), '^[0-9]+$')", "where false")


_BATCH_SQL = "select * from (values " + ", ".join(f"('q{i:02d}', '{q}')" for i, q in enumerate(SEARCHES)) + ") as q(query_id, raw)"
_LOG_SEARCH = lambda limit: f"{_engine('select query_id, query_id as raw from lg').replace('with ', 'with ' + _LOG + ', ', 1)}, {searched(limit)}"
_REPLAY_SQL = f"{_LOG_SEARCH(20)}, re as (select query_id, cast(times as int) as times, cast(results as int) as old_n, n as new_n, strategy, coalesce(fixed, false) as fixed from lg join (select query_id, count(*) as n, max(strategy) as strategy, bool_or(message like 'Showing results for%') as fixed from out group by query_id) using (query_id))"
# what pages without rows say: pg, over understood()
_PAGE_SQL = f"""ow as ({occasion_words(_SCORES, _nested('hint_validation'))}), sh as (select distinct query_id from tm join ow using (term)),
pg as (select query_id, 1 as n, 'card number' as strategy, false as fallback, 'Card ' || card_number || '.' as message from xn union all
 select query_id, 0, case when query_id not in (select query_id from tm) then 'empty' when query_id in (select query_id from sh) then 'nearest occasion' else 'latest' end, true,
        case when query_id not in (select query_id from tm) then 'Showing the latest cards.' when query_id in (select query_id from sh) then 'No exact match. Showing the closest occasion.' else 'No matching cards. Showing the latest additions.' end from rq)"""
_BROAD = """ba0 as (select unnest([split_part(p_name, ' ', 1), right(p_name, 2), left(p_name, 1), ' ', case when p_partkey % 500 = 0 then cast(p_partkey as varchar) end]) as q from part), bt as (select q, count(*) as times from ba0 where q is not null group by q),
bg as (select q as query_id, times, (select count(*) from part where contains(p_name, trim(q))) as old_n from bt)"""
_UNPAGED_SQL = f"{_engine('select query_id, query_id as raw from bg').replace('with ', 'with ' + _BROAD + ', ', 1)}, {_PAGE_SQL}, re as (select query_id, times, old_n, cast(n as bigint) as new_n, strategy from bg join pg using (query_id))"
# completions of ty (typed_id, t) by su (phrase, weight)
_COMPLETED = "tw as (select typed_id, t, string_split(t, ' ') as ws from ty where length(t) >= 2), h as (select typed_id, phrase, weight, 0 as pass from tw join su on starts_with(phrase, t) and phrase <> t union all select distinct typed_id, phrase, weight, 1 from tw join (select phrase, weight, unnest(string_split(phrase, ' ')) as word from su) on starts_with(word, ws[-1]) and phrase <> t and len(list_filter(ws[:-2], lambda x: not contains(phrase, x))) = 0), b as (select typed_id, phrase, max(weight) as weight, min(pass) as pass from h group by all) select typed_id, row_number() over (partition by typed_id order by pass, weight desc, length(phrase), phrase) as rank, phrase from b qualify rank <= 8"
_SEARCH_SQL = lambda *args: f"{_engine(_BATCH_SQL)}, {searched(*args)}"
ORACLES |= {
    "understand_terms": f"{_engine(_BATCH_SQL, False)} select query_id, cast(pos as bigint) as pos, term from tm",
    "understand_facets": f"{_engine(_BATCH_SQL, False)} select query_id, kind, value, source, cast(pos as bigint) as pos from fc",
    "understand_groups": f"{_engine(_BATCH_SQL, False)} select term, member from gr",
    "nearest_occasion": f"{_engine(_BATCH_SQL, False)}, ow as ({occasion_words(_SCORES, _nested('hint_validation'))}), sh as (select query_id, section, count(*) as n from (select distinct query_id, term from tm) join ow using (term) group by all) select query_id, section, n from sh qualify row_number() over (partition by query_id order by n desc, section) = 1",
    "mean_year": f"{_SEARCH_SQL(10)} select query_id, round(avg(year), 6) as mean_year from out join yr using (doc) group by query_id",
    "ladder_search": f"{_SEARCH_SQL(10)} select query_id, rank, number, title, year, strategy, fallback, message, why from out join yr using (doc)",
    "ladder_strategy": f"{_SEARCH_SQL(1)} select query_id, strategy, fallback, message from out",
    "popularity_ranked": f"{_SEARCH_SQL(5, 0.0, 'select cast(p_partkey as varchar) as number, p_retailprice as score from part')} select query_id, rank, number, strategy from out join yr using (doc)",
    "compare_old_new": f"{_SEARCH_SQL(10)}, ol as ({ORACLES['baseline_search'].replace('with ' + _PARTS, 'with ' + _PARTS)}), o as (select query_id, max(n) as old_n from ol group by query_id), w as (select query_id, count(*) as new_n, max(strategy) as strategy from out group by query_id) select query_id, coalesce(old_n, 0) as old_n, new_n, strategy from w left join o using (query_id)",
    "compare_log": f"{_LOG_SEARCH(10)}, ol as ({ORACLES['baseline_search'].replace(_QUERIES_SQL, _LOG + ', qs as (select query_id, query_id as raw from lg)')}), o as (select query_id, max(n) as old_n from ol group by query_id), w as (select query_id, count(*) as new_n, max(strategy) as strategy from out group by query_id) select query_id, coalesce(old_n, 0) as old_n, new_n, strategy from w left join o using (query_id)",
    "json_results": f"{_SEARCH_SQL(3)}, fj as (select doc, '{{' || string_agg('\"' || kind || '\":[' || vs || ']', ',' order by kind) || '}}' as facets from (select doc, kind, string_agg('\"' || value || '\"', ',' order by value) as vs from (select distinct doc, kind, value from fa) group by all) group by doc) select query_id, rank, card_number as number, card_title as title, q1_value as q1, section as occasion, case when contains(q1_value, '_') then substring(q1_value, length(section) + 2) else section end as subcat, replace(card_page_url, '.html', '') as page, 'jpg' as thumb_extn, 'gif' as big_extn, substring(card_created_date, 1, 4) as year, why, facets from out join lp using (doc) join fj using (doc)",
    "suggest_lookup": f"with su as ({ORACLES['suggest_build']}), ty(typed_id, t) as (values {', '.join(f'({chr(39)}{i}{chr(39)}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(TYPED))}), {_COMPLETED}",
    "suggest_prefixes": f"with su as ({ORACLES['suggest_build']}), nm as (select distinct p_name as name from part union select distinct array_to_string(list_reverse(string_split(p_name, ' ')), ' ') from part), ty as (select distinct p as typed_id, trim(p) as t from (select substring(name, 1, i) as p from nm, (select unnest(range(1, 60)) as i) where i <= length(name))), {_COMPLETED}",
    "eval_zero_rate": f"{_REPLAY_SQL} select count(*) as queries, cast(sum(times) as bigint) as searches, count(*) filter (old_n = 0) as old_zero, count(*) filter (new_n = 0) as new_zero, cast(coalesce(sum(times) filter (old_n = 0), 0) as bigint) as old_volume, cast(coalesce(sum(times) filter (new_n = 0), 0) as bigint) as new_volume from re",
    "eval_regressions": f"{_REPLAY_SQL} select query_id, times, old_n from re where old_n > 0 and new_n = 0 and trim(query_id) <> ''",
    "eval_still_zero": f"{_REPLAY_SQL} select query_id, times from re where old_n = 0 and new_n = 0",
    "eval_fixed": f"{_REPLAY_SQL} select query_id, times, cast(new_n as bigint) as new_n, strategy from re where old_n = 0 and new_n > 0",
    "eval_overmatch": f"{_REPLAY_SQL} select query_id, times, old_n, round(100.0 * old_n / total, 6) as share from re, nn where old_n > total * 0.2",
    "eval_unpaged": f"{_UNPAGED_SQL} select query_id, times, old_n, new_n, strategy from re",
    "eval_regressions_unpaged": f"{_UNPAGED_SQL} select query_id, cast(times as int) as times, cast(old_n as int) as old_n from re where old_n > 0 and new_n = 0 and trim(query_id) <> ''",
    "eval_still_zero_unpaged": f"{_UNPAGED_SQL} select query_id, cast(times as int) as times from re where old_n = 0 and new_n = 0",
    "eval_overmatch_broad": f"{_UNPAGED_SQL} select query_id, cast(times as int) as times, cast(old_n as int) as old_n, round(100.0 * old_n / total, 6) as share from re, (select count(*) as total from lp) where old_n > total * 0.2",
    "pages_of_none": f"{_engine(_BATCH_SQL)}, {_PAGE_SQL} select query_id, n, strategy, fallback, message from pg",
    "suggest_filter": f"with f as (select unnest([p_name, p_name || ' <script>x', 'Alert: ' || p_name, p_name || '/etc/passwd', p_partkey || ' ' || p_size, substring(p_name, 1, 2), repeat(p_name || ' ', 5), p_name || chr(39) || 's size ' || p_size]) as q from part), p as (select distinct {_fold("replace(q, chr(39), '')")} as phrase from f) select phrase, length(phrase) between 3 and 40 and not regexp_matches(phrase, '(?i)script|alert|passwd') and regexp_full_match(phrase, '[a-z0-9 &.,-]+') and not regexp_full_match(replace(phrase, ' ', ''), '[0-9]+') as offered from p",
    "url_templates": f"with {_DOCS} select card_number as number, 'https://images.example/' || q1_value || '/' || card_number || '_small.gif' as image, '/cards/' || replace(card_page_url, '.html', '') || '?n=' || card_number || '&x={{unknown}}' as link from ld",
    "eval_strategy_mix": f"{_REPLAY_SQL} select strategy, cast(sum(times) as bigint) as searches from re group by strategy",
    "eval_corrections": f"{_REPLAY_SQL} select cast(coalesce(sum(times) filter (fixed), 0) as bigint) as corrected, cast(sum(times) as bigint) as searches from re",
}
