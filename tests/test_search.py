import pytest
from pyspark.sql import functions as F

from quillsearch import lexicons as L
from quillsearch.operators import spell
from quillsearch.operators.search import recency, rungs, search
from quillsearch.plans.catalogues import parts_catalogue
from quillsearch.plans.index import build_index

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    return build_index(parts_catalogue(spark, DATA), L.PART_LEXICONS)


@pytest.fixture(scope="module")
def found(spark, index):
    raw = {"a": "small red widget", "b": "SMALL  Red widget!", "c": "", "d": "zzzzqqq", "e": "wigdet", "f": "17", "g": "hot plates", "h": "'; drop table x --", "i": "​\U0001f600", "j": "w" * 5000, "k": None}
    rows = search(index, spark.createDataFrame(list(raw.items()), "query_id string, raw string"), limit=5).collect()
    out = {q: sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"]) for q in raw}
    return out


def test_every_query_is_answered_in_order(found):
    for rows in found.values():
        assert 1 <= len(rows) <= 5
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_case_and_spaces_do_not_matter(found):
    assert [r.number for r in found["a"]] == [r.number for r in found["b"]]


def test_fallbacks_say_so(found):
    assert found["c"][0].strategy == "empty" and found["k"][0].strategy == "empty"
    assert found["d"][0].strategy == "latest" and found["d"][0].fallback
    years = [r.year for r in found["d"]]
    assert years == sorted(years, reverse=True)


def test_corrections_and_numbers(found):
    assert found["e"][0].message == "Showing results for wigdet → widget"
    assert (found["f"][0].strategy, found["f"][0].number, len(found["f"])) == ("card number", "17", 1)


def test_excluded_label_never_appears(spark, index):
    assert index.cards.where("card_label_type = 'Y'").count() == 0


def test_ladder_names(spark):
    sizes = spark.createDataFrame([("q", 2, 2, 4)], "query_id string, n_t int, n_k int, n_terms int")
    names = [r.strategy for r in rungs(sizes).orderBy("rung").collect()]
    assert names == ["all terms", "dropped 1 weak term(s)", "facets + best term", "facets only", "1 facet(s) + best term", "1 facet(s) only", "best term only", "any term"]


def test_recency_is_bounded(spark):
    f = spark.createDataFrame([(0,), (2000,), (2025,), (2030,)], "y int").select(recency(F.col("y"), 2025).alias("f")).collect()
    assert f[0].f == 1.0 and f[2].f == pytest.approx(1.15) and f[3].f == pytest.approx(1.15) and 1.0 < f[1].f < 1.01


def test_spelling_agrees_with_brute_force(spark, index):
    from quillsearch.functions.text import distances

    osa = lambda a, b, most: min(int(distances([a], [b])[0]), most + 1)

    words = ["wigdet", "gizom", "plaet", "smal", "anvill", "widget", "xyz", "zzzzzzzz", "standrad"]
    vocabulary = {r.term: r.df for r in index.terms.where("df >= 3").collect()}
    got = {r.word: (r.corrected, r.distance) for r in spell.corrections(index, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    for w in words:
        cap = 3 if len(w) >= 7 else 2
        near = sorted((osa(w, t, cap), -df, t) for t, df in vocabulary.items() if len(t) >= 4 and osa(w, t, cap) <= cap and (osa(w, t, cap) <= 2 or osa(w, t, cap) <= 0.3 * max(len(w), len(t))))
        expected = (w, 0) if w in vocabulary else (w, -1) if len(w) < 4 or not near else (near[0][2], near[0][0])
        assert got[w] == expected


def test_ladder_agrees_with_running_each_rung(spark, index):
    """The rungs one after the other, over collected tables, against the set-at-a-time form."""
    from collections import defaultdict

    from quillsearch.operators.search import ordered_facets, ordered_terms, term_weights
    from quillsearch.operators.understand import understand

    raw = {"a": "small red widget", "b": "promo blue gear", "c": "hot plates musical", "d": "widgetring", "e": "red red bolt", "f": "animated blue hot ring gear old", "g": "smal anvl", "h": "cold"}
    queries = spark.createDataFrame(list(raw.items()), "query_id string, raw string")
    limit = 30
    got = defaultdict(list)
    for r in search(index, queries, limit).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc, r.strategy))
    u = understand(index, queries)
    postings, docs_of = defaultdict(dict), defaultdict(set)
    for r in index.postings.collect():
        postings[r.term][r.doc] = r.weight
    for r in index.facets.collect():
        docs_of[r.kind, r.value].add(r.doc)
    idf = {r.term: r.idf for r in index.terms.collect()}
    card = {r.doc: (r.year, r.title) for r in index.docs.collect()}
    per = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.collect()]
    groups = defaultdict(set)
    for t, m in per(u.groups, "term", "member"):
        groups[t].add(m)
    for q in raw:
        ts = [t for _, t in sorted((n, t) for i, t, n in per(ordered_terms(index, u), "query_id", "term", "t") if i == q)]
        ks = [x[1:] for x in sorted((k, kind, value, boost) for i, k, kind, value, boost in per(ordered_facets(index, u), "query_id", "k", "kind", "value", "boost") if i == q)]
        weights = {t: m for i, t, m in per(term_weights(index, u), "query_id", "term", "multiplier") if i == q}
        n = len(ts)
        steps = [("all terms", ks, ts)] * (n > 0) + [(f"dropped {d} weak term(s)", ks, ts[:-d]) for d in range(1, n)]
        if ks:
            steps += [("facets + best term", ks, ts[:1])] * (n > 0) + [("facets only", ks, [])]
            for k in range(len(ks) - 1, 0, -1):
                steps += [(f"{k} facet(s) + best term", ks[:k], ts[:1])] * (n > 0) + [(f"{k} facet(s) only", ks[:k], [])]
        steps += [("best term only", [], ts[:1])] * (n > 0) + [("any term", [], [])]
        out, landed = [], None
        for name, facets, need in steps:
            if len(out) >= limit:
                break
            sets = [set().union(*[postings[m] for m in groups[t]]) for t in need] + [docs_of[k[:2]] for k in facets if docs_of.get(k[:2])]
            pool = set.intersection(*sets) if sets else set().union(*[postings[t] for t in weights])
            value = {}
            for d in pool:
                v = sum(idf[t] * postings[t][d] * m for t, m in weights.items() if d in postings[t]) + sum(k[2] for k in facets if d in docs_of.get(k[:2], ()))
                if v > 0:
                    value[d] = v * (1 + 0.15 * 0.5 ** ((index.newest - card[d][0]) / 5.0))
            if value:
                landed = landed or name
                top = max(value.values())
                order = sorted(value, key=lambda d: (-int(round(10 * value[d] / top, 9)), -card[d][0], card[d][1], d))
                out += [d for d in order if d not in out][: limit - len(out)]
        assert [d for d, _ in got[q]] == out, q
        assert {s for _, s in got[q]} == {landed}
