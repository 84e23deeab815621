"""Completion table, deletion index and trigram index against plain searches over all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillsearch import lexicons as L
from quillsearch.operators import baseline, spell, suggest
from quillsearch.plans.catalogues import parts_catalogue
from quillsearch.plans.index import build_index

SMALL = "/root/testdata/sf0.001"


def plain_suggest(weights, typed, limit=8):
    if len(typed) < 2:
        return []
    phrases, out = sorted(weights), {}
    start = next((i for i, p in enumerate(phrases) if p >= typed), len(phrases))
    for p in phrases[start : start + L.SUGGEST_WINDOW]:
        if p.startswith(typed):
            out[p] = 0
    *heads, last = typed.split()
    for p in phrases:
        if any(w.startswith(last) for w in p.split()) and all(h in p for h in heads):
            out.setdefault(p, 1)
    out.pop(typed, None)
    return sorted(out, key=lambda p: (out[p], -weights[p], len(p), p))[:limit]


def test_completions_against_a_scan(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    weights = {" ".join(word() for _ in range(rng.randint(1, 3))): rng.randint(1, 5) / 4 for _ in range(1500)}
    weights |= {f"ab{i:04d}": 1.0 if i < 450 else 9.0 for i in range(600)}  # more than a window has of one prefix
    table = suggest.completions(spark.createDataFrame(list(weights.items()), "phrase string, weight double"))
    typed = sorted({p[:n] for p in rng.sample(sorted(weights), 250) for n in range(1, 9)} | {f"{word()} {word()}" for _ in range(200)} | {"", "zz", "a", "ab", "ab0", "c a"})
    typed = sorted({" ".join(t.split()) for t in typed})
    assert len(typed) > 500
    got = {t: [] for t in typed}
    for r in suggest.suggest(table, spark.createDataFrame([(t, t) for t in typed], "typed_id string, typed string")).orderBy("typed_id", "rank").collect():
        got[r.typed_id].append(r.phrase)
    for t in typed:
        assert got[t] == plain_suggest(weights, t), t
    with pytest.raises(ValueError):
        suggest.suggest(table, spark.createDataFrame([("a", "ab")], "typed_id string, typed string"), 9)


def test_completions_of_all_that_begins(spark):
    """More phrases than a window has begin with what was typed, the heaviest of them last in order."""
    weights = {f"ab{i:04d} x": 1.0 if i < 450 else 2.0 + i for i in range(600)} | {"zz abz": 9999.0, "ab0599": 0.5}
    table = suggest.completions(spark.createDataFrame(list(weights.items()), "phrase string, weight double"), window=None)
    got = [tuple(r) for r in suggest.suggest(table, spark.createDataFrame([("a", "ab"), ("b", "ab05")], "typed_id string, typed string")).orderBy("typed_id", "rank").collect()]
    best = [f"ab{i:04d} x" for i in range(599, 591, -1)]
    assert got == [(t, r, p) for t in "ab" for r, p in enumerate(best, 1)]


@pytest.fixture(scope="module")
def parts(spark):
    return build_index(parts_catalogue(spark, SMALL), L.PART_LEXICONS)


def test_corrections_do_not_move_the_deletion_index(spark, parts):
    asked = spark.createDataFrame([(w,) for w in ("wigdet", "gizom", "zzzzz", "smal", "widget", None)], "word string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spell.corrections(parts, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.word: r.corrected for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"wigdet": "widget", "gizom": "gizmo", "zzzzz": "zzzzz", "smal": "small", "widget": "widget"}
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "variant" in line)
    assert "Bucketed: true" in scan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(variant" in line]
    assert len(moved) == 1  # the asked words' side
    assert build_index(parts_catalogue(spark, SMALL), L.PART_LEXICONS).deletions.count() == parts.deletions.count()


def test_deletions_are_those_of_each_term(parts):
    got = {(r.variant, r.term) for r in parts.deletions.collect()}
    want = set()
    for term in (r.term for r in parts.vocabulary.collect() if len(r.term) >= L.MIN_CORRECTABLE):
        level = {term}
        want |= {(term, term)}
        for _ in range(L.LOOSE_EDITS if len(term) >= L.LOOSE_MIN_TERM else L.EDITS):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))} - {""}
            want |= {(w, term) for w in level}
    assert got == want


TEXTS = ["abcab bcd", "x", "ab", "", "don't stop", "a_b-c", "cab abx bca", "ÉTÉ d'or", "xyxyxyx", "0 1 00", None]


def test_trigram_index_against_a_scan(spark):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abc '") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(str(i), t, "", "t", f"{i}.html", "q_x", "S", "2020-01-01", "", "1", "0", "", "", "d") for i, t in enumerate(texts)]
    ix = build_index(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in L.CATALOGUE_COLUMNS)))
    asked = ["abc", "ab", "b", "abca bcab", "cabc x", "zq", "xyx", "yxyxy", "00 1", "don't", "a", "the", "", None, "t html q", "c'", "bb cc", "ababab", "abc zz"]
    blobs = {r.doc: r.blob for r in ix.blobs.collect()}
    queries = spark.createDataFrame([(f"q{i}", a) for i, a in enumerate(asked)], "query_id string, raw string")
    for cap in (7, 500):
        got = {}
        for r in baseline.old_search(ix, queries, 5, cap).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.n))
        for i, a in enumerate(asked):
            words = [w for w in re.findall(r"[a-z0-9']+", (a or "").lower()) if w not in L.BASELINE_STOP_WORDS]
            met = [d for d in sorted(blobs) if words and all(w in blobs[d] for w in words)][:cap]
            assert got.get(f"q{i}", []) == [(k, d, len(met)) for k, d in enumerate(met[:5], 1)], a
    plan = baseline.old_search(ix, queries)._jdf.queryExecution().toString()
    assert "don't" not in plan
    assert ix.gram_sizes.where(F.col("df") <= 0).count() == 0


def test_prefixes_over_blocks_of_a_hot_key(spark):
    rng = random.Random(9)
    terms = {f"abc{i:04d}": rng.randrange(1, 9) for i in range(1500)} | {w: 3 for w in ("ab", "abb", "abc", "abd", "abdz", "zzz", "\u00e9t\u00e9")}
    index = build_index(parts_catalogue(spark, SMALL))
    index.block_terms = 50
    index.__dict__["terms"] = spark.createDataFrame([(t, n, 1.0) for t, n in terms.items()], "term string, df long, idf double")
    words = ["abc", "abc0", "abc09", "abc1499", "abc15", "abd", "ab", "abcd", "zzz", "\u00e9t\u00e9", "none"]
    got = {(r.word, r.r): (r.term, r.df) for r in index.prefix_terms(spark.createDataFrame([(w,) for w in words + ["abc"]], "word string")).collect()}
    want = {}
    for w in words:
        first = [t for t in sorted(terms) if t.startswith(w)][: L.PREFIX_WINDOW] if len(w) >= L.PREFIX_MIN else []
        want |= {(w, r): (t, terms[t]) for r, t in enumerate(sorted(first, key=lambda t: (-terms[t], t))[: L.PREFIX_LIMIT], 1)}
    assert got == want
    hot = index.term_fences.where("k = 'abc'").count()
    assert hot > 15 and index.term_blocks.select("block").distinct().count() >= hot  # one key, many tasks
    sizes = [r["count"] for r in index.term_blocks.groupBy("block").count().collect()]
    assert max(sizes) <= 4 * index.block_terms
