"""Bitmaps of documents and the search that they carry, against plain sets and an index without bounds."""

import random

import pytest
from pyspark.sql import functions as F

from quillsearch import lexicons as L
from quillsearch.operators import search as S
from quillsearch.operators.understand import understand
from quillsearch.plans import bitmaps as B
from quillsearch.plans.index import Index, build_index

DOCS = 3 << B.BLOCK_BITS


@pytest.fixture(scope="module")
def members():
    rng = random.Random(2)
    sizes = {"a": 5, "b": 4000, "c": 90, "d": 20000, "e": B.FEW, "f": B.FEW + 1}
    return {k: {0, DOCS - 1} | set(rng.sample(range(DOCS), n)) for k, n in sizes.items()} | {"z": {(1 << B.BLOCK_BITS) - 1, 1 << B.BLOCK_BITS}, "y": set(range(100, 100 + B.FEW))}


@pytest.fixture(scope="module")
def table(spark, members):
    rows = spark.createDataFrame([(k, d) for k, ds in members.items() for d in ds], "k string, doc long")
    return B.sets(rows, "k").cache()


def docs_of(rows, keys):
    out = {}
    for r in B.documents(B.slabs(rows, 10), 10).collect():
        out.setdefault(tuple(r[k] for k in keys), set()).add(r.doc)
    return out


def test_sets_keep_every_document(members, table):
    assert docs_of(B.united(table, "k"), ["k"]) == {(k,): v for k, v in members.items()}
    assert {r.k: r.n for r in table.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {k: len(v) for k, v in members.items()}
    assert all((r.bits is None) == (r.n <= B.FEW) and (r.few is None) == (r.n > B.FEW) for r in table.collect())


def test_or_and_and(spark, members, table):
    asked = [("q1", "ab"), ("q2", "bd"), ("q3", "cez"), ("q4", "bdf"), ("q5", "yz")]
    pairs = spark.createDataFrame([(q, k, len(ks)) for q, ks in asked for k in ks], "q string, k string, needed int")
    rows = pairs.join(table, "k")
    either = docs_of(B.united(rows, "q"), ["q"])
    both = docs_of(B.common(B.united(rows, "q", "k", "needed"), "needed", "q"), ["q"])
    for q, ks in asked:
        assert either[q,] == set.union(*[members[k] for k in ks])
        assert both.get((q,), set()) == set.intersection(*[members[k] for k in ks])


@pytest.mark.parametrize("slab_bits", [3, 7, 15])
def test_slabs_count_their_documents(members, table, slab_bits):
    got = {(r.k, r.slab): r.n for r in B.slabs(B.united(table, "k"), slab_bits).collect()}
    want = {}
    for k, ds in members.items():
        for d in ds:
            want[k, d >> slab_bits] = want.get((k, d >> slab_bits), 0) + 1
    assert got == want


@pytest.fixture(scope="module")
def catalogue(spark):
    """600 cards of which a few hold a word in title, tags and text, most in their text only, in runs of neighbours."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        strong = i // 40 in (3, 11)
        title = rng.choice(["lamp oil", "lamp", "oil can lamp"]) if strong else rng.choice(["table", "chair seat", "plain bed"])
        rows.append((str(1000 + i), title, f"some {rng.choice(['lamp', 'rug'])} of {rng.choice(['oil', 'wood', 'tin'])} number{i % 7}", "lamp,oil" if strong else "wood", f"p{i}.html", rng.choice(["house_decor", "garden_seats"]), "S", f"{rng.choice([2005, 2024])}-01-01", "", "1", "0", "", "", "d"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in L.CATALOGUE_COLUMNS))


QUERIES = [("q1", "lamp"), ("q2", "oil lamp"), ("q3", "lamp wood tin"), ("q4", "lamp number3 oil bed"), ("q5", "nothing here"), ("q6", "chair oil tin wood lamp")]


def test_bounds_change_no_result_and_spare_slabs(spark, catalogue):
    asked = spark.createDataFrame(QUERIES, "query_id string, raw string")
    fine = build_index(catalogue, L.PART_LEXICONS)
    fine.slab_bits = 3
    whole = Index(fine.cards, fine.lexicons, 15)
    rows = lambda ix, n, boost: sorted(map(str, S.search(ix, asked, n, boost=boost).collect()))
    for limit, boost in ((3, 0.15), (20, 0.0), (0, 0.15)):
        assert rows(fine, limit, boost) == rows(whole, limit, boost)
    u = understand(fine, asked)
    ts, ks = S.ordered_terms(fine, u), S.ordered_facets(fine, u)
    ladder = spark.createDataFrame([(q, 0, 1, 0, 0.0, False) for q in ("q1", "q2")], "query_id string, rung int, need_t int, need_k int, facets double, active boolean")
    r = S.bounded(fine, u, S.rung_sets(fine, u, ts, ks, ladder, 3), ladder, 0.15)
    done = S.promising(r, 3)
    more = S.unsettled(r, S.scored(fine, r, done, 0.15), done, 3)
    total = r.slabs.where("query_id = 'q1'").count()
    read = done.unionByName(more).where("query_id = 'q1'").count()
    assert total > 60 and read < 25
    # every value is within its slab's bound
    values = S.scored(fine, r, r.slabs.select("query_id", "slab").distinct(), 0.15).withColumn("slab", F.shiftright("doc", 3))
    assert values.join(r.slabs.select("query_id", "rung", "slab", "most"), ["query_id", "rung", "slab"]).where("value > most").count() == 0


def test_pairs_of_terms(spark, catalogue):
    ix = build_index(catalogue, L.PART_LEXICONS)
    held = {}
    for r in ix.postings.collect():
        held.setdefault(r.term, set()).add(r.doc)
    pairs = [("lamp", "oil"), ("oil", "lamp"), ("bed", "bed"), ("chair", "oil"), ("bed", "absent"), ("number3", "tin")]
    got = {(r.a, r.b): r.n for r in ix.pair_sizes(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {(a, b): len(held.get(a, set()) & held.get(b, set())) for a, b in pairs}
