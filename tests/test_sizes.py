import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from quillsearch.functions import text as T
from quillsearch.plans import bitmaps
from quillsearch.plans.catalogues import docs_catalogue
from quillsearch.plans.index import build_index, live
from quillsearch.scratch import written


def estimated(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_rows_that_repeat_count_with_their_own_size(spark):
    """Spark must not take a table of long runs for one that it may broadcast."""
    rows = spark.range(200_000).select(F.lit("occasion").alias("kind"), F.lit("birthday").alias("value"), (F.col("id") * 0).alias("doc"))
    assert estimated(written(rows, "plain", plain=True)) > 200_000 * 24 > 10 * estimated(written(rows, "coded"))


def test_tables_of_an_index_have_their_own_size(spark):
    cards = spark.range(20_000).select(
        F.col("id").cast("string").alias("card_number"), F.lit("red ring").alias("card_title"), F.lit("a ring").alias("card_description"), F.lit("red").alias("card_tags"), F.lit("small_1").alias("q1_value"), F.lit("x.html").alias("card_page_url"),
        F.lit("S").alias("card_label_type"), F.lit("2002-01-01").alias("card_created_date"), F.lit("").alias("card_music_extn"), F.lit("1").alias("status_id"), F.lit("0").alias("invalid_card"), F.lit("").alias("card_thumb_extn"), F.lit("").alias("card_bigimage_extn"),
    )
    assert estimated(build_index(cards).facets) > 20_000 * 24


def test_slabs_taken_apart_many_at_a_time(spark):
    n = 5_000
    members = spark.range(0, n * 7, 7).select(F.lit("a").alias("q"), F.col("id").alias("doc"))
    bits = bitmaps.united(bitmaps.sets(members, "q"), "q")
    got = bitmaps.documents(bitmaps.slabs(bits, 5), 5).orderBy("doc").collect()
    assert [(r.q, r.n > 0, r.doc) for r in got] == [("a", True, 7 * i) for i in range(n)]


def files(folder, pattern="*.parquet"):
    return sum(p.stat().st_size for p in Path(folder).rglob(pattern))


def test_index_takes_no_multiple_of_the_texts(spark):
    cards = docs_catalogue(spark, "/root/testdata/sf0.01")
    texts = live(cards).agg(F.sum(F.octet_length("card_description"))).first()[0]
    shared = spark.conf.get("spark.checkpoint.dir")
    before = files(shared)
    index = build_index(cards)
    index.card_words.count()
    words = files(shared)
    assert words - before < 2.5 * texts
    index.postings.count()
    assert files(shared) - words < 1.5 * texts


def test_tables_leave_no_shuffle_behind(spark):
    local = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    kept = lambda: {p for d in local for p in Path(d).rglob("shuffle_*.data")}
    before = kept()
    assert written(spark.range(100_000).repartition(4, "id"), "moved").count() == 100_000
    moved = {p for p in kept() - before if p.stat().st_size > 100_000}
    assert not moved


def test_sets_meet_in_one_shuffle(spark):
    members = spark.range(3000).select(F.when(F.col("id") % 9 == 0, "a").otherwise("b").alias("q"), (F.col("id") * 31).alias("doc"))
    got = bitmaps.sets(members, "q")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = Counter(("a" if i % 9 == 0 else "b", i * 31 >> bitmaps.BLOCK_BITS) for i in range(3000))
    assert {(r.q, r.block): r.n for r in got.collect()} == want
    assert all((r.few is None) != (r.bits is None) and (r.few is None) == (r.n > bitmaps.FEW) for r in got.collect())


def test_words_counted_in_their_rows(spark):
    chance = random.Random(3)
    rows = [(i, [chance.choice(["a", "b", "ab", "c", "z9"]) for _ in range(chance.randrange(12))]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, w array<string>").select("i", T.counted(F.col("w")).alias("c")).collect()
    assert {r.i: [tuple(x) for x in r.c] for r in got} == {i: sorted(Counter(w).items()) for i, w in rows}
