import random

from pyspark.sql import functions as F

from quillsearch.plans.index import RANGE_CHARS, numbered
from quillsearch.scratch import written


def test_every_row_has_its_own_place_whatever_the_ranges(spark):
    """More rows than a sample of the ranges takes, in an order of their own."""
    n = 60_000
    cards = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).cast("string").alias("card_number"), F.lit("t").alias("card_title"), F.lit("d").alias("card_description"), F.sha2(F.col("id").cast("string"), 256).alias("other"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = written(numbered(cards), "numbered").select(F.count("*"), F.countDistinct("doc"), F.sum((F.col("doc") != F.col("card_number").cast("long")).cast("int"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got) == (n, n, 0)


def test_ranges_are_in_step_with_the_order(spark):
    chance = random.Random(5)
    long = "a" * RANGE_CHARS
    texts = [None, "", "a", "b", long, long + "a", long + "b", long[1:]]
    rows = [(chance.choice([None, "", "7", "07", "x", *texts]), chance.choice(texts), chance.choice(texts), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "card_number string, card_title string, card_description string, i int").repartition(8)).orderBy("doc").collect()
    keyed = lambda s: (s is not None, s or "")
    number = lambda s: (0, int(s)) if s and s.isdigit() else (1, 0)
    keys = [(number(r.card_number), keyed(r.card_number), keyed(r.card_title), keyed(r.card_description)) for r in got]
    assert [r.doc for r in got] == list(range(len(rows))) and keys == sorted(keys)
