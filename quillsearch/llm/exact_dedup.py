"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, which gives each
block an integer name; then adjacent pairs of names are named in the same way, level by level, until one name is
left of each text. Two texts have the same number of levels and the same last name exactly when they are equal:
no step relies on a hash being free of collisions. DataFrame functions only.

The text of a block is shuffled once, after map-side removal of repeats. Rows find the name of their block by a
128-bit digest; digests that two different blocks share are found by counting and those few blocks are joined by
their text, so that the digest only ever saves bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, texts, written

BLOCK_CHARS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def digest(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("a"), F.xxhash64(F.lit("second"), block).alias("b"))


def _named(keys: DataFrame, names: list[str], what: str) -> DataFrame:
    """The distinct keys, sorted within hash partitions and numbered in that order, as a table."""
    return written(keys.select(*names).distinct().sortWithinPartitions(*names).withColumn("name", F.monotonically_increasing_id()), what)


def _level_zero(blocks: DataFrame, digest_of: Callable[[Column], Column]) -> DataFrame:
    distinct = blocks.select("block").distinct().sortWithinPartitions("block")
    names = written(distinct.select(digest_of(F.col("block")).alias("d"), F.monotonically_increasing_id().alias("name")), "block-names")
    rows = blocks.withColumn("d", digest_of(F.col("block")))
    clashes = names.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    if clashes.isEmpty():
        return rows.drop("block").join(names, "d").drop("d")
    clashes = written(clashes, "digest-clashes")
    exact = blocks.select("block").distinct().withColumn("d", digest_of(F.col("block"))).join(clashes, "d", "left_semi")
    exact = written(exact.sortWithinPartitions("block").select("block", (-1 - F.monotonically_increasing_id()).alias("name")), "exact-names")
    plain = rows.join(clashes, "d", "left_anti").drop("block").join(names, "d").drop("d")
    return plain.unionByName(rows.join(clashes, "d", "left_semi").join(exact, "block").drop("block", "d"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digest_of: Callable[[Column], Column] = digest) -> DataFrame:
    """One row for each input row: rid (number of the row), doc_id, n_chars, text_sha256, level, name. Rows have equal
    normalised texts exactly when (level, name) agree."""
    norm = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    cut = norm.select("rid", "doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(f"(?s)(.{{1,{block_chars}}})")).alias("blocks"))
    blocks = cut.select("rid", "doc_id", "n_chars", "text_sha256", F.greatest(F.size("blocks"), F.lit(1)).alias("width"), F.posexplode_outer("blocks").alias("pos", "block"))
    blocks = blocks.withColumns({"pos": F.coalesce("pos", F.lit(0)), "block": F.coalesce("block", F.lit(""))})
    for c in ("doc_id", "n_chars", "text_sha256"):  # once a text, not once a block
        blocks = blocks.withColumn(c, F.when(F.col("pos") == 0, F.col(c)))
    level, done = written(_level_zero(blocks, digest_of), "level"), []
    for k in range(64):
        done.append(level.where("width = 1").select("rid", "doc_id", "n_chars", "text_sha256", F.lit(k).alias("level"), "name"))
        rest = level.where("width > 1")
        if rest.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("rid", "width", F.shiftright("pos", 1).alias("half")).agg(
            side(0).alias("l"), F.coalesce(side(1), F.lit(-(1 << 62))).alias("r"), *[F.max(c).alias(c) for c in ("doc_id", "n_chars", "text_sha256")])
        names = _named(pairs, ["l", "r"], "pair-names")
        level = written(pairs.join(names, ["l", "r"]).select("rid", "doc_id", "n_chars", "text_sha256", F.shiftright(F.col("width") + 1, 1).alias("width"), F.col("half").alias("pos"), "name"), "level")
    return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **naming) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars: one row for each input row.

    Of the rows with equal texts the one with the most code points in its original text stays, then the one with the
    smallest doc_id (null before all), then the first. A null text counts as empty; empty texts are equal. Repeated rows
    are copies of one another. An empty table gives an empty result. Other columns are ignored.
    """
    rows = identities(docs, id_col, text_col, **naming)
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id"), F.col("rid"))).alias("first")
    groups = written(rows.groupBy("level", "name").agg(first, F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "n_chars")


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with all its columns, without the rows that exact_duplicates doesn't keep."""
    kept = exact_duplicates(docs).where("kept").select("doc_id", "n_chars", F.col("text_sha256").alias("sha"))
    text = F.coalesce(docs["text"], F.lit(""))
    keys = {"doc_id": docs["doc_id"].cast("long"), "n_chars": F.length(text), "sha": F.sha2(normalised(text).cast("binary"), 256)}
    return keep_rows(docs, kept, keys)


ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as s from documents),
k as (select doc_id, s, first_value(doc_id) over (partition by s order by n desc, doc_id) as keep_id,
             count(*) over (partition by s) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(s) as text_sha256 from k
"""
