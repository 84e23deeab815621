"""Sets of documents as bitmaps: a row a key and block of 32,768 documents (the size of Spark's own bitmaps), ORed and ANDed by aggregates.

A set with few documents in a block keeps their places in the block in place of bits. A block is made of slabs of documents, the unit
in which scores are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shipping import shipped

BLOCK_BITS = 15
#: Documents of a block up to which a set keeps places, not bits (an eighth of the bytes of a bitmap).
FEW = 128
#: Slabs that a task takes apart at a time.
SLABS = 256


def block_of(doc: Column) -> Column:
    return F.shiftright(doc, BLOCK_BITS)


def place_of(doc: Column) -> Column:
    return doc.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def sets(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, n, bits, few) from distinct (keys, doc): bits are null where few is not."""
    placed = members.select(*keys, block_of(F.col("doc")).alias("block"), place_of(F.col("doc")).cast("int").alias("place"))
    both = placed.groupBy(*keys, "block").agg(F.collect_list("place").alias("few")).withColumn("n", F.size("few").cast("long"))  # a block's places at most
    dense = both.where(F.col("n") > FEW).select(*keys, "block", "n", F.explode("few").alias("place")).groupBy(*keys, "block", "n").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    sparse = both.where(F.col("n") <= FEW).select(*keys, "block", "n", F.array_sort("few").alias("few"))
    return dense.withColumn("few", F.lit(None).cast("array<int>")).unionByName(sparse.withColumn("bits", F.lit(None).cast("binary")))


def united(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, bits) of rows (keys, block, bits, few): in the set if in any of its rows."""
    dense = rows.where("bits is not null").select(*keys, "block", "bits")
    sparse = rows.where("few is not null").select(*keys, "block", F.explode("few").alias("place")).groupBy(*keys, "block").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return dense.unionByName(sparse).groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def common(rows: DataFrame, needed: str, *keys: str) -> DataFrame:
    """(keys, block, bits) of rows (keys, block, bits, needed): in the set if in all of its needed rows."""
    met = rows.groupBy(*keys, "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("__rows"), F.max(needed).alias("__needed"))
    return met.where("__rows = __needed").drop("__rows", "__needed")


def slabs(rows: DataFrame, slab_bits: int) -> DataFrame:
    """rows (..., block, bits) as (..., slab, n, bits): a row for each slab of 2^slab_bits documents that holds any."""
    size = 1 << (slab_bits - 3)
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << (BLOCK_BITS - slab_bits)) - 1))).alias("__at"))
    cut = each.withColumn("bits", F.substring("bits", F.col("__at") * size + 1, F.lit(size))).withColumn("n", F.bitmap_count("bits"))
    return cut.where("n > 0").withColumn("slab", F.shiftleft("block", BLOCK_BITS - slab_bits) + F.col("__at")).drop("block", "__at")


def documents(rows: DataFrame, slab_bits: int) -> DataFrame:
    """rows (..., slab, bits) as (..., doc)."""
    kept = [c for c in rows.columns if c not in ("slab", "bits")]
    schema = StructType([*[rows.schema[c] for c in kept], StructField("doc", LongType())])

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), SLABS):
                some = pdf.iloc[i : i + SLABS]
                held = np.unpackbits(np.frombuffer(b"".join(some.bits), np.uint8), bitorder="little").reshape(len(some), -1)
                row, place = np.nonzero(held)
                yield some[kept].iloc[row].assign(doc=(some.slab.to_numpy(np.int64)[row] << slab_bits) + place)

    return shipped(rows).mapInPandas(apart, schema)


def pairs_met(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """(a, b, n) of pairs (a, b) that any document of one block has both of, from the block's sets (term, bits, few)."""
    size, words = 1 << (BLOCK_BITS - 3), 1 << (BLOCK_BITS - 6)
    dense = sets.bits.notna().to_numpy()
    bits = np.frombuffer(b"".join(sets.bits[dense]), np.uint64).reshape(-1, words)
    places = np.concatenate([np.zeros(0, np.int64), *sets.few[~dense]]).astype(np.int64)
    lengths = np.array([len(f) for f in sets.few[~dense]], np.int64)
    ends = np.cumsum(lengths)
    row = np.where(dense, np.cumsum(dense) - 1, np.cumsum(~dense) - 1)  # of a term, among the dense or the others
    number = pd.Series(np.arange(len(sets)), index=sets.term.to_numpy())
    a, b = (number.reindex(pairs[c].to_numpy()).to_numpy() for c in ("a", "b"))
    kept = np.flatnonzero(~(np.isnan(a) | np.isnan(b)))
    kept = kept[np.argsort(a[kept], kind="stable")]
    a, b, n = a[kept].astype(np.int64), b[kept].astype(np.int64), np.zeros(len(kept), np.int64)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
        if dense[a[lo]]:
            mine = bits[row[a[lo]]]
        else:
            p = places[ends[row[a[lo]]] - lengths[row[a[lo]]] : ends[row[a[lo]]]]
            held = np.zeros(size, np.uint8)
            np.bitwise_or.at(held, p >> 3, (1 << (p & 7)).astype(np.uint8))
            mine = held.view(np.uint64)
        of = np.arange(lo, hi)
        many, few = of[dense[b[of]]], of[~dense[b[of]]]
        for k in range(0, len(many), 1024):  # 4 MB of bits
            n[many[k : k + 1024]] = np.bitwise_count(bits[row[b[many[k : k + 1024]]]] & mine).sum(axis=1)
        if len(few):
            r = row[b[few]]
            first = np.cumsum(lengths[r]) - lengths[r]
            at = places[np.arange(lengths[r].sum()) + np.repeat(ends[r] - lengths[r] - first, lengths[r])]
            n[few] = np.add.reduceat((mine.view(np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64), first)
    some = n > 0
    return pd.DataFrame({"a": pairs.a.to_numpy()[kept[some]], "b": pairs.b.to_numpy()[kept[some]], "n": n[some]})
