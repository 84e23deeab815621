"""Near duplicates by SimHash fingerprints found through deletion variants.

A fingerprint of 64 bits is cut into d // 2 + 1 segments; if two fingerprints differ in at most d bits, one of their segments
differs in at most one. Leaving out one bit of a segment gives a variant, and segments that differ in at most one bit share a
variant with that bit left out. So each distinct fingerprint is indexed under the variants of its segments, rows of equal
variants meet by an equality exchange, and each meeting is verified on all 64 bits.

Copies share a fingerprint and are indexed once. A variant that many fingerprints share is cut into pieces, and each pair of
pieces is one unit of work of bounded size; a unit gives the edges of a spanning forest of its links instead of all of them, so
a large group of near copies gives edges in proportion to its size. No link between two groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import keep_rows, worker_texts, written
from .graph import components
from .resemblance import resembling, row_keys

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of one variant that are compared in one piece.
PIECE = 2048
#: Groups up to this size are compared row against row all at once.
SMALL = 24


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit integer, from the shingles' hashes."""
    w = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(size, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):
        part = h[at : at + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": [fingerprint(t, size) for t in pdf.text]})

    return worker_texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, fp long")


def variants(fp: Column, bits: int = MAX_BITS) -> Column:
    """The one-wildcard variants of the segments, as integers that also name segment and wildcard."""
    count = bits // 2 + 1
    out, at = [], 0
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        segment = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else fp
        out.append(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), _without(segment, k * 64, width)))
        at += width
    return F.concat(*out)


def _without(segment: Column, tag: int, width: int) -> Callable[[Column], Column]:
    """position -> the segment without its bit there, and with tag and position, as one integer."""
    call = F.call_function

    def at(p: Column) -> Column:
        low = segment.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), p) - 1)
        rest = call("shiftleft", call("shiftrightunsigned", segment, p + 1), p).bitwiseOR(low)
        name = F.lit(tag).cast("long") + p
        return rest.bitwiseOR(call("shiftleft", name, F.lit(48))) if width < 48 else F.xxhash64(name, rest)

    return at


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= bits  # of a negative number numpy would count the absolute value


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among fps: breadth first, so what is reached is compared no more."""
    a, b, rest = [], [], fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            take, front = front[:64], front[64:]
            near = _near(take[:, None], rest[None, :], bits)
            hit = near.any(0)
            a.append(take[near[:, hit].argmax(0)])
            b.append(rest[hit])
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return a, b


def _edges(keys: np.ndarray, fps: np.ndarray, bits: int) -> pd.DataFrame:
    """Edges within runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    run = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for lag in range(1, SMALL):
        same = np.flatnonzero((run[lag:] == run[:-lag]) & (run[lag:] >= 0))
        if not len(same):
            break
        same = same[_near(fps[same], fps[same + lag], bits)]
        a.append(fps[same])
        b.append(fps[same + lag])
    for k in np.flatnonzero(sizes > SMALL).tolist():
        more = forest(np.unique(fps[starts[k] : starts[k] + sizes[k]]), bits)
        a += more[0]
        b += more[1]
    out = pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})
    return out[out.a != out.b].drop_duplicates()


def links(fps: DataFrame, bits: int = MAX_BITS, piece: int = PIECE) -> DataFrame:
    """(a, b): edges between distinct fingerprints fp that differ in at most bits bits. Their components are those of all such links."""
    fps = shipped(fps)
    index = fps.select("fp", F.explode(variants(F.col("fp"), bits)).alias("key"))
    w = Window.partitionBy("key")
    met = index.select("fp", "key", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("fp")) - 1).alias("at"))
    few = met.where((F.col("n") > 1) & (F.col("n") <= piece)).select("fp", F.col("key").alias("unit"))  # together and in order already
    mine = F.floor(F.col("at") / piece).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece).cast("int")))
    many = met.where(F.col("n") > piece).select("key", "fp", mine.alias("i"), other.alias("j"))
    many = many.select("fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("unit")).repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            keys, held = np.concatenate([keys, pdf.unit.to_numpy()]), np.concatenate([held, pdf.fp.to_numpy()])
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield _edges(keys[:last], held[:last], bits)
            keys, held = keys[last:], held[last:]
        if len(keys):
            yield _edges(keys, held, bits)

    return few.mapInPandas(run, "a long, b long").unionByName(many.mapInPandas(run, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each input row.

    A text without words, null or empty, has fingerprint 0 and links like any other. Texts of fewer words than a shingle are
    one shingle. Repeated rows agree in everything; null doc_ids never name a component unless it holds no other. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, bits))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(placed.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """docs with all its columns, one row of each component: that with the smallest doc_id (a null one only if
    it holds no other), of those that share it the one whose text's digest is smallest. Rows are told apart by id and text.

    Documents are near copies if their sets of shingles of size words have an intersection of similarity times their union or
    more. They meet as SimHash fingerprints of 1,280 bits through deletion variants of 64 segments, and each candidate is verified on the sets; see
    resemblance.py. (Four bits of 64 only reach copies that share nearly all shingles.)
    """
    rows = written(resembling(docs, similarity, size), "resembling")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("first"))
    return keep_rows(docs, first.select("first.doc_id", "first.sha"), row_keys(docs))
