"""Near copies by the resemblance of their shingle sets: met through deletion variants of SimHash fingerprints, verified on the sets.

A text's set is that of its runs of size words, as 64-bit hashes. Its fingerprint has SEGMENTS segments of 2 * HALF bits; a bit is 1 if
it is set in over half of the hashes' mixings. At a resemblance of 0.8 (shared shingles by all shingles) a bit differs with probability
0.15, so a segment differs in one bit at most with 0.171, and a pair of all SEGMENTS stays unmet in 6 of a million cases, fewer above.
Sets of less than some 20 shingles are rougher: of 4 against 5 of them a bit differs with 0.19, and 27 of 10,000 such pairs stay unmet.

Segments that differ in one bit at most share a variant with that bit left out, and have one half in common. So rows are dealt by segment
and half, and the variants of the other half are made and met where the rows lie, which moves two rows a segment instead of one a
variant. What meets and differs in few bits of the fingerprint's first WORDS words is a candidate. Candidates' components hold all
candidates' links, so a task gives the edges of a star for each component of its own. The first FIRST segments find most of a large group; over the others
its rows go under its name, and only what joins groups is given.

A component of candidates is one unit of work; one of more than PIECE nodes is cut into pieces, and each pair of pieces is a unit. Texts of
equal sets are one node. A unit holds its nodes' sets and gives the edges of a spanning forest of its links: a link is an intersection
of the similarity times the union or more, and only a verified link makes a node reached, so that components are those of all links,
whatever a group's size, and a large group of near copies gives edges in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import joined_key, written
from .graph import components

SEGMENTS, HALF = 64, 10
#: Segments that are met first, to name large groups.
FIRST = 8
#: Words of 64 bits that tell candidates among what meets.
WORDS = 4
#: Nodes of one group that are verified in one piece.
PIECE = 1024
#: Rows of one segment and half that are met in one piece.
MEET = 1 << 17
#: Rows of several halves that are met at once.
CHUNK = 1 << 16
#: Rows of one variant up to which all pairs are compared at once.
SMALL = 64
SEED = 42
_LANES = np.arange(SEGMENTS * 2 * HALF // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingles' hashes in rising order; a text of fewer words is one shingle, one without words has none."""
    w = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - size + 1)
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(size, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def fingerprint(shingles: np.ndarray) -> bytes:
    """SEGMENTS segments of 2 * HALF bits each; none of an empty set."""
    if not len(shingles):
        return b""
    ones = np.zeros(64 * len(_LANES), np.int64)
    for at in range(0, len(shingles), 255):  # so many are counted in a byte
        x = shingles[at : at + 255, None] + _LANES
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def bit_limit(similarity: float) -> int:
    """In how many bits of WORDS words candidates differ at most: 5.5 deviations over the mean at the similarity."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WORDS
    return math.ceil(n * p + 5.5 * math.sqrt(n * p * (1 - p)))


def dealt(prints: list[bytes], ids: np.ndarray, segments: range) -> np.ndarray:
    """A row for each segment and half of each fingerprint: key (segment, half, its value, the other half's value), id, words."""
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    halves = np.unpackbits(raw, axis=1).reshape(len(raw), 2 * SEGMENTS, HALF) @ (1 << np.arange(HALF))
    name = np.arange(2 * segments.start, 2 * segments.stop)
    key = ((name << HALF | halves[:, name]) << 36 + HALF) | halves[:, name ^ 1]  # 36 bits between them are for pieces
    rest = np.column_stack([ids, raw[:, : 8 * WORDS].copy().view("<i8")])
    return np.column_stack([key.ravel(), np.repeat(rest, len(name), 0)])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least member of each one's component, once a and b are linked."""
    while len(a):
        x, y = label[a], label[b]
        a, b, x, y = (z[x != y] for z in (a, b, x, y))
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _swept(rows: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the candidates among rows: breadth first, so what is reached is compared no more."""
    a, b, rest = [], [], rows
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            take, front = front[:8], front[8:]
            near = np.bitwise_count(words[take][:, None] ^ words[rest][None]).sum(2, dtype=np.int64) <= limit
            hit = near.any(0)
            a.append(take[near[:, hit].argmax(0)])
            b.append(rest[hit])
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (rows[:0], rows[:0])


def candidates(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least id, id) of the components of candidates among dealt rows, in order of their keys; rows of one id are linked."""
    ids, at = np.unique(rows[:, 1], return_inverse=True)
    label, words = np.arange(len(ids)), np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
    for bit in range(HALF):
        variant = rows[:, 0] & ~(1 << bit)
        order = np.argsort(variant, kind="stable")
        variant = variant[order]
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        sizes = np.diff(np.r_[starts, len(variant)])
        left = np.repeat(np.where(sizes <= SMALL, starts + sizes, 0), sizes)  # where the row's run ends
        here, lag = np.arange(len(variant)), 1
        while len(here := here[here + lag < left[here]]):
            x, y = order[here], order[here + lag]
            apart = label[at[x]] != label[at[y]]
            x, y = x[apart], y[apart]
            near = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64) <= limit
            label, lag = _joined(label, at[x[near]], at[y[near]]), lag + 1
        for k in np.flatnonzero(sizes > SMALL).tolist():
            run = order[starts[k] : starts[k] + sizes[k]]
            if (label[at[run]] != label[at[run[0]]]).any():
                x, y = _swept(run, words, limit)
                label = _joined(label, at[x], at[y])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[moved]], ids[moved]


def meetings(prints: DataFrame, segments: range, similarity: float, meet: int = MEET) -> DataFrame:
    """(a, b): edges between ids of prints (id, print) whose components are those of all candidates that meet in a segment."""
    limit = bit_limit(similarity)
    columns = ["key", "id", *[f"w{k}" for k in range(WORDS)]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                yield dealt(part["print"].tolist(), part["id"].to_numpy(np.int64), segments)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in blocks(batches):
            yield pd.DataFrame(rows, columns=columns)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(2 * SEGMENTS << HALF, np.int64)
        for rows in blocks(batches):
            sums += np.bincount(rows[:, 0] >> 36 + HALF, minlength=len(sums))
        units = np.flatnonzero(sums)
        yield pd.DataFrame({"unit": units, "n": sums[units]})

    unit = F.shiftright("key", 36 + HALF)
    large = prints.mapInPandas(counted, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") > meet)  # of 2 ** 17 at most
    rows = prints.mapInPandas(spread, ", ".join(f"{c} long" for c in columns)).withColumn("unit", unit).join(F.broadcast(large), "unit", "left")
    pieces = F.ceil(F.col("n") / meet).cast("long")
    mine = F.pmod(F.xxhash64(*columns[1:]), pieces)
    other = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), pieces - 1))
    rows = rows.select(*columns, F.coalesce(mine, F.lit(0)).cast("long").alias("i"), F.explode(other).alias("j")).where("i <> j")
    pair = F.when(F.col("j") < 0, F.lit(0).cast("long")).otherwise(F.shiftleft(F.least("i", "j"), 18).bitwiseOR(F.greatest("i", "j")))
    rows = rows.withColumn("key", F.col("key").bitwiseOR(F.shiftleft(pair, HALF))).select(*columns)
    rows = rows.repartition(F.shiftright("key", HALF)).sortWithinPartitions("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def new(rows: np.ndarray) -> pd.DataFrame:
            edges = [e for e in zip(*(x.tolist() for x in candidates(rows, limit))) if e not in seen]
            seen.update(edges)
            return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

        for pdf in batches:
            held.append(pdf.to_numpy(np.int64))
            size += len(pdf)
            if size >= CHUNK:
                rows = np.concatenate(held)
                last = int(np.searchsorted(rows[:, 0], rows[-1, 0] >> HALF << HALF))
                if last:
                    yield new(rows[:last])
                held, size = [rows[last:]], len(rows) - last
        if size:
            yield new(np.concatenate(held))

    return rows.mapInPandas(run, "a long, b long").distinct()


def candidate_groups(prints: DataFrame, similarity: float, meet: int = MEET) -> DataFrame:
    """(node, root) for each node of prints (node, print) that has a candidate: the components of candidates."""
    named = prints.select(F.col("node").alias("id"), "print")
    first = components(meetings(named, range(FIRST), similarity, meet))
    again = written(prints.join(first, "node", "left").select(F.coalesce("root", "node").alias("id"), "print"), "named-prints")
    more = meetings(again, range(FIRST, SEGMENTS), similarity, meet)
    return components(more.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def verified(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct nodes: breadth first, so what is reached is compared no more."""
    n, sizes = len(nodes), np.fromiter(map(len, sets), np.int64, len(sets))
    enough = lambda both, x, y: (both > 0) & (both >= similarity * (x + y - both) - 1e-9)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return ([int(nodes[0])], [int(nodes[1])]) if enough(both, sizes[0], sizes[1]) else ([], [])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # shingles of one node alone are in no intersection
    name, owner = (np.cumsum(shared) - 1)[name[shared[name]]], owner[shared[name]]
    bits = np.zeros((n, 8 * max(1, -(-int(shared.sum()) // 64))), np.uint8)
    np.bitwise_or.at(bits, (owner, name >> 3), (1 << (name & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    a, b, rest = [], [], np.arange(1, n)
    front = [0]
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
            continue
        x = front.pop()
        at = rest[(sizes[rest] >= similarity * sizes[x] - 1e-9) & (sizes[x] >= similarity * sizes[rest] - 1e-9)]
        both = np.concatenate([np.bitwise_count(bits[at[k : k + 64]] & bits[x]).sum(1, dtype=np.int64) for k in range(0, len(at), 64)] or [np.zeros(0, np.int64)])
        hit = at[enough(both, sizes[x], sizes[at])]
        a += [int(nodes[x])] * len(hit)
        b += nodes[hit].tolist()
        front += hit.tolist()
        rest = np.setdiff1d(rest, hit, assume_unique=True)
    return a, b


def _units(groups: DataFrame, piece: int) -> DataFrame:
    """(unit, node): what is verified together, of the components (node, root) of candidates."""
    large = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > piece)
    met = groups.join(F.broadcast(large), "root", "left")
    few = met.where("n is null").select(F.col("root").alias("unit"), "node")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    many = met.where("n is not null").select("root", "node", F.pmod(F.xxhash64("node"), pieces).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("j")).where("i <> j")
    return few.unionByName(many.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), "node"))


def links(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified edges between nodes; their components are those of all pairs that share a unit and are similar."""
    rows = units.join(sets, "node").repartition("unit").sortWithinPartitions("unit")

    def edges(unit: list[tuple[int, bytes]]) -> tuple[list[int], list[int]]:
        held = dict(unit)
        return verified(np.array(list(held), np.int64), [np.frombuffer(s, np.uint64) for s in held.values()], similarity) if len(held) > 1 else ([], [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, unit = None, []
        for pdf in batches:
            a, b = [], []
            for k, node, s in zip(pdf.unit.tolist(), pdf.node.tolist(), pdf.shingles):
                if k != key and unit:
                    more = edges(unit)
                    a, b, unit = a + more[0], b + more[1], []
                key = k
                unit.append((node, s))
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
        a, b = edges(unit) if unit else ([], [])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.mapInPandas(run, "a long, b long").distinct()


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What names a row: its id and its whole text. Rows that agree in both are copies."""
    return {"doc_id": docs[id_col].cast("long"), "sha": F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)}


def resembling(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, sha, component: one row for each input row, sha that of its text. Texts without words are one component, a null text is an
    empty one; an empty table gives an empty result; other columns are ignored."""
    named = shipped(docs).select(*[c.alias(k) for k, c in row_keys(docs, id_col, text_col).items()], F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, size) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "sha": pdf.sha, "digest": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "print": [fingerprint(s) for s in sets]})

    rows = written(named.mapInPandas(signed, "doc_id long, sha string, digest binary, print binary"), "signatures")
    alike = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "sha")).alias("first"), F.min("print").alias("print"))
    distinct = written(alike.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    groups = candidate_groups(distinct.where(F.octet_length("print") > 0).select("node", "print"), similarity)
    units = written(_units(groups, piece), "units")
    asked = distinct.join(units.select("node").distinct(), "node", "left_semi").select("node", joined_key(F.col("first.doc_id"), F.col("first.sha")).alias("__key"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf.node, "shingles": [shingle_set(t, size).tobytes() for t in pdf.text]})

    texts = named.select(joined_key(F.col("doc_id"), F.col("sha")).alias("__key"), "text").join(asked, "__key").dropDuplicates(["__key"])
    sets = texts.select("node", "text").mapInPandas(read, "node long, shingles binary")
    roots = components(links(units, sets, similarity))
    placed = distinct.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    return rows.join(placed, "digest").select("doc_id", "sha", "component")
