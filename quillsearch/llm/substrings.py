"""Repeated passages by prefix-partitioned suffix trees over words.

The suffixes of the texts are dealt into groups by prefixes, a group's subtree is built in memory as its suffixes in order with the
depth at which neighbours part (the longest common prefix), and its internal nodes at a depth of at least WINDOW words are the
repeats: the leaves below such a node start with the same WINDOW words.

Which suffixes belong together must be told from the words alone. So in each window of WINDOW words one prefix position is marked:
the one whose PREFIX words hash lowest. Equal windows mark the same words, hence meet in the group of that prefix. Windows in a
row that mark one position travel as one stretch of text, and a prefix that only one document has is dropped before any text
travels: it can't lead to a repeat. Prefixes are as long as they need to be: the suffixes of a group that would outgrow memory are
dealt again by twice as many words of their own, and again until a group fits; suffixes that agree in all WINDOW words and are still too
many are one node, whose smallest doc_id is an aggregate.

Texts are cut and hashed once; they are written with their marks, dealt into blocks by a hash of the row, and read from there by the later
steps, which cut only what repeats. Equal stretches of a block travel once, so a passage that a third of
all documents share is as many rows as there are blocks; which words of which document it covers is worked out again in
the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bucketed
from .common import block_count, worker_texts, written

WINDOW = 50
PREFIX = 8
BLOCK_BYTES = 12 << 20
CHUNK_WORDS = 1 << 20
#: Bytes of stretches whose subtrees are built together; more of one prefix are dealt again.
GROUP_BYTES = 6 << 20
#: Files that the texts are dealt to, at most; each holds whole blocks.
MOST_BUCKETS = 20_000
NO_ID = np.iinfo(np.int64).max


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def stretches(cut: list[list[bytes]], known: Hashes, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some texts, in runs that mark one position: the text, the first window's start, how many windows,
    and the hash of the marked prefix."""
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    w = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
    n = len(w)
    spans = window - prefix + 1
    n_windows = np.maximum(sizes - window + 1, 0)
    if not n_windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = np.zeros(n, np.uint64)
    for k in range(prefix):
        h[: n - k] = (h[: n - k] ^ w[k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = h >> np.uint64(28) << np.uint64(28) | np.arange(n, dtype=np.uint64)  # the leftmost among equals
    least, width = order.copy(), 1
    while width < spans:
        step = min(width, spans - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(cut)), n_windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    mark = (least[first[doc] + start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])])
    return doc[new], start[new], np.diff(np.r_[new, len(doc)]), h[mark[new]].view(np.int64)


def parts(texts: list[str]) -> Iterator[tuple[slice, list[list[bytes]]]]:
    """Consecutive texts cut into words, about CHUNK_WORDS at a time."""
    start, total, cut = 0, 0, []
    for i, t in enumerate(texts):
        cut.append(t.encode().split())
        total += len(cut[-1])
        if total >= CHUNK_WORDS:
            yield slice(start, i + 1), cut
            start, total, cut = i + 1, 0, []
    if cut:
        yield slice(start, len(texts)), cut


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    """A null id is no source for others: larger than all."""
    return pdf.doc_id.astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def marks(pdf: pd.DataFrame, window: int, prefix: int) -> pd.DataFrame:
    """The rows with their stretches packed: places (of each the first window's start and how many windows, 32 bits each) and keys."""
    known, places, keys = Hashes(), [], []
    for _, cut in parts(pdf.text.tolist()):
        doc, start, count, key = stretches(cut, known, window, prefix)
        ends = np.searchsorted(doc, np.arange(len(cut) + 1)).tolist()
        place, name = np.stack([start, count], axis=1).astype("<i4").tobytes(), key.astype("<i8").tobytes()
        places += [place[8 * a : 8 * b] for a, b in zip(ends, ends[1:])]
        keys += [name[8 * a : 8 * b] for a, b in zip(ends, ends[1:])]
    return pdf.assign(places=pd.Series(places, pdf.index, object), keys=pd.Series(keys, pdf.index, object))


def owned(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys as one array, and the row of each."""
    return np.frombuffer(b"".join(keys), "<i8"), np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)) // 8)


def used(pdf: pd.DataFrame, wanted: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Each row that has stretches of the wanted keys (in order), and those: start, count, key."""
    if not len(wanted) or not len(pdf):
        return
    key, row = owned(pdf["keys"])
    place = np.frombuffer(b"".join(pdf.places), "<i4").reshape(-1, 2)
    use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
    row, found = row[use], list(zip(*place[use].T.tolist(), key[use].tolist()))
    edges = [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
    for a, b in zip(edges, edges[1:]):
        yield int(row[a]), found[a:b]


def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The marked prefixes of some rows by block, with the smallest and the largest doc_id that have them."""
    key, row = owned(pdf["keys"])
    ids = _ids(pdf)[row]
    found = pd.DataFrame({"block": pdf.block.to_numpy()[row], "key": key, "lo": ids, "hi": ids})
    return found.groupby(["block", "key"], as_index=False, sort=False).agg({"lo": "min", "hi": "max"})


def block_stretches(pdf: pd.DataFrame, repeated: pd.DataFrame, window: int) -> pd.DataFrame:
    """The distinct stretches of a block that mark a repeated prefix, with the smallest and the largest doc_id."""
    ids, texts = _ids(pdf).tolist(), pdf.text.tolist()
    found: dict[bytes, list] = {}
    for d, places in used(pdf, np.sort(repeated.key.to_numpy(np.int64))):
        words, i = texts[d].encode().split(), ids[d]
        for s, c, k in places:
            text = b" ".join(words[s : s + c + window - 1])
            if (row := found.get(text)) is None:
                found[text] = [k, i, i]
            else:
                row[1], row[2] = min(row[1], i), max(row[2], i)
    block = int(pdf.block.iloc[0]) if len(pdf) else 0
    return pd.DataFrame([(block, r[0], t, r[1], r[2]) for t, r in found.items()], columns=["block", "key", "stretch", "lo", "hi"])


def subtree(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of some rows as arrays: the suffixes in the order of their words, the words that each shares with the one before
    it, and of each suffix its row and its length. Suffixes are ranked by 1, 2, 4, ... words, a rank of 2 k words from two of k; the same
    ranks tell how far neighbours agree."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    rank = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum())) + 1
    n = len(rank)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    ranks, depth = [rank], 1
    while depth < int(sizes.max(initial=0)):
        then = np.zeros(n, np.int64)  # a suffix that ends comes first
        more = np.flatnonzero(left > depth)
        then[more] = rank[more + depth]
        names, rank = np.unique(rank * (n + 1) + then, return_inverse=True)
        rank = rank + 1
        ranks.append(rank)
        depth *= 2
        if len(names) == n:
            break
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    most, shared = np.minimum(left[a], left[b]), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        on = np.flatnonzero(shared < most)
        on = on[ranks[k][a[on]] == ranks[k][b[on]]]
        shared[on] += 1 << k
        on = on[shared[on] < most[on]]
        a[on] += 1 << k
        b[on] += 1 << k
    return order, np.r_[0, np.minimum(shared, most)][:n], np.repeat(np.arange(len(rows)), sizes), left


def deep_nodes(order: np.ndarray, shared: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest nodes of at least window words: the suffixes of that length in order, and where the leaves of each node start."""
    new = shared < window
    node = np.cumsum(new) - 1
    long = left[order] >= window
    leaves, node = order[long], node[long]
    return leaves, np.flatnonzero(np.diff(node, prepend=-1))


def group_repeats(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Of each stretch of a group that needs it: the smallest doc_id below the node of each of its windows."""
    rows = [t.split(b" ") for t in pdf.stretch]
    lo, hi = pdf.lo.to_numpy(np.int64), pdf.hi.to_numpy(np.int64)
    order, shared, row, left = subtree(rows)
    leaves, starts = deep_nodes(order, shared, left, window)
    least = np.repeat(np.minimum.reduceat(lo[row[leaves]], starts), np.diff(np.r_[starts, len(leaves)])) if len(leaves) else lo[:0]
    first = np.full(len(order), NO_ID)
    first[leaves] = least
    first = first[left >= window]
    counts = np.bincount(row[left >= window], minlength=len(rows))
    cut = np.split(first, np.cumsum(counts)[:-1])
    use = [k for k, x in enumerate(cut) if (x < hi[k]).any()]
    return pd.DataFrame({"block": pdf.block.iloc[use].to_numpy(), "mark": pdf.mark.iloc[use].to_numpy(), "name": pdf.name_.iloc[use].to_numpy(), "at": pdf["at"].iloc[use].to_numpy(), "first": pd.Series([cut[k] for k in use], dtype=object)})


def maximal_repeats(texts: list[str], window: int = WINDOW) -> list[tuple[str, int]]:
    """The repeats of some texts that are held in memory, from their tree: the longest run of words that all leaves below a node of at
    least window words share, and how many there are; a run whose leaves all follow one word is part of a longer repeat and left out."""
    rows = [t.encode().split() for t in texts]
    order, shared, row, left = subtree(rows)
    leaves, starts = deep_nodes(order, shared, left, window)
    flat, place, out = [w for r in rows for w in r], np.empty(len(order), np.int64), []
    place[order] = np.arange(len(order))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(leaves)]):
        if b - a > 1:
            depth = int(shared[place[leaves[a + 1]] : place[leaves[b - 1]] + 1].min())
            before = {flat[i - 1] if i and row[i - 1] == row[i] else i for i in leaves[a:b].tolist()}
            if len(before) > 1 or not isinstance(next(iter(before)), bytes):
                out.append((b" ".join(flat[leaves[a] : leaves[a] + depth]).decode(), b - a))
    return out


def named(stretch: bytes) -> bytes:
    return xxhash.xxh128_digest(stretch)


def block_removed(pdf: pd.DataFrame, table: pd.DataFrame, window: int, with_spans: bool) -> pd.DataFrame:
    ids, texts = _ids(pdf).tolist(), pdf.text.tolist()
    firsts: dict[bytes, list] = {}
    for name, at, first in zip(table.name, table["at"], table["first"]):
        firsts.setdefault(bytes(name), []).append((at, np.asarray(first, np.int64)))
    repeated = dict(used(pdf, np.unique(table.mark.to_numpy(np.int64))))  # other prefixes have no repeats
    out = []
    for d, text in enumerate(texts):
        words = kept = text.encode().split()
        g = np.zeros(0, bool)
        if d in repeated and ids[d] != NO_ID:
            edge = np.zeros(len(words) + 1, np.int64)
            for s, c, _ in repeated[d]:
                for at, first in firsts.get(named(b" ".join(words[s : s + c + window - 1])), ()):
                    hit = np.flatnonzero(first < ids[d]) + (s + at)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
            g = np.cumsum(edge)[:-1] > 0
            kept = [w for w, x in zip(words, g.tolist()) if not x]
        whole = b" ".join(kept)
        row = (pdf.doc_id.iloc[d], len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest())
        if with_spans:
            e = np.flatnonzero(np.diff(np.r_[False, g, False])).reshape(-1, 2)
            row += (whole.decode(), [{"start": a, "stop": b} for a, b in e.tolist()])
        out.append(row)
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "spans"] * with_spans).astype({"doc_id": "Int64"})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, with_spans: bool = False, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the text left) and spans (the repeats removed, maximal):
    one row for each input row.

    A word goes if a window over it also starts in a document with a smaller doc_id, as the input stands. A null or empty text
    has no words; a null doc_id neither loses words nor makes others lose them; rows that share a doc_id don't make each
    other lose words. Texts are read whole; an empty table gives an empty result; other columns are ignored.
    """
    rows = worker_texts(docs, id_col, text_col)
    n_blocks = block_count(rows, block_bytes=block_bytes)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))  # rows of one id or none spread out
    n_buckets = min(n_blocks, MOST_BUCKETS)

    def each(of):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield of(pdf)

        return run

    packed = rows.mapInPandas(each(lambda pdf: marks(pdf, window, prefix)), "doc_id long, text string, block int, places binary, keys binary")
    rows = bucketed(packed, "marked_texts", "block", n_buckets, exact=True)  # texts are dealt once; what meets them is dealt likewise
    marked = rows.select("block", "doc_id", "keys").mapInPandas(each(prefixes), "block int, key long, lo long, hi long")
    key = Window.partitionBy("key")
    repeated = marked.select("block", "key", F.min("lo").over(key).alias("lo"), F.max("hi").over(key).alias("hi")).where("lo < hi").select("block", "key")
    found = rows.groupBy("block").cogroup(repeated.repartition(n_buckets, "block").groupBy("block")).applyInPandas(lambda a, b: block_stretches(a, b, window), "block int, key long, stretch binary, lo long, hi long")
    found = written(found, "stretches")
    size = F.octet_length("stretch") + 16
    total = found.agg(F.sum(size)).first()[0] or 0
    n_groups = max(1, -(-int(total) // group_bytes))
    large = found.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > group_bytes).select("key")
    large = written(large, "long-prefixes")

    lengths = [p for p in (prefix << k for k in range(8)) if p < window]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(name_=[named(t) for t in pdf.stretch], at=0, mark=pdf.key)[["block", "name_", "at", "stretch", "lo", "hi", "key", "mark"]]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each window, with hashes of its first words."""
        digest = lambda w: xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63)
        for pdf in batches:
            for r in pdf.itertuples():
                w, name = r.stretch.split(b" "), named(r.stretch)
                each = [w[i : i + window] for i in range(len(w) - window + 1)]
                yield pd.DataFrame({"block": r.block, "name_": name, "at": range(len(each)), "stretch": [b" ".join(x) for x in each], "lo": r.lo, "hi": r.hi, "mark": r.key, "starts": [[digest(x[:p]) for p in lengths] for x in each]})

    schema = "block int, name_ binary, at int, stretch binary, lo long, hi long, key long, mark long"
    firsts_of = lambda df: df.groupBy(F.pmod("key", F.lit(n_groups)).alias("group")).applyInPandas(lambda pdf: group_repeats(pdf, window), "block int, mark long, name binary, at int, first array<long>")
    if large.isEmpty():
        firsts = firsts_of(found.mapInPandas(whole, schema))
    else:
        dealt = found.join(large, "key", "left_anti").select(*found.columns).mapInPandas(whole, schema)
        rest = written(found.join(large, "key", "left_semi").select(*found.columns).mapInPandas(windows, schema.replace("key long, ", "") + ", starts array<long>"), "long-windows")
        for k in range(1, len(lengths)):  # by as many words as it takes
            keyed = rest.withColumn("key", F.get("starts", k))
            fits = written(keyed.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") <= group_bytes).select("key"), "fitting-prefixes")
            dealt = dealt.unionByName(keyed.join(fits, "key", "left_semi").drop("starts"))
            rest = written(keyed.join(fits, "key", "left_anti").drop("key"), "longer-prefixes")
        least = rest.groupBy("stretch").agg(F.min("lo").alias("first"))
        one_node = rest.join(least, "stretch").where("first < hi").select("block", "mark", F.col("name_").alias("name"), "at", F.array("first").alias("first"))
        firsts = firsts_of(dealt).unionByName(one_node)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, spans array<struct<start: long, stop: long>>" if with_spans else "")
    return rows.groupBy("block").cogroup(firsts.repartition(n_buckets, "block").groupBy("block")).applyInPandas(lambda a, b: block_removed(a, b, window, with_spans), schema)
