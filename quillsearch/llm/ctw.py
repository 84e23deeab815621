"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z) and written as its words with one space between them and a line feed at its end. A byte is eight
binary decisions, each in the context of the decisions before it in its byte and of the DEPTH bytes before that. Each node
of the context tree holds a Krichevsky-Trofimov estimator of its decision, and the estimators along a path are mixed by the
posterior weights of context-tree weighting: P_w = 1/2 P_kt + 1/2 product of P_w of the children. The counts are those of the
training texts and stay as they are while texts are scored, so a byte's probability depends on its gram alone (DEPTH bytes
and itself) and is computed once for each gram that occurs.

Texts are dealt into blocks by a hash of the row, once, and each block to a task of its own. A block's distinct grams leave it packed, one row for each context of
three bytes, and come back with their probabilities; no model of the corpus is ever held in one place. Below three bytes of
context the tree is cut by those bytes: a context has 2 ** 24 distinct grams at most at DEPTH 5, and one that many blocks share is
merged in parts and answered in parts. The nodes of two bytes are summed by DataFrame aggregates; only those of depth 0 and 1, of
which there are at most 256 * 255 + 255, pass through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import block_count, give_back, worker_texts, written

DEPTH = 5
#: Bytes of context by which the tree is cut.
CUT = 3
BLOCK_BYTES = 24 << 20
CHUNK_BYTES = 1 << 20
#: Packed grams that one task holds; a context with more of them in all blocks is merged and answered in parts.
BUCKET_BYTES = 12 << 20
#: Words of a block that leave a task at a time.
WORDS = 1 << 16
END = b"\n"
HALF = math.log(0.5)
TABLE = 1 << 16
COUNTS = pa.schema({"block": pa.int32(), "three": pa.int64(), "keys": pa.binary(), "held": pa.binary(), "word": pa.binary(), "n": pa.int64()})
SCORES = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "bits_per_byte": pa.float64()})


def spelled(text: str) -> list[bytes]:
    return text.encode().lower().split()


def is_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def grams(streams: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The gram of each byte of each stream, as an integer: from the top the three bytes before it (the farthest first), those
    before them (the nearest first), itself. Before a stream stand line feeds."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    data = np.frombuffer(b"".join(END * depth + s for s in streams), np.uint8).astype(np.int64)
    n = max(len(data) - depth, 0)
    out = np.zeros(n, np.int64)
    for k in [*range(CUT, 0, -1), *range(CUT + 1, depth + 1), 0]:
        out <<= 8
        out |= data[depth - k : depth - k + n]
    ahead = np.cumsum(sizes + depth)[:-1]  # where the next stream's line feeds start
    skip = np.zeros(n, bool)
    for k in range(depth):
        skip[ahead + k - depth] = True
    return out[~skip]


def parts(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of so many rows at a time as have CHUNK_BYTES; the others stay in Arrow's memory."""
    start, total = 0, 0
    for i, size in enumerate(pc.binary_length(rows.column("text")).to_pylist()):
        total += size
        if total >= CHUNK_BYTES or i + 1 == len(rows):
            part = rows.slice(start, i + 1 - start)
            yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            start, total = i + 1, 0


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """Columns of the schema that are not given are null."""
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in rising order and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts[order], starts)


class Tally:
    """Distinct keys and the sums of their counts. Runs of keys are merged as they come, so that each is at most half of the one before."""

    def __init__(self):
        self.runs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def merge(self) -> None:
        (a, n), (b, m) = self.runs.pop(), self.runs.pop()
        self.runs.append(summed(np.concatenate([a, b]), np.concatenate([n, m])))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            self.merge()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.runs) > 1:
            self.merge()
        return self.runs[0]


def packed(code: np.ndarray, values: np.ndarray, kind: str, depth: int) -> pd.DataFrame:
    """A row for each context of three bytes of the sorted grams: three, keys (the grams' other bytes), values."""
    width = 8 * (depth - CUT + 1)
    three = code >> width
    starts = np.flatnonzero(np.r_[True, three[1:] != three[:-1]]) if len(code) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(code)].tolist()
    keys, held = (code & ((1 << width) - 1)).astype("<u4").tobytes(), values.astype(kind)
    size, held = held.itemsize, held.tobytes()
    cuts = list(zip(starts.tolist(), ends))
    return pd.DataFrame({"three": three[starts], "keys": [keys[4 * a : 4 * b] for a, b in cuts], "held": [held[size * a : size * b] for a, b in cuts]})


def unpacked(rows: pd.DataFrame, depth: int) -> np.ndarray:
    """The grams of packed rows, in the rows' order."""
    keys = np.frombuffer(b"".join(rows["keys"]), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, rows["keys"]), np.int64, len(rows)) >> 2
    return np.repeat(rows.three.to_numpy(np.int64) << 8 * (depth - CUT + 1), sizes) | keys


def block_counts(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Of one block: its distinct grams, packed, and its words, and how often its training texts have them. The task holds these and
    a chunk of texts, spelled; the words leave it in pieces."""
    give_back()
    counted: Counter[bytes] = Counter()
    tally, block = Tally(), 0
    for rows in batches:
        block = rows.column("block")[0].as_py()
        for ids, texts in parts(rows):
            streams: list[list[bytes]] = [[], []]
            for doc_id, text in zip(ids, texts):
                w, learn = spelled(text), is_training(doc_id)
                counted.update(w if learn else dict.fromkeys(w, 0))
                streams[learn].append(b" ".join(w) + END)
            for learn in (0, 1):
                if streams[learn]:
                    u, n = np.unique(grams(streams[learn], depth), return_counts=True)
                    tally.add(u, n * learn)
    packs = packed(*tally.all(), "<u4", depth)
    del tally
    yield batch(COUNTS, {"block": np.full(len(packs), block), "three": packs.three.to_numpy(), "keys": packs["keys"].tolist(), "held": packs.held.tolist()})
    del packs
    words = iter(counted.items())
    while piece := list(islice(words, WORDS)):
        yield batch(COUNTS, {"block": np.full(len(piece), block), "word": [w for w, _ in piece], "n": [n for _, n in piece]})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma(x) for x > 0: Stirling's series from x + 8."""
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return out - np.log(np.multiply.reduce([x + k for k in range(8)]))


_whole = np.arange(TABLE, dtype=np.float64)
_GAMMA = {0.5: log_gamma(_whole + 0.5), 1.0: log_gamma(_whole + 1.0)}


def log_gamma_at(n: np.ndarray, more: float) -> np.ndarray:
    """log gamma(n + more) of counts n, from a table where they are small."""
    out = _GAMMA[more][np.minimum(n, TABLE - 1)]
    large = np.flatnonzero(n >= TABLE)
    out[large] = log_gamma(n[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma_at(zeros, 0.5) + log_gamma_at(ones, 0.5) - math.log(math.pi) - log_gamma_at(zeros + ones, 1.0)


def levels(code: np.ndarray, n: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From depth up to CUT: the distinct (context, byte) of that depth in rising order, their counts, and for each one of
    the depth below its place among them."""
    out = [(code, n, np.zeros(0, np.int64))]
    for _ in range(depth - CUT):
        below, count, _ = out[-1]
        keys, where = np.unique(below >> 16 << 8 | below & 255, return_inverse=True)
        out.append((keys, np.bincount(where, count, len(keys)).astype(np.int64), where))
    return out


class Nodes:
    """The nodes of one depth that take decision number nth of a byte, over sorted (context, byte) entries."""

    def __init__(self, entries: np.ndarray, n: np.ndarray, nth: int, below: Nodes | None = None, place: np.ndarray | None = None):
        path = entries >> (8 - nth)
        new = np.r_[True, path[1:] != path[:-1]]
        self.starts, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        self.ones = np.add.reduceat(n * (entries >> (7 - nth) & 1), self.starts)
        self.total = np.add.reduceat(n, self.starts)
        self.pe = log_kt(self.total - self.ones, self.ones)
        self.pw = self.pe
        if below is not None:
            self.pw = np.logaddexp(HALF + self.pe, HALF + np.bincount(self.of[place[below.starts]], below.pw, len(self.starts)))

    @property
    def own(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.total + 1.0)

    @property
    def weight(self) -> np.ndarray:
        return np.exp(HALF + self.pe - self.pw)


def columns(chain_: list[tuple[np.ndarray, np.ndarray, np.ndarray]], nth: int) -> list[Nodes]:
    out: list[Nodes] = []
    for entries, n, place in chain_:
        out.append(Nodes(entries, n, nth, out[-1] if out else None, place))
    return out


def two_keys(entries: np.ndarray, nth: int) -> np.ndarray:
    """Two bytes of context and the path of the decisions before the nth, of (three bytes, byte) entries."""
    return (entries >> 8 & 0xFFFF) << 8 | 1 << nth | (entries & 255) >> (8 - nth)


def two_nodes(code: np.ndarray, n: np.ndarray, depth: int) -> pd.DataFrame:
    """Sums over the nodes of depth three, by two bytes of context and path: key, zeros, ones, pw."""
    chain_, out = levels(code, n, depth), []
    entries = chain_[-1][0]
    for nth in range(8):
        top = columns(chain_, nth)[-1]
        key, where = np.unique(two_keys(entries[top.starts], nth), return_inverse=True)
        add = lambda x: np.bincount(where, x, len(key))  # noqa: E731, B023
        out.append(pd.DataFrame({"key": key, "zeros": add(top.total - top.ones), "ones": add(top.ones), "pw": add(top.pw)}))
    return pd.concat(out)


def log_probabilities(code: np.ndarray, n: np.ndarray, depth: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte. key, a, b: of two bytes of context and a path, in rising order, how depths 2, 1 and 0
    turn the probability q of a one at depth three into a + b * q."""
    chain_ = levels(code, n, depth)
    entries, out = chain_[-1][0], np.zeros(len(code))
    for nth in range(8):
        nodes = columns(chain_, nth)
        q, at = nodes[0].own[nodes[0].of], np.arange(len(code))
        for level, (_, _, place) in zip(nodes[1:], chain_[1:]):
            at = place[at]
            w = level.weight[level.of[at]]
            q = w * level.own[level.of[at]] + (1 - w) * q
        top = nodes[-1]
        found = np.searchsorted(key, two_keys(entries[top.starts], nth))[top.of[at]]
        q = a[found] + b[found] * q
        out += np.log10(np.where(code >> (7 - nth) & 1, q, 1 - q))
    return out


def upper(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The nodes of depth 1 and 0, from the sums over their children of depth 2: for each context of one byte and path, how
    these depths turn the probability q of a one at depth two into a + b * q."""
    rows = rows.sort_values("key")
    key = rows.key.to_numpy(np.int64)  # byte * 256 + path
    zeros, ones, below = rows.zeros.to_numpy(np.int64), rows.ones.to_numpy(np.int64), rows.pw.to_numpy(np.float64)
    pe = log_kt(zeros, ones)
    pw = np.logaddexp(HALF + pe, HALF + below)
    w, own = np.exp(HALF + pe - pw), (ones + 0.5) / (zeros + ones + 1.0)
    path = key & 255
    z0, o0, b0 = (np.bincount(path, x, 256) for x in (zeros, ones, pw))
    pe0 = log_kt(z0.astype(np.int64), o0.astype(np.int64))
    w0, own0 = np.exp(HALF + pe0 - np.logaddexp(HALF + pe0, HALF + b0)), (o0 + 0.5) / (z0 + o0 + 1.0)
    w0, own0 = w0[path], own0[path]
    return {"key": key, "a": w0 * own0 + (1 - w0) * w * own, "b": (1 - w0) * (1 - w)}


def probabilities(counted: DataFrame, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(block, three, keys, logp) from packed (block, three, keys, held): the grams of each block with their log10 probabilities."""
    sizes = written(counted.groupBy("three").agg(F.sum(F.octet_length("keys")).alias("bytes")), "context-sizes")
    n_buckets = max(1, -(-int(sizes.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))
    bucket = F.when(F.col("shares") > 1, n_buckets + F.col("three")).otherwise(F.pmod(F.xxhash64("three"), F.lit(n_buckets)))
    sizes = sizes.withColumn("shares", F.ceil(F.col("bytes") / bucket_bytes)).select("three", "shares", bucket.alias("bucket"))
    dealt = counted.join(sizes, "three").withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")))

    def merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return summed(unpacked(pdf, depth), np.frombuffer(b"".join(pdf.held), "<i8" if pdf.wide.iloc[0] else "<u4").astype(np.int64))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(*merged(pdf), "<i8", depth).assign(bucket=pdf.bucket.iloc[0], shares=pdf.shares.iloc[0], wide=True)

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        code, n = merged(pdf)
        rows = packed(code, n, "<i8", depth).assign(bucket=pdf.bucket.iloc[0], shares=pdf.shares.iloc[0])
        return pd.concat([rows, two_nodes(code, n, depth)])[["bucket", "shares", "three", "keys", "held", "key", "zeros", "ones", "pw"]].astype({c: "Int64" for c in ("bucket", "shares", "three", "key")})

    own = dealt.select("bucket", "shares", "share", "three", "keys", "held", F.lit(False).alias("wide"))
    shared = own.where("shares > 1").groupBy("bucket", "share").applyInPandas(part, "bucket long, shares long, three long, keys binary, held binary, wide boolean")
    whole = own.where("shares = 1").drop("share").unionByName(shared)
    tree = written(whole.groupBy("bucket").applyInPandas(up, "bucket long, shares long, three long, keys binary, held binary, key long, zeros double, ones double, pw double"), "gram-counts")
    rows = tree.where("key is not null").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "pw")])

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            zeros, ones = pdf.zeros.to_numpy(np.int64), pdf.ones.to_numpy(np.int64)
            pe = log_kt(zeros, ones)
            pw = np.logaddexp(HALF + pe, HALF + pdf.pw.to_numpy())
            yield pd.DataFrame({"key": pdf.key, "zeros": pdf.zeros, "ones": pdf.ones, "pw": pw, "w": np.exp(HALF + pe - pw)})

    two = written(rows.mapInPandas(weighed, "key long, zeros double, ones double, pw double, w double"), "two-byte-nodes")
    one = two.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "pw")])
    top = counted.sparkSession.sparkContext.broadcast(upper(one.toPandas()))  # at most 256 * 255 rows

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, w = pdf.key.to_numpy(np.int64), pdf.w.to_numpy()
            at = np.searchsorted(top.value["key"], key & 0xFFFF)
            a, b, own = top.value["a"][at], top.value["b"][at], ((pdf.ones + 0.5) / (pdf.zeros + pdf.ones + 1.0)).to_numpy()
            yield pd.DataFrame({"two": key >> 8, "key": key, "a": a + b * w * own, "b": b * (1 - w)})

    mixes = two.mapInPandas(mixed, "two long, key long, a double, b double")
    places = sizes.select("bucket", F.col("three").bitwiseAND(F.lit(0xFFFF)).alias("two"), "shares").distinct()
    every = lambda df: df.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    mixes = every(mixes.join(places, "two")).select("bucket", "share", "key", "a", "b")
    models = every(tree.where("three is not null")).select("bucket", "share", F.lit(None).cast("int").alias("block"), "three", "keys", "held")
    asked = dealt.select("bucket", "share", "block", "three", "keys", F.lit(None).cast("binary").alias("held"))

    def answers(pdf: pd.DataFrame, mix: pd.DataFrame) -> pd.DataFrame:
        is_model = pdf.block.isna().to_numpy()
        model, rows = pdf[is_model].sort_values("three"), pdf[~is_model]
        code, n = unpacked(model, depth), np.frombuffer(b"".join(model.held), "<i8")
        mix = mix.sort_values("key")
        logp = log_probabilities(code, n, depth, mix.key.to_numpy(np.int64), mix.a.to_numpy(), mix.b.to_numpy())
        found = logp[np.searchsorted(code, unpacked(rows, depth))].astype("<f4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, rows["keys"]), np.int64, len(rows))).tolist()
        return pd.DataFrame({"block": rows.block.astype("int64"), "three": rows.three, "keys": rows["keys"], "logp": [found[a:b] for a, b in zip([0, *ends], ends)]})

    keys = ("bucket", "share")
    return models.unionByName(asked).groupBy(*keys).cogroup(mixes.groupBy(*keys)).applyInPandas(answers, "block int, three long, keys binary, logp binary")


class Lookup:
    """Places of integers in a table of distinct ones, by a hash table in arrays."""

    def __init__(self, codes: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(codes)).bit_length()))
        h = self.slots(codes)
        self.order = np.argsort(h, kind="stable")
        self.codes = np.append(codes[self.order], -1)
        self.first = np.searchsorted(h[self.order], np.arange(int(1 << (64 - int(self.shift)))))

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """All codes must be in the table."""
        at = self.first[self.slots(codes)]
        miss = np.flatnonzero(self.codes[at] != codes)
        while len(miss):
            at[miss] += 1
            miss = miss[self.codes[at[miss]] != codes[miss]]
        return self.order[at]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: one row for each input row.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0; a null doc_id is held out of the training but is not
    marked so. Null and empty texts are the end alone. Texts are scored whole; repeated rows count and score each;
    an empty table gives an empty result; other columns are ignored. depth is from 3 to 6. A byte's log probability travels in
    single precision.
    """
    rows = worker_texts(docs, id_col, text_col)
    n_blocks = block_count(rows, block_bytes=block_bytes)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))  # rows of one id or none spread out

    def by_block(df: DataFrame) -> GroupedData:  # a task sorts one block: by a hash of its number several would fall to one task
        return df.repartitionById(n_blocks, "block").groupBy("block")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_counts(batches, depth)

    counted = written(by_block(rows).applyInArrow(counts, "block int, three long, keys binary, held binary, word binary, n long"), "block-counts")
    of_grams, of_words = counted.where("three is not null").select("block", "three", "keys", "held"), counted.where("word is not null").select("block", "word", "n")
    by_word = written(of_words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = by_word.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_docs = rows.where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).count()
    n_train, distinct = (total.n or 0) + n_docs, (total.v or 0) + (n_docs > 0)  # with the ends
    known = probabilities(of_grams, depth, bucket_bytes).select("block", "three", "keys", "logp", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"))
    words = of_words.join(by_word, "word").select("block", F.lit(None).cast("long").alias("three"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("logp"), "word", "c")
    known = known.unionByName(words)
    norm = n_train + 0.1 * (distinct + 1)

    def score(rows: pa.Table, table: pa.Table) -> pa.Table:
        give_back()
        packs = table.select(["three", "keys", "logp"]).filter(pc.is_valid(table.column("three"))).to_pandas()
        find, logp = Lookup(unpacked(packs, depth)), np.frombuffer(b"".join(packs.logp), "<f4")
        del packs
        counts: dict[bytes, int] = {}
        for piece in table.select(["word", "c"]).to_batches():
            counts.update(zip(piece.column("word").to_pylist(), piece.column("c").to_pylist()))
        out = []
        for ids, texts in parts(rows):
            cut = [spelled(t) for t in texts]
            streams = [b" ".join(x) + END for x in cut]
            sizes = np.fromiter(map(len, streams), np.int64, len(streams))
            value = np.add.reduceat(logp[find(grams(streams, depth))].astype(np.float64), np.cumsum(sizes) - sizes)
            n = np.fromiter(map(len, cut), np.int64, len(cut))
            c = np.fromiter(map(counts.__getitem__, chain.from_iterable(cut)), np.float64, int(n.sum()))
            owner = np.repeat(np.arange(len(cut)), n)
            base = np.bincount(owner, np.log10((c + 0.1) / norm), len(cut)) + math.log10((n_docs + 0.1) / norm)
            seen = np.bincount(owner, c > 0, len(cut)).astype(np.int64) + (n_docs > 0)
            held = [i is not None and not is_training(i) for i in ids]
            out.append(batch(SCORES, {"doc_id": ids, "held_out": held, "n_tokens": n + 1, "n_known": seen, "train_tokens": np.full(len(ids), n_train), "base_score": base, "score": value, "n_bytes": sizes, "bits_per_byte": -value / math.log10(2) / sizes}))
        return pa.Table.from_batches(out, SCORES)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return by_block(rows).cogroup(by_block(known)).applyInArrow(score, schema)
