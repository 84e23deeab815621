"""Token ids in binary shards: frequency ranks in byte-aligned variable-length coding, control bytes apart.

Shards follow one another in ascending doc_id order. A shard holds (all integers little-endian)

    8 bytes   magic "QTOKSH01"
    4 x u32   documents d, distinct ids r, and u64: ids n
    d x i64   doc_ids (the smallest i64 for null)
    d x u64   ids of each document
    r x u32   the ids by falling frequency in this shard, ties by id: the rank table
    n' bytes  control bytes: 2 bits a rank, four ranks a byte from the low bits up, the rank's bytes less one
    m bytes   the ranks' bytes, 1 to 4 each

so that the most frequent 256 ids take one byte, and a reader needs nothing but the shard. Decoding looks up each control
byte in a table of 256 x 4 lengths and gathers the bytes, all in numpy. Shards are written by Spark as rows of a Parquet
table (shard key, counts, payload) in the shared folder, so any store that Spark writes to will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, chunks
from .common import block_count, worker_texts, written

MAGIC = b"QTOKSH01"
END_ID = 1
#: Ids below this are counted in an array of that size.
DENSE_IDS = 1 << 22
#: Pieces that the library encodes at a time, and in one line.
BATCH, LINE = 20_000, 100
NULL_ID = np.iinfo(np.int64).min
#: Of each control byte, the bytes of its four ranks.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class WordEncoder(Encoder):
    """The tokenizers library's merging, asked once for each distinct piece: many pieces with spaces between them at a time, as a piece
    ends with the one of its ids whose token ends a word. Normalising and cutting are done before, once a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.normalizer = normalizers.Sequence([])
        self.library.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.library.no_padding()
        self.library.no_truncation()
        super().__init__(path, "word")
        model = self.words.spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def ask(self, lines: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]  # without offsets

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for i in range(0, len(new), BATCH):
            part = new[i : i + BATCH]
            ids = self.ask([" ".join(part[k : k + LINE]) for k in range(0, len(part), LINE)])
            row = np.fromiter(chain.from_iterable(ids), np.uint32)
            ends = np.flatnonzero(self.ends[np.minimum(row, len(self.ends) - 1)])
            n = np.diff(ends, prepend=-1)
            if len(ends) != len(part) or (len(row) and ends[-1] != len(row) - 1):  # a token outside the scheme: each piece on its own
                ids = self.ask(part)
                row, n = np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(row)
            sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)


_loaded: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def packed(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard."""
    if not len(ids) or ids.max() < DENSE_IDS:  # count by position in place of sorting
        freq = np.bincount(ids, minlength=1)
        values = np.flatnonzero(freq)
        freq, where = freq[values], ids
        rank_of = np.zeros(int(values[-1]) + 1 if len(values) else 1, np.uint32)
    else:
        values, where, freq = np.unique(ids, return_inverse=True, return_counts=True)
        rank_of = np.zeros(len(values), np.uint32)
    order = np.lexsort((values, -freq))
    rank_of[values[order] if where is ids else order] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[where]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = four[np.arange(4) <= extra[:, None]]
    head = MAGIC + struct.pack("<IIQ", len(doc_ids), len(values), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpacked(shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts, ids of a shard."""
    if shard[:8] != MAGIC:
        raise ValueError("not a token shard")
    d, r, n = struct.unpack_from("<IIQ", shard, 8)
    at = 24
    doc_ids = np.frombuffer(shard, "<i8", d, at)
    counts = np.frombuffer(shard, "<u8", d, at + 8 * d).astype(np.int64)
    table = np.frombuffer(shard, "<u4", r, at + 16 * d)
    at += 16 * d + 4 * r
    control = np.frombuffer(shard, np.uint8, -(-n // 4), at)
    data = np.frombuffer(shard, np.uint8, offset=at + len(control))
    sizes = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = data[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, counts, table[ranks]


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """The table of shards: part, seq (their order), n_docs, n_ids, payload. One range exchange of the texts; each shard
    holds about 4 MB of text."""
    rows = worker_texts(docs, id_col, text_col)
    rows = rows.repartitionByRange(block_count(rows), F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq = loaded(path), TaskContext.get().partitionId(), 0
        for pdf in batches:
            for rows in (pdf.iloc[s] for s in chunks(pdf.text)):
                flat, counts = encoder.encode(rows.text)
                ids = np.insert(flat, np.cumsum(counts), end_id)
                keys = rows.doc_id.fillna(NULL_ID).astype(np.int64).to_numpy()
                yield pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(rows)], "n_ids": [len(ids)], "payload": [packed(keys, counts + 1, ids)]})
                seq += 1

    return written(rows.mapInPandas(run, "part int, seq int, n_docs long, n_ids long, payload binary"), "token-shards")


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids: what the shards hold, a row for each document."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # one row for each range
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    placed = shards.select("part", "seq", (before(Window.partitionBy("part").orderBy("seq"))).alias("offset")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("offset")).alias("first"))
    rows = shards.select("part", "seq", "payload").join(placed, ["part", "seq"]).select("first", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, payload in zip(pdf["first"], pdf.payload):
                doc_ids, counts, ids = unpacked(payload)
                runs = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                out = {"doc_id": pd.Series(doc_ids).where(doc_ids != NULL_ID).astype("Int64"), "start": first + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(x) for x in runs]}
                yield pd.DataFrame(out | ({"ids": [x.tolist() for x in runs]} if with_ids else {}))

    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes the shards and reads them back: one row for each input row, in doc_id order (nulls first, ties by text).

    A null or empty text has its end id only. Texts are encoded whole; repeated rows are written as often as they
    come; an empty table gives no shard and an empty result; other columns are ignored.
    """
    return read_shards(write_shards(docs, path, id_col, text_col), with_ids)
