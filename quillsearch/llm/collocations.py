"""Phrases of two to four words that occur together more often than their parts alone, for each language.

A sketch bounds counts from above: every phrase adds to a cell that its hash names, tasks count their cells in numpy, slices of cells
are summed where a shuffle brings them together, and what is left is a bit for each cell, whether it reached the least count. Pairs come
first; longer phrases are counted only where all pairs in them are frequent. Every phrase whose cell is full is a candidate, and
none that is frequent is missed. A share of the texts, by their hash, names its candidates first, so that the tasks over the others need
to name only what that share doesn't hold, which for a frequent phrase is seldom. Candidates are counted in the pass that names them: a task sums
their places by hash in numpy, overlaps included, slices of hashes are added up where a shuffle brings them together, and the sums decide. The work is
the same for each byte of text however many candidates there are. Hashes of 64 bits, of language and words, tell phrases apart: that any two of 10^8
candidates share one has a probability of 3 in 10,000.

Memory is bounded at any size: cells up to 2^MAX_BITS (a table of 2^MAX_BITS / 8 bytes is broadcast); larger corpora are sketched in parts,
a part holding the phrases of one class of hashes, and each part reads the texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped
from .bpe import Remembered, chunks
from .common import give_back, written

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000
COVERED_PERCENT = 80
MAX_BITS, SLICE_BITS = 30, 20
#: Bytes of text for each cell of a sketch; phrases whose sums a task holds before it hands them on; words whose hashes a worker remembers.
CELL_BYTES, LOAD_PHRASES, CACHE_WORDS = 16, 2_000_000, 150_000
#: Bytes of text for each slice of the candidates' sums.
SUMS_BYTES = 32 << 20
#: One text in so many names its candidates before the others, which are told up to TOLD of their hashes.
FIRST_SHARE, TOLD = 8, 1 << 20
#: Characters of text that a task takes up at a time.
CHUNK = 3_000_000

PIECE_END, TEXT_START = b"\xff", b"\xfe"  # no bytes of UTF-8 text
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0xFF if chr(c) in ".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 9 else c for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "kind string, lang string, phrase string, n long, slice int, cells binary, counts binary"


def found(kind: str, **columns: list) -> pd.DataFrame:
    """Rows of FOUND; columns that aren't given are null."""
    size = len(next(iter(columns.values())))
    return pd.DataFrame({name: pd.Series([kind] * size if name == "kind" else columns.get(name, [None] * size), dtype=object) for name in [c.split()[0] for c in FOUND.split(", ")]})


def folded(texts: list[str]) -> list[bytes]:
    """Words in order; TEXT_START before each text and PIECE_END between pieces."""
    raw = b"".join([b" " + TEXT_START + b" " + t.encode("utf-8", "replace") for t in texts])
    return raw.translate(FOLD).replace(PIECE_END, b" " + PIECE_END + b" ").split()


class Numbers(Remembered):
    """Numbers of words with their hashes; those of the marks are 0 and 1."""

    def __init__(self):
        super().__init__()
        self[PIECE_END], self[TEXT_START]
        self.hashes = np.zeros(0, np.uint64)
        self.names: list[bytes] = []

    def take(self, found: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new))])
            self.names += self.new
            self.new = []
        return out


class Cutter:
    """Cuts batches of texts for one task."""

    def __init__(self):
        self.numbers = Numbers()

    def __call__(self, texts: list[str], langs: list[str], most: int = MOST_WORDS) -> Batch:
        if len(self.numbers) > CACHE_WORDS:
            self.numbers = Numbers()
        return Batch(self.numbers, self.numbers.take(folded(texts)), langs, most)


class Batch:
    """The words of some texts as numbers in one array, and hashes of the phrases of up to most words that begin at each place."""

    def __init__(self, numbers: Numbers, words: np.ndarray, langs: list[str], most: int):
        self.numbers, self.words = numbers, words
        self.langs = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.langs)}
        of_text = np.array([place[lang] for lang in langs], np.int64)
        self.lang = of_text[np.cumsum(words == 1) - 1] if len(words) else words
        seeds = np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 1) for lang in self.langs], np.uint64)
        self.real = words > 1
        self.hash = [seeds[self.lang] if len(words) else np.zeros(0, np.uint64)]
        self.fits = [np.ones(len(words), bool)]
        for n in range(1, most + 1):
            m = max(len(words) - n + 1, 0)
            h = (self.hash[-1][:m] ^ numbers.hashes[words[n - 1 :]]) * ODD
            self.hash.append(h ^ h >> np.uint64(31))
            self.fits.append(self.fits[-1][:m] & self.real[n - 1 :])

    def sizes(self) -> pd.DataFrame:
        """Words of each language."""
        n = np.bincount(self.lang[self.real], minlength=len(self.langs))
        return found("size", lang=self.langs, n=n.tolist())

    def tally(self, at: np.ndarray, sums: dict[tuple, int]) -> None:
        """Adds the words at these places to the task's sums by language and word."""
        key, n = np.unique(self.lang[at] * len(self.numbers) + self.words[at], return_counts=True)
        names = self.numbers.names
        for lang, word, more in zip((key // len(self.numbers)).tolist(), (key % len(self.numbers)).tolist(), n.tolist()):
            named = self.langs[lang], names[word]
            sums[named] = sums.get(named, 0) + more

    def phrases(self, at: np.ndarray, n: int) -> pd.DataFrame:
        """The phrases of n words at these places, with their hashes in the column n."""
        names = self.numbers.names
        cut = [b" ".join([names[k] for k in row]).decode("utf-8", "replace") for row in self.words[at[:, None] + np.arange(n)].tolist()]
        return found("candidate", lang=[self.langs[k] for k in self.lang[at].tolist()], phrase=cut, n=self.hash[n][at].view(np.int64).tolist())


class Sketch:
    """Which cells there are; part: the class of hashes that this one is for."""

    def __init__(self, bits: int, least: int, part: int = 0, parts: int = 1):
        self.bits, self.least, self.part, self.parts = bits, least, part, parts
        self.slice_bits = min(bits, SLICE_BITS)
        self.kind = np.min_scalar_type(least)

    def mine(self, h: np.ndarray) -> np.ndarray:
        return h % np.uint64(self.parts) == self.part if self.parts > 1 else np.ones(len(h), bool)

    def cells(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def counted(self, hashes: list[np.ndarray]) -> pd.DataFrame:
        """(slice, cells, counts) of phrases; counts stop at the least count that matters."""
        cells, n = np.unique(np.concatenate([self.cells(h[self.mine(h)]) for h in hashes]), return_counts=True)
        n = np.minimum(n, self.least).astype(self.kind)
        of = cells >> np.uint64(self.slice_bits)
        slices, starts = np.unique(of, return_index=True)
        low = (cells & np.uint64((1 << self.slice_bits) - 1)).astype(np.uint32)
        ends = np.append(starts[1:], len(cells))
        ranges = list(zip(starts.tolist(), ends.tolist()))
        return found("cells", slice=slices.tolist(), cells=[low[a:b].tobytes() for a, b in ranges], counts=[n[a:b].tobytes() for a, b in ranges])

    def full(self, rows: DataFrame) -> np.ndarray:
        """The bits of the cells that reach the least count: 2^bits / 8 bytes. rows: FOUND."""
        kind, least, size = self.kind, self.least, 1 << self.slice_bits

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for s, cells, counts in zip(pdf.slice, pdf.cells, pdf.counts):
                    total = sums.setdefault(s, np.zeros(size, np.uint32))
                    at = np.frombuffer(cells, np.uint32)
                    total[at] = np.minimum(total[at] + np.frombuffer(counts, kind), least)
            yield pd.DataFrame([(s, np.packbits(t >= least).tobytes()) for s, t in sums.items()], columns=["slice", "bits"])

        n = 1 << (self.bits - self.slice_bits)
        summed = rows.where("kind = 'cells'").select("slice", "cells", "counts").repartition(n, "slice").mapInPandas(add, "slice int, bits binary")
        out = np.zeros((n, size // 8), np.uint8)
        for r in written(summed, "full-cells").collect():  # bounded by the number of cells
            out[r.slice] = np.frombuffer(r.bits, np.uint8)
        return out.ravel()

    def frequent(self, h: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Whether phrases may be frequent; those of other parts may."""
        cells = self.cells(h)
        return (full[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) | ~self.mine(h)


def paired(b: Batch, sketch: Sketch, full: np.ndarray) -> list[np.ndarray]:
    """For 2, 3 and 4 words, the places where a phrase of so many fits and all pairs in it may be frequent."""
    pair = b.fits[2].copy()
    pair[pair] = sketch.frequent(b.hash[2][pair], full)
    out = [pair]
    for n in range(3, MOST_WORDS + 1):
        m = len(b.fits[n])
        out.append(out[-1][:m] & pair[n - 2 : n - 2 + m])
    return [np.flatnonzero(x) for x in out]


class Sums:
    """Counts by hash: sorted, with more waiting until they are as many."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.more = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.more += len(hashes)
        if self.more > max(len(self.hashes), 1 << 16):
            self.merge()

    def merge(self) -> None:
        if self.more:
            h = np.concatenate([self.hashes, *[x for x, _ in self.waiting]])
            n = np.concatenate([self.counts, *[x for _, x in self.waiting]])
            order = np.argsort(h)
            h = h[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            self.hashes, self.counts = h[starts], np.add.reduceat(n[order], starts)
        self.waiting, self.more = [], 0

    def handed_on(self, slice_bits: int) -> pd.DataFrame:
        """(slice, cells, counts): all that is held, a row for each of 2^slice_bits slices of hashes; nothing is held then."""
        self.merge()
        of = (self.hashes >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(self.hashes), np.int64)
        slices, starts = np.unique(of, return_index=True)
        ranges = list(zip(starts.tolist(), [*starts[1:].tolist(), len(of)]))
        out = found("sums", slice=slices.tolist(), cells=[self.hashes[a:b].tobytes() for a, b in ranges], counts=[self.counts[a:b].tobytes() for a, b in ranges])
        self.hashes, self.counts = self.hashes[:0], self.counts[:0]
        return out


def added_up(rows: DataFrame, slice_bits: int, min_count: int) -> DataFrame:
    """(n, a): the hashes that reach the least count, with their counts. rows: FOUND."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Sums] = {}
        for pdf in batches:
            for s, cells, counts in zip(pdf.slice, pdf.cells, pdf.counts):
                held.setdefault(s, Sums()).add(np.frombuffer(cells, np.uint64), np.frombuffer(counts, np.int64))
        while held:
            _, sums = held.popitem()
            sums.merge()
            enough = sums.counts >= min_count
            yield pd.DataFrame({"n": sums.hashes[enough].view(np.int64), "a": sums.counts[enough]})
        give_back()

    return rows.where("kind = 'sums'").select("slice", "cells", "counts").repartition(1 << slice_bits, "slice").mapInPandas(add, "n long, a long")


def distinct_phrases(b: Batch, at: np.ndarray, n: int, seen: dict, told: np.ndarray) -> pd.DataFrame:
    """Those that neither the task has named yet nor told (sorted hashes) holds; all are added to the task's sums."""
    h, first, times = np.unique(b.hash[n][at], return_index=True, return_counts=True)
    seen["sums"].add(h, times)
    old = np.isin(h, seen[n], assume_unique=True) if n in seen else np.zeros(len(h), bool)
    if len(told):
        old |= told[np.minimum(np.searchsorted(told, h), len(told) - 1)] == h
    seen[n] = np.concatenate([seen.get(n, h[:0]), h[~old]])
    return b.phrases(at[first[~old]], n)


@dataclass
class Part:
    """phrases (lang, phrase, a): the frequent ones of the part; words (lang, word, n): its words that are frequent and some others, a row
    for each task that met them; of the first part also sizes (lang, n): numbers of words."""

    phrases: DataFrame
    words: DataFrame
    sizes: DataFrame


def frequent_phrases(texts: DataFrame, min_count: int, bits: int, part: int, parts: int, slice_bits: int, held: int) -> Part:
    """texts: (lang, text). held: phrases whose sums a task holds at a time; they are handed on in 2^slice_bits slices."""
    sketch = Sketch(bits, min_count, part, parts)
    context = texts.sparkSession.sparkContext

    def over(step, of: DataFrame = texts, most: int = MOST_WORDS):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut, seen, sums = Cutter(), {"sums": Sums()}, {}
            for pdf in batches:
                for s in chunks(pdf.text, CHUNK):
                    b = cut(pdf.text.iloc[s].tolist(), pdf.lang.iloc[s].tolist(), most)
                    yield from step(b, seen, sums)
                    if len(seen["sums"].hashes) + seen["sums"].more > held:
                        yield seen["sums"].handed_on(slice_bits)
                    give_back()
            yield seen["sums"].handed_on(slice_bits)
            yield found("word", lang=[lang for lang, _ in sums], phrase=[word.decode("utf-8", "replace") for _, word in sums], n=list(sums.values()))

        return of.mapInPandas(run, FOUND)

    def count_pairs(b: Batch, seen: dict, sums: dict) -> Iterator[pd.DataFrame]:
        if part == 0:
            yield b.sizes()
        yield sketch.counted([b.hash[n][b.fits[n]] for n in (1, 2)])

    first = written(over(count_pairs, most=2), "pair-cells")
    pairs = context.broadcast(sketch.full(first))

    def count_longer(b: Batch, seen: dict, sums: dict) -> Iterator[pd.DataFrame]:
        words = np.flatnonzero(b.real)
        b.tally(words[sketch.frequent(b.hash[1][words], pairs.value) & sketch.mine(b.hash[1][words])], sums)
        yield sketch.counted([b.hash[n][at] for n, at in enumerate(paired(b, sketch, pairs.value)[1:], 3)])

    second = written(over(count_longer), "phrase-cells")
    longer = context.broadcast(sketch.full(second))

    def naming(told):
        def name(b: Batch, seen: dict, sums: dict) -> Iterator[pd.DataFrame]:
            for n, at in enumerate(paired(b, sketch, pairs.value), 2):
                h = b.hash[n][at]
                mine = sketch.mine(h) if n == 2 else sketch.mine(h) & sketch.frequent(h, longer.value)
                yield distinct_phrases(b, at[mine], n, seen, told.value)

        return name

    early = F.pmod(F.xxhash64("text"), F.lit(FIRST_SHARE)) == 0
    head = written(over(naming(context.broadcast(np.zeros(0, np.uint64))), texts.where(early)), "first-candidates")
    told = head.where("kind = 'candidate'").select("n").distinct().limit(TOLD).toArrow()["n"].to_numpy().view(np.uint64)  # what isn't told is only named again
    rest = written(over(naming(context.broadcast(np.sort(told))), texts.where(~early)), "more-candidates")
    both = head.unionByName(rest)
    names = both.where("kind = 'candidate'").select("n", "lang", "phrase")
    phrases = names.join(added_up(both, slice_bits, min_count), "n").select("n", "lang", "phrase", "a").distinct().select("lang", "phrase", "a")
    of = lambda rows, kind: rows.where(F.col("kind") == kind)
    return Part(phrases, of(second, "word").select("lang", F.col("phrase").alias("word"), "n"), of(first, "size").select("lang", "n"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", max_bits: int = MAX_BITS, cell_bytes: int = CELL_BYTES, load_phrases: int = LOAD_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 2 to 4 words with a >= min_count, (lang, word, n) of all such words, and (lang, n) of all words."""
    texts = shipped(docs).select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(max_bits, max(8, math.ceil(math.log2(max(total, 1) / cell_bytes + 1))))
    parts = max(1, -(-total // (cell_bytes << max_bits)))
    slice_bits = max(0, math.ceil(math.log2(max(total, 1) / SUMS_BYTES)))
    made = [frequent_phrases(texts, min_count, bits, p, parts, slice_bits, load_phrases) for p in range(parts)]
    together = lambda name: reduce(DataFrame.unionByName, [getattr(m, name) for m in made])
    words = together("words").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    sizes = made[0].sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    return written(together("phrases"), "phrase-counts"), words, sizes


def exact(c: str | Column) -> Column:
    """A count for products that pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered_percent: int = COVERED_PERCENT, **counting) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language (null: und), by falling score.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends and those into words at blanks; phrases don't cross pieces.
    a is a phrase's count, l and r those of its parts at its weakest cut, n all words of the language, score 2,000,000 a / (l + r) without
    its fraction. Phrases inside a longer candidate with at least covered_percent of their count are left out; equal scores go by a, then by phrase. Null
    and empty texts have no words; rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
    """
    counts, words, sizes = phrase_counts(docs, min_count, **counting)
    ws = F.split("phrase", " ", -1)
    join = lambda a, start, length: F.array_join(F.slice(a, start, length), " ")
    cut = counts.withColumn("ws", ws).select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    halves = cut.select("lang", "phrase", "a", "k", join(F.col("ws"), 1, F.col("k")).alias("left"), join(F.col("ws"), F.col("k") + 1, F.size("ws")).alias("right"))
    parts = counts.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    of = lambda side, count: parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    both = halves.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    longer = counts.withColumn("ws", ws).where(F.size("ws") > 2)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda s: F.array_join(F.slice("ws", s, m), " "))))
    around = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    free = scored.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * exact("most") < covered_percent * exact("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
