"""Benchmark passages in training text, by a generalised suffix automaton of the benchmark's items.

An item's windows are its runs of `window` words (an item of fewer words is one window). Items are dealt to blocks of a bounded number
of words, and of each block one automaton is made in a task of its own: every word sequence of the block's items is a walk from its first
state, and the states that hold windows know their items. Documents stream through an automaton word by word; the longest sequence
that ends at a word and that an item holds is tracked along the suffix links, and what is at least a window long marks its words.

Steps that lead nowhere are not walked: a window needs all its neighbouring pairs to be pairs of the automaton, which a table of bits tells
for all words of a batch at once in numpy. Each block is one pass over the documents with an automaton of bounded size as a broadcast
(BLOCK_WORDS); a benchmark of up to that many words, as all published ones together nearly are, is one pass without any shuffle.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import shipped
from .bpe import chunks
from .common import give_back, worker_texts, written

WINDOW = 10
#: Words of items in one automaton (some 100 MB in a worker), and the most words of an item that stay together.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
HITS = "n_words long, n_hit long, longest long, starts array<int>, ends array<int>, items array<string>"
EMPTY: list = []

#: ASCII letters in lower case, everything that ends a word as a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
TEXT_END = b"\xff"  # no byte of UTF-8 text


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


class SuffixAutomaton:
    """Of word numbers; states are numbered, 0 holds the empty sequence."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _redirect(self, state: int, word: int, old: int | None, new: int) -> int:
        """From state up its links, as long as word leads to old, lets it lead to new; the first state for which it doesn't."""
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return state

    def _exact(self, state: int, word: int) -> int:
        """The state after word whose longest sequence is that of state and word: split off if there is none yet."""
        after = self.next[state][word]
        if self.length[after] == self.length[state] + 1:
            return after
        half = self._state(self.length[state] + 1, dict(self.next[after]), self.link[after])
        self.link[after] = half
        self._redirect(state, word, after, half)
        return half

    def add(self, item: list[int]) -> None:
        last = 0
        for word in item:
            if word in self.next[last]:
                last = self._exact(last, word)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            known = self._redirect(last, word, None, new)
            if known >= 0:
                self.link[new] = self._exact(known, word)
            last = new

    def ending(self, state: int, length: int) -> int:
        """The state that holds the last length words of a sequence of state."""
        while self.length[self.link[state]] >= length and state:
            state = self.link[state]
        return state

    def window_states(self, item: list[int], window: int) -> Iterator[int]:
        """The state of each run of window words."""
        state, length = 0, 0
        for word in item:
            state, length = self.next[state][word], min(length + 1, window)
            state = self.ending(state, length)
            if length == window:
                yield state


def compiled(items: list[tuple[str, list[bytes]]], window: int) -> bytes:
    """The automaton of a block's items as arrays, with the items of each window; items: (id, words)."""
    numbers: dict[bytes, int] = {}
    coded = [(i, [numbers.setdefault(w, len(numbers)) for w in ws]) for i, ws in items]
    made = SuffixAutomaton()
    for _, item in coded:
        made.add(item)
    ids = sorted({i for i, _ in coded})
    place = {i: k for k, i in enumerate(ids)}
    held: dict[tuple[int, int], set[int]] = {}
    for i, item in coded:
        size = min(window, len(item))
        for state in made.window_states(item, size):
            held.setdefault((state, size), set()).add(place[i])
    moves = [(state << 32 | word, after) for state, m in enumerate(made.next) for word, after in m.items()]
    pairs = {(a, b) for _, item in coded for a, b in zip(item, item[1:])}
    windows = [(state, size, np.fromiter(sorted(of), np.int32, len(of))) for (state, size), of in sorted(held.items())]
    return pickle.dumps({"words": list(numbers), "moves": np.array(moves, np.int64).reshape(-1, 2), "link": np.array(made.link, np.int32), "length": np.array(made.length, np.int32), "pairs": np.array(sorted(pairs), np.int64).reshape(-1, 2), "windows": windows, "ids": ids})


class Matcher:
    """A compiled block in a worker."""

    def __init__(self, payload: bytes):
        p = pickle.loads(payload)
        self.numbers = {w: i for i, w in enumerate(p["words"])}
        self.moves = dict(p["moves"].tolist())
        self.link, self.length, self.ids = p["link"].tolist(), p["length"].tolist(), p["ids"]
        self.windows: dict[int, list] = {}
        for state, size, items in p["windows"]:
            self.windows.setdefault(state, []).append((size, items))
        sizes = sorted({size for _, size, _ in p["windows"]})
        self.least = min((s for s in sizes if s > 1), default=1 << 30)
        self.alone = np.zeros(len(self.numbers) + 1, bool)  # words that are an item; the last place is for unknown words
        for w in range(len(self.numbers)):
            self.alone[w] = any(size == 1 for size, _ in self.windows.get(self.moves.get(w, 0), EMPTY))
        self.numbers[TEXT_END] = -2
        # for each state, the nearest one up its links that holds windows
        self.above = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.windows else self.above[up]
        bits = max(10, math.ceil(math.log2(16 * len(p["pairs"]) + 1)))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[self._cell(p["pairs"][:, 0], p["pairs"][:, 1])] = True

    def _cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xFF51AFD7ED558CCD) >> self.shift

    def numbered(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, found, repeat(-1)), np.int64, len(found))

    def stretches(self, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words in which every pair of neighbours may be one of the automaton, if a window fits in."""
        if len(n) == 0:
            return
        linked = np.zeros(len(n) + 1, bool)
        linked[1:-1] = (n[:-1] >= 0) & (n[1:] >= 0)
        at = np.flatnonzero(linked)
        linked[at] = self.bits[self._cell(n[at - 1], n[at])]
        starts = np.flatnonzero(~linked[:-1])
        ends = np.append(starts[1:], len(n))
        wide = ends - starts >= self.least
        if self.alone.any():  # some word is an item of its own: each of its places counts
            wide |= np.maximum.reduceat(self.alone[np.maximum(n, -1)], starts)
        yield from zip(starts[wide].tolist(), ends[wide].tolist())

    def walk(self, n: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """For each window that ends at a place of the run: (place, its words, longest match that ends there, its items)."""
        moves, link, length, windows, above = self.moves, self.link, self.length, self.windows, self.above
        state = longest = 0
        for i, word in enumerate(n):
            after = moves.get(state << 32 | word)
            while after is None and state:
                state = link[state]
                longest = length[state]
                after = moves.get(state << 32 | word)
            if after is None:
                continue
            state, longest = after, longest + 1
            up = state
            while up:
                for size, items in windows.get(up, EMPTY):
                    if size <= longest:
                        yield i, size, longest, items
                up = above[up]


_loaded: dict[str, Matcher] = {}


def loaded(key: str, payload) -> Matcher:
    """The block's matcher; a worker holds one at a time."""
    if key not in _loaded:
        _loaded.clear()
        give_back()
        _loaded[key] = Matcher(payload.value)
    return _loaded[key]


def matched(texts: pd.Series, before: pd.DataFrame | None, m: Matcher) -> pd.DataFrame:
    """HITS of each text; before: those of the blocks before this one."""
    rows = []
    for part in chunks(texts):
        ahead = TEXT_END.join([b"", *(b" " + t.encode("utf-8", "replace") + b" " for t in texts.iloc[part])])
        n = m.numbered(ahead.translate(FOLD).split())
        first = np.flatnonzero(n == -2)
        sizes = np.diff(first, append=len(n)) - 1
        hits: dict[int, list] = {}
        for a, b in m.stretches(n):
            doc = int(np.searchsorted(first, a, "right")) - 1
            base = a - int(first[doc]) - 1
            for i, size, longest, items in m.walk(n[a:b].tolist()):
                hits.setdefault(doc, []).append((base + i - size + 1, base + i + 1, longest, items))
        for k, size in enumerate(sizes.tolist()):
            rows.append((size, hits.get(k, EMPTY)))
    out = []
    for k, (size, hits) in enumerate(rows):
        old = before.iloc[k] if before is not None else None
        if not hits and (old is None or not old["n_hit"]):
            out.append((size, 0, 0, EMPTY, EMPTY, EMPTY))
            continue
        spans = [(a, b) for a, b, _, _ in hits] + (list(zip(old["starts"], old["ends"])) if old is not None else [])
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, [a for a, _ in spans], 1)
        np.add.at(edge, [b for _, b in spans], -1)
        turn = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
        distinct = {id(items): items for _, _, _, items in hits}
        items = {m.ids[i] for held in distinct.values() for i in held.tolist()} | (set(old["items"]) if old is not None else set())
        longest = max([x for _, _, x, _ in hits] + [int(old["longest"]) if old is not None else 0])
        out.append((size, int((ends - starts).sum()), longest, starts.tolist(), ends.tolist(), sorted(items)))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "longest", "starts", "ends", "items"])


def matcher_udf(payload, key: str, again: bool):
    """payload: a broadcast compiled block; again: an argument holds the hits of the blocks before."""

    def run(texts: pd.Series, before: pd.DataFrame | None) -> pd.DataFrame:
        return matched(texts, before, loaded(key, payload))

    if again:

        @F.pandas_udf(HITS)
        def hits_so_far(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
            return run(texts, before)

        return hits_so_far

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return run(texts, None)

    return hits


def blocks(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(block, payload): the compiled automata. Items longer than piece_words are cut with an overlap that loses no window; rows with the
    same id and words count once; items without words and null texts have no window; a null id reads null."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf.item_id, pdf.text):
                ws = words(t)
                for k in range(0, max(len(ws) - window, 0) + 1, piece_words - window + 1):
                    if ws:
                        out.append((i, b" ".join(ws[k : k + piece_words]), min(piece_words, len(ws) - k)))
            yield pd.DataFrame(out, columns=["item_id", "piece", "size"])

    items = shipped(benchmark).select(F.coalesce(benchmark[id_col].cast("string"), F.lit("null")).alias("item_id"), F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    cut = written(items.mapInPandas(pieces, "item_id string, piece binary, size long").distinct(), "benchmark-pieces")
    total = cut.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-int(total) // block_words))

    def compile_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "piece"])
        return pd.DataFrame({"block": [key[0]], "payload": [compiled([(i, bytes(p).split()) for i, p in zip(pdf.item_id, pdf.piece)], window)]})

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(n)))
    return written(dealt.groupBy("block").applyInPandas(compile_block, "block long, payload binary"), "benchmark-automata")


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", column: str = "hits", **cut) -> DataFrame:
    """docs with a struct column of HITS: words of the text, words in benchmark windows, the longest match, where the marked spans
    start and end (numbers of words), and the ids of the items."""
    made = blocks(benchmark, window, **cut)
    context = docs.sparkSession.sparkContext
    shipped(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbers = sorted(r.block for r in made.select("block").collect())  # one for each BLOCK_WORDS words of the benchmark
    out = docs
    for k, b in enumerate(numbers or [None]):
        payload = made.where(F.col("block") == b).first().payload if b is not None else compiled([], window)
        sent = context.broadcast(bytes(payload))
        find = matcher_udf(sent, uuid.uuid4().hex, k > 0)
        out = out.withColumn(column, find(text, F.col(column)) if k else find(text))
        if k + 1 < len(numbers):
            out = written(out, "contamination")
    return out


@F.pandas_udf(StringType())
def _without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    def cut(t: str, a: np.ndarray, b: np.ndarray) -> str:
        raw = t.encode("utf-8", "replace")
        places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
        out, at = [], 0
        for i, j in zip(a, b):
            out.append(raw[at : places[i][0]])
            at = places[j - 1][1]
        return b"".join([*out, raw[at:]]).decode("utf-8", "replace")

    return pd.Series([None if t is None else cut(t, a, b) for t, a, b in zip(text, starts, ends)], dtype=object)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **cut) -> DataFrame:
    """doc_id, n_words, n_hit, longest, starts, ends, items: one row for each input row, over whole texts.

    Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. A null or empty text has no words and no
    hits; repeated rows come out alike; an empty table gives an empty result and an empty benchmark no hits; other columns are ignored.
    """
    return with_hits(worker_texts(docs, id_col, text_col), benchmark, window, **cut).select("doc_id", "hits.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text", **cut) -> DataFrame:
    """docs with all their columns, without marked spans of max_span words or more; documents of which marked words are more than
    max_coverage are left out. A text without such a span keeps every byte."""
    name, spans = f"hits_{(own := uuid.uuid4().hex)}", f"spans_{own}"  # no column of docs has these names
    found = with_hits(docs, benchmark, window, text_col, name, **cut)
    h = F.col(name)
    pairs = F.filter(F.arrays_zip(h["starts"].alias("starts"), h["ends"].alias("ends")), lambda s: s["ends"] - s["starts"] >= max_span)
    kept = found.where(h["n_hit"] <= max_coverage * h["n_words"]).withColumn(spans, pairs)
    hit = F.size(spans) > 0
    cleaned = _without(F.when(hit, F.col(text_col)), F.col(f"{spans}.starts"), F.col(f"{spans}.ends"))
    return kept.withColumn(text_col, F.when(hit, cleaned).otherwise(F.col(text_col))).drop(name, spans)


def digests(found: DataFrame) -> DataFrame:
    """The report of a contamination() table: numbers of words, hits and items, and a digest of the items' ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")
