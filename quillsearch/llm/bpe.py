"""Byte-level BPE by speculation and verification, over a published vocabulary file (never trained here).

Each distinct word is first cut greedily into the longest vocabulary entries. The cut is the true encoding exactly when
every entry encodes to itself and every adjacent pair of entries does: no merge that comes early enough crosses the border between
them. All distinct adjacent pairs of a batch are tested at once in numpy against the merge table; words with a failing
pair, and only they, are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import worker_texts

#: Words whose ids a worker remembers, and characters of text that it takes up at a time.
CACHE_WORDS = 300_000
CHUNK_CHARS = 4_000_000
#: Failing words of at most so many bytes are merged together in numpy, longer ones one by one.
SHORT = 24
NEVER = np.int64(1) << 40


@lru_cache
def letter_and_number_classes(path: str) -> tuple[str, str, str]:
    """The bodies of regular-expression classes for letters, numbers and white space as the tokenizers library sees them:
    code points that this Python doesn't know are tried out on the library."""
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    kinds = {"L": [], "N": []}
    unknown = []
    for i in chain(range(0xD800), range(0xE000, 0x110000)):
        c = unicodedata.category(chr(i))
        if c[0] in kinds:
            kinds[c[0]].append(i)
        elif c == "Cn":
            unknown.append(i)
    newer = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, unknown)))
    for kind in kinds:
        found = Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True).pre_tokenize_str("".join(newer))
        kinds[kind] += [ord(s) for s, _ in found]

    def ranges(points: list[int]) -> str:
        out, points = [], sorted(points)
        for p in points:
            if out and out[-1][1] == p - 1:
                out[-1][1] = p
            else:
                out.append([p, p])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    space = [i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    return ranges(kinds["L"]), ranges(kinds["N"]), ranges(space)


def _basic(body: str) -> str:
    """The ranges of a class body that lie in the basic plane."""
    return "".join(r for r in re.findall(r"\\U\w{8}-\\U\w{8}", body) if r < "\\U00010000")


class Words:
    """Cuts texts into the pieces that are encoded on their own. The patterns of the tokenizer files, with
    letters first, which no other branch can start with."""

    PATTERNS = {
        "byte": " ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+",
        "word": "[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+",
    }

    def __init__(self, path: str, kind: str):
        spec = json.load(open(path, encoding="utf-8"))
        classes = letter_and_number_classes(path)
        # short classes for texts without characters above the basic plane: Python's re tries those one by one
        make = lambda f: re.compile(self.PATTERNS[kind].replace("{L}", f(classes[0])).replace("{N}", f(classes[1])).replace("{S}", f(classes[2]))).findall
        self.basic, self.full, self.kind = make(_basic), make(str), kind
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.spec = spec

    def plain(self, text: str) -> list[str]:
        if self.kind == "word":
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # letter by letter: no final sigma
        basic = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return self.basic(text) if basic else self.full(text)

    def __call__(self, text: str) -> list[str]:
        """Pieces and special tokens in order."""
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if part:
                out += [part] if i % 2 else self.plain(part)
        return out


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next unused one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """word -> number, given out on first sight; encodings of the numbered words as ragged arrays."""

    def __init__(self):
        self.new: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The encodings of self.new."""
        ends = np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.new = []


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Encoder:
    """Encodes texts piece by piece; learn() gives the ids of pieces that weren't met before."""

    def __init__(self, path: str, kind: str):
        self.words = Words(path, kind)
        self.forget()

    def forget(self) -> None:
        self.known = Remembered()
        for s in self.words.special:
            self.known[s]
        self.known.add(np.array(list(self.words.special.values()), np.uint32), np.ones(len(self.words.special), np.int64))

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, docs: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all docs in one array, and the number of each."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known = self.known
        cut = [self.words(d) for d in docs]
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(n_words.sum()))
        if known.new:
            known.add(*self.learn(known.new))
        sizes = known.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return ragged(known.flat, known.starts[codes], sizes), np.diff(ends[bounds])


class SpeculativeBPE(Encoder):
    def __init__(self, path: str):
        super().__init__(path, "byte")
        spec = self.words.spec
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        size = max(max(vocab.values()), *self.words.special.values(), 0) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.words.special.items():
            self.bytes[i] = s.encode()
        self.longest = max(map(len, self.ids))
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = size
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: Of each token: the rank of the merge that makes it (-1: a byte) and its two parts.
        self.made = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((i, j), (r, k))
            if self.made[k] < 0:
                self.made[k], self.left[k], self.right[k] = r, i, j
        pairs = np.array([i * size + j for i, j in self.rank], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], ranks[order]
        self.whole = np.zeros(size, bool)
        self.whole[[i for b, i in self.ids.items() if len(b) == 1]] = True
        grown = np.flatnonzero(self.made >= 0)
        grown = grown[np.argsort(self.made[grown])]
        fits = self.compatible(self.left[grown], self.right[grown], self.made[grown])
        for k, fit in zip(grown.tolist(), fits.tolist()):  # parts come before what they make
            self.whole[k] = fit and self.whole[self.left[k]] and self.whole[self.right[k]]
        lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.text, self.text_at, self.text_size = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.of_byte = np.array([self.ids.get(bytes([b]), 0) for b in range(256)])
        self.by_rank = np.zeros(len(merges), np.int64)
        for r, k in self.rank.values():
            self.by_rank[r] = k

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Of each pair of tokens: whether no merge crosses its border (before the merge of rank until). Of the symbols that
        end at the border, x stands from the merge that makes it up to the one that takes it in, and so does y on the
        other side; (x, y) merges if its rank comes before both ends. At equal rank the left one goes first."""
        ok = np.ones(len(a), bool)
        top = np.full(len(a), NEVER) if until is None else until
        at, x, y = np.arange(len(a)), np.asarray(a).copy(), np.asarray(b).copy()
        x_end, y_end = top[at].copy(), top[at].copy()
        while len(at):
            r = self.lookup(x, y)
            bad = (r < x_end) & (r <= y_end) & (r < top[at])
            ok[at[bad]] = False
            # undo the later of the two merges that made x and y
            mx, my = self.made[x], self.made[y]
            go = ~bad & ((mx >= 0) | (my >= 0))
            undo_x = go & (mx > my)
            undo_y = go & (mx < my)
            both = go & (mx == my)  # at one time: the left one is undone last, as it was made first
            undo_y |= both
            x_end = np.where(undo_x, mx, x_end)
            x = np.where(undo_x, self.right[x], x)
            y_end = np.where(undo_y, my, y_end)
            y = np.where(undo_y, self.left[y], y)
            at, x, y, x_end, y_end = at[go], x[go], y[go], x_end[go], y_end[go]
        return ok

    def greedy(self, b: bytes) -> list[int]:
        out, i, n, get = [], 0, len(b), self.ids.get
        while i < n:
            j = min(n, i + self.longest)
            while (t := get(b[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merged(self, b: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost among equals."""
        sym: list[int] = [self.ids[b[i : i + 1]] for i in range(len(b))]
        nxt, prv = list(range(1, len(b) + 1)), list(range(-1, len(b) - 1))
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(len(b) - 1) if (m := self.rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, l, r = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != l or j >= len(b) or sym[j] != r:
                continue
            sym[i], sym[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] < len(b):
                prv[nxt[i]] = i
                if m := self.rank.get((new, sym[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, sym[nxt[i]]))
            if prv[i] >= 0 and (m := self.rank.get((sym[prv[i]], new))):
                heapq.heappush(heap, (m[0], prv[i], m[1], sym[prv[i]], new))
        return [s for s in sym if s >= 0]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or NEVER."""
        code = a * self.size + b
        k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[k] == code, self.pair_rank[k], NEVER)

    def merged_short(self, raw: list[bytes]) -> list[list[int]]:
        """Exact merging of many words of at most SHORT bytes, a merge of each word at a time."""
        width, n = SHORT + 1, len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, n)
        filled = np.arange(width) < sizes[:, None]
        sym = np.full((n, width), -1, np.int64)
        sym[filled] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        out: list[list[int]] = [[]] * n
        rank = np.full((n, width), NEVER)
        inside = filled[:, 1:]
        rank[:, :-1][inside] = self.lookup(sym[:, :-1][inside], sym[:, 1:][inside])
        row, col = np.arange(n), np.arange(width)
        while len(row):
            p = rank.argmin(1)
            every = np.arange(len(row))
            least = rank[every, p]
            over = least == NEVER
            for k in np.flatnonzero(over).tolist():
                out[row[k]] = sym[k, : sizes[k]].tolist()
            go = ~over
            row, sym, rank, sizes, p, least = row[go], sym[go], rank[go], sizes[go], p[go], least[go]
            every = np.arange(len(row))
            from_ = np.minimum(col + (col > p[:, None]), width - 1)
            sym, rank = np.take_along_axis(sym, from_, 1), np.take_along_axis(rank, from_, 1)
            sizes = sizes - 1
            sym[every, p] = self.by_rank[least]
            last = p + 1 >= sizes
            rank[every, p] = np.where(last, NEVER, self.lookup(sym[every, p], np.where(last, 0, sym[every, np.minimum(p + 1, width - 1)])))
            first = p == 0
            q = np.maximum(p - 1, 0)
            rank[every, q] = np.where(first, rank[every, q], self.lookup(sym[every, q], sym[every, p]))
        return out

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in new]
        cuts = [self.greedy(b) for b in raw]
        flat = np.fromiter(chain.from_iterable(cuts), np.int64)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inside = owner[1:] == owner[:-1]
        code, where = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        fine = self.compatible(code // self.size, code % self.size)[where]
        bad = np.zeros(len(cuts), bool)
        bad[owner[1:][inside][~fine]] = True
        bad[owner[~self.whole[flat]]] = True
        failing = np.flatnonzero(bad).tolist()
        short = [k for k in failing if len(raw[k]) <= SHORT]
        for k, ids in zip(short, self.merged_short([raw[k] for k in short])):
            cuts[k] = ids
        for k in failing:
            if len(raw[k]) > SHORT:
                cuts[k] = self.merged(raw[k])
        self.failed = len(failing)
        return np.fromiter(chain.from_iterable(cuts), np.uint32), np.fromiter(map(len, cuts), np.int64, len(cuts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of counts ids."""
        data = ragged(self.text, self.text_at[ids], self.text_size[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.text_size[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_loaded: dict[str, SpeculativeBPE] = {}


def loaded(path: str) -> SpeculativeBPE:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def chunks(column: pd.Series, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of rows with about limit characters, one row at least."""
    start, total = 0, 0
    for i, t in enumerate(column):
        total += len(t)
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded: one row for each input row.

    A null or empty text has no tokens. Texts are encoded whole, however long; repeated rows alike; an empty table gives
    an empty result; other columns are ignored. path is the tokenizer's file, present on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in batches:
            for part in (pdf.iloc[s] for s in chunks(pdf.text)):
                ids, counts = bpe.encode(part.text)
                decoded = bpe.decode(ids, counts)
                runs = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                out = {"doc_id": part.doc_id.to_numpy(), "n_tokens": counts, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in runs], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}
                yield pd.DataFrame(out | ({"ids": [x.tolist() for x in runs], "decoded": decoded} if with_ids else {}))

    more = ", ids array<long>, decoded string" if with_ids else ""
    return worker_texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
