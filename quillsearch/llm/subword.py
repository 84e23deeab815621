"""Subword-bag text classification: embeddings of hashed character n-grams, averaged, under a linear softmax.

A word's vector is the mean of the vectors of its n-grams of 3 to 6 bytes (with < and > as its ends), a bag's vector the
mean over its words, and embeddings and softmax are trained together in numpy by Adagrad. A word that was never seen shares
the n-grams of those that were. As everything after the embedding is linear up to the softmax, a trained model is one
row of class scores for each n-gram bucket, and scoring a text adds up numbers that are computed once for each distinct word.

Texts are read as windows of WINDOW words, so that a few telling words weigh the same in long and short texts. A document's bag is
that of the TOP windows that tell most against class 0, and the model is trained on just such bags.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks, ragged
from .common import worker_texts, written

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW = 16
#: Most telling windows of a document that speak for it.
TOP = 4
EDGES = b".,;:!?\"'()[]"
CACHE_WORDS = 300_000
#: Words whose n-grams are worked out at a time.
PART = 50_000
#: Bounds of the sample of labelled rows that a model is fitted on: documents of each class, and characters of one of them (longer
#: documents are not in the sample): 180 million characters in all at most, whatever the corpus.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().split()


def hashed(code: np.ndarray, k: int) -> np.ndarray:
    """The buckets of n-grams of k + 1 bytes."""
    return ((code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64) % BUCKETS


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words between < and >, each word's size, and of each byte how many there are from it to its word's end."""
    out = [b"<" + (w.strip(EDGES) or w) + b">" for w in words]
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    data = np.frombuffer(b"".join(out) + bytes(8), np.uint8).astype(np.uint64)
    return data, sizes, np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))


def word_scores(words: list[bytes], model: np.ndarray) -> np.ndarray:
    """The mean of each word's rows of the model: summed byte by byte, then over the bytes of a word."""
    data, sizes, left = framed(words)
    n, starts = len(left), np.cumsum(sizes) - sizes
    columns = [np.append(c, np.float32(0)) for c in model[:BUCKETS].T]  # the last for bytes where no n-gram starts
    code, found, totals = np.zeros(n, np.uint64), np.empty(n, np.float32), [np.zeros(n, np.float32) for _ in columns]
    for k in range(max(SIZES)):
        code |= data[k : n + k] << np.uint64(8 * k)
        if k + 1 in SIZES:
            at = hashed(code, k)
            at[left <= k] = BUCKETS
            for column, total in zip(columns, totals):
                total += np.take(column, at, out=found, mode="clip")
    counts = sum(np.maximum(sizes - k + 1, 0) for k in SIZES)
    return np.stack([np.add.reduceat(t, starts) for t in totals], 1) / counts[:, None]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's n-grams in one array, and the number of each; one at least."""
    data, sizes, left = framed(words)
    n = len(left)
    owner = np.repeat(np.arange(len(words)), sizes)
    code, found, owners = np.zeros(n, np.uint64), [], []
    for k in range(max(SIZES)):
        code = code | data[k : n + k] << np.uint64(8 * k)
        if k + 1 in SIZES:
            at = np.flatnonzero(left > k)
            found.append(hashed(code[at], k))
            owners.append(owner[at])
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(words))


def means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of runs of rows."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(values, starts, axis=0) / counts[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Trainer:
    def __init__(self, docs: Iterable[list[bytes]], labels: np.ndarray, classes: int, dim: int = 8, seed: int = 1):
        self.labels, self.classes = labels, classes
        index: dict[bytes, int] = {}
        flat = [np.fromiter((index.setdefault(w, len(index)) for w in d or [b" "]), np.int32) for d in docs]  # one list of words at a time
        words = list(index)
        cut = [subwords(words[i : i + PART]) for i in range(0, len(words), PART)]
        self.grams, self.gram_counts = np.concatenate([g.astype(np.int32) for g, _ in cut]), np.concatenate([n for _, n in cut])
        del index, words, cut
        self.gram_at = np.cumsum(self.gram_counts) - self.gram_counts
        self.bags = [x[i : i + WINDOW] for x in flat for i in range(0, len(x), WINDOW)]
        self.bag_doc = np.repeat(np.arange(len(flat)), [-(-len(x) // WINDOW) for x in flat])
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.e = rng.uniform(-0.5, 0.5, (BUCKETS, dim)) / dim
        self.w, self.b = rng.normal(0, 0.5, (dim, classes)), np.zeros(classes)
        self.ge, self.gw, self.gb = np.full(BUCKETS, 1e-8), np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)

    def step(self, bags: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        words, where = np.unique(np.concatenate(bags), return_inverse=True)
        counts = self.gram_counts[words]
        grams = ragged(self.grams, self.gram_at[words], counts)
        vectors = means(self.e[grams], counts)
        h = means(vectors[where], sizes)
        d = softmax(h @ self.w + self.b)
        d[np.arange(len(y)), y] -= 1
        dh = (d @ self.w.T) / sizes[:, None]
        gw, gb = h.T @ d, d.sum(0)
        per_token = np.repeat(dh, sizes, axis=0)
        order = np.argsort(where, kind="stable")
        dv = np.add.reduceat(per_token[order], np.cumsum(np.bincount(where)) - np.bincount(where), axis=0) / counts[:, None]
        order = np.argsort(grams, kind="stable")
        touched, starts = np.unique(grams[order], return_index=True)
        de = np.add.reduceat(np.repeat(dv, counts, axis=0)[order], starts, axis=0)
        self.ge[touched] += (de**2).mean(1)
        self.e[touched] -= rate * de / np.sqrt(self.ge[touched])[:, None]
        self.gw += gw**2
        self.gb += gb**2
        self.w -= rate * gw / np.sqrt(self.gw)
        self.b -= rate * gb / np.sqrt(self.gb)

    def fit(self, epochs: int = 5, batch: int = 256, rate: float = 0.2) -> np.ndarray:
        """Class scores of each bucket, and in the last row the bias. The first epoch takes all windows; then a document speaks through
        its bag of most telling windows and the two first of these, and as many windows at random tell of class 0."""
        bags, y = self.bags, self.labels[self.bag_doc]
        for epoch in range(epochs):
            if epoch:
                order, nth = ranked(self.bag_doc, -self.probabilities()[:, 0])
                clean = np.flatnonzero(self.labels[self.bag_doc] == 0)
                top = order[nth < 2]
                use = np.concatenate([top, self.rng.choice(clean, min(len(clean), len(top)), replace=False)])
                own = order[nth < TOP]
                own = np.split(own, np.flatnonzero(np.diff(self.bag_doc[own])) + 1)
                bags = [self.bags[i] for i in use] + [np.concatenate([self.bags[i] for i in x]) for x in own]
                y = self.labels[np.concatenate([self.bag_doc[use], [self.bag_doc[x[0]] for x in own]])]
            each = self.rng.permutation(len(bags))
            for k in range(0, len(each), batch):
                part = each[k : k + batch]
                self.step([bags[i] for i in part], y[part], rate)
        return np.vstack([self.e @ self.w, self.b]).astype(np.float32)

    def probabilities(self) -> np.ndarray:
        by_bucket, ends = self.e @ self.w, np.cumsum(self.gram_counts)
        table = np.concatenate([means(by_bucket[self.grams[ends[i] - self.gram_counts[i] : ends[min(i + PART, len(ends)) - 1]]], self.gram_counts[i : i + PART]) for i in range(0, len(ends), PART)])
        sizes = np.fromiter(map(len, self.bags), np.int64, len(self.bags))
        return softmax(means(table[np.concatenate(self.bags)], sizes) + self.b)


def ranked(doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by document and falling p, and the place of each within its document."""
    order = np.lexsort((-p, doc))
    return order, np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])


def train(docs: DataFrame, labelled: DataFrame, classes: int, calibrated: bool = False, sample_docs: int = SAMPLE_DOCS, **options) -> np.ndarray | None:
    """Fits a model on a bounded sample: of class 0 of labelled (doc_id, label) the 2 * sample_docs documents that hash lowest,
    of other classes sample_docs, of documents of up to SAMPLE_CHARS characters. One executor task fits it. calibrated: the bias is that of the
    classes' shares among all labelled documents, not in the sample. The last row has these shares' logarithms, for texts without
    words. None if there is nothing to learn from."""
    rows = worker_texts(docs).withColumn("h", F.xxhash64("doc_id", "text"))
    labelled = labelled.groupBy("doc_id").agg(F.min("label").alias("label"))
    keys = written(rows.select("doc_id", "h", (F.length("text") <= SAMPLE_CHARS).alias("short")).join(labelled, "doc_id").distinct(), "labelled-rows")
    shares = {r.label: r["count"] for r in keys.groupBy("label").count().collect()}  # a row for each class; documents of any length
    keys = keys.where("short").drop("short")
    chosen = [r for k in range(classes) for r in keys.where(F.col("label") == k).orderBy("h", "doc_id").limit(sample_docs * (1 + (k == 0))).collect()]
    if not chosen:
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], keys.schema))  # at most (classes + 1) * sample_docs rows
    sample = rows.join(picked, ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    prior = np.array([shares.get(k, 0) + 0.5 for k in range(classes)])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "h": [], "text": [], "label": []}), *batches])
        if len(rows):
            rows = rows.sort_values(["doc_id", "h"])
            trainer = Trainer((tokens(t) for t in rows.text), rows.label.to_numpy(np.int64), classes)
            model = trainer.fit(**options)
            share = np.log(prior / prior.sum())
            if calibrated:
                seen = np.bincount(trainer.labels, minlength=classes) + 0.5
                model[-1] += share - np.log(seen / seen.sum())
            model = np.vstack([model, share]).astype(np.float32)
            yield pd.DataFrame({"model": [model.tobytes()]})

    got = sample.repartition(1).mapInPandas(fit, "model binary").collect()
    return np.frombuffer(bytes(got[0].model), np.float32).reshape(BUCKETS + 2, classes) if got else None


class Seen(dict):
    """word -> number, given out on first sight."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Class scores under a model, remembered for each distinct word."""

    def __init__(self, model: np.ndarray):
        self.model, self.classes = model, model.shape[1]
        self.forget()

    def forget(self) -> None:
        self.index, self.table = Seen(), np.zeros((0, self.classes), np.float32)

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows: the index of the text, words, and the sum of their class scores without the bias. A text without words
        has one window of no words."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        cut = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        new, self.index.new = self.index.new, []
        if new:
            self.table = np.vstack([self.table, *(word_scores(new[i : i + PART], self.model).astype(np.float32) for i in range(0, len(new), PART))])
        per = np.maximum(-(-sizes // WINDOW), 1)
        doc = np.repeat(np.arange(len(cut)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        words = np.minimum(sizes[doc] - nth * WINDOW, WINDOW)
        total = np.zeros((len(doc), self.classes))
        some = words > 0
        if some.any():
            total[some] = np.add.reduceat(self.table[codes], (np.cumsum(words) - words)[some], axis=0)
        return doc, words, total

    def judged(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The softmax over the mean of bags of so many words with so large sums; the classes' shares for a bag without words."""
        mean = total / np.maximum(words, 1)[:, None] + self.model[BUCKETS]
        return softmax(np.where(words[:, None] > 0, mean, self.model[BUCKETS + 1]))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of each text, by the bag of its TOP most telling windows, and its number of words."""
        doc, words, total = self.windows(texts)
        order, nth = ranked(doc, -self.judged(total, words)[:, 0])
        top = order[nth < TOP]
        add = lambda x: np.bincount(doc[top], x[top], len(texts))
        p = self.judged(np.stack([add(total[:, k]) for k in range(self.classes)], 1), add(words))
        return p, np.bincount(doc, words, len(texts)).astype(np.int64)


def scored(docs: DataFrame, model: np.ndarray, fold, schema: str) -> DataFrame:
    """fold(scorer, rows) -> frame, over texts in parts of bounded size; docs has doc_id and text. The model is a few MB whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            for part in (pdf.iloc[s] for s in chunks(pdf.text)):
                yield fold(scorer, part)

    return docs.mapInPandas(run, schema)
