"""Quality by a log-likelihood ratio of hashed n-grams, next to plain counts.

Tokens are runs of letters, digits and _ or runs of other characters between white space; unigrams and bigrams of them
are hashed into a fixed number of buckets. Two multinomials over the buckets are counted: one over the trusted
documents (those that the label table gives the trusted quality), one over the whole corpus. A document's score is the
mean of log(p_trusted / p_corpus) over its n-grams, so it doesn't depend on length, and each document is compared with
the same threshold. DataFrame functions only; the model is as long as the bucket count, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts, words, written

BUCKETS = 8192
THRESHOLD = -0.25
SMOOTHING = 1.0
#: Labels up to this many rows (12 bytes each) go to each executor; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
TOKEN = rf"([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+)"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the unigrams and bigrams of a text."""

    def both(t: Column) -> Column:
        one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(t, lambda x, i: F.pmod(F.xxhash64(x, F.get(t, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(one, F.slice(two, 1, F.greatest(F.size(t) - 1, F.lit(0))))

    return let(F.regexp_extract_all(text, F.lit(TOKEN)), both)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: Column | None = None, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_trusted / p_corpus) of each bucket, from all documents. trusted: which label rows vouch for their document,
    by default those of quality 1. Without any of them the ratio is 0 everywhere and nothing is rejected by it."""
    vouched = labels.where(F.col("quality") == 1 if trusted is None else trusted).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    if labels.count() <= BROADCAST_LABELS:
        vouched = F.broadcast(vouched)
    grams = texts(docs).join(vouched, "doc_id", "left").select("trusted", F.explode(ngram_buckets(F.col("text"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("n"), F.count("trusted").alias("t")).select("b", "n", "t").collect()  # a row for each bucket at most
    if not any(r.t for r in counts):
        return [0.0] * buckets
    import math

    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for r in counts:
        raw[r.b] += r.n
        target[r.b] += r.t
    n, t = sum(raw), sum(target)
    return [math.log(x / t) - math.log(y / n) for x, y in zip(target, raw)]


def log_ratio(text: Column, weights: list[float]) -> Column:
    """Mean log ratio over the n-grams of a text; 0 without any."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1)) / F.greatest(F.size(b), F.lit(1))
    return let(ngram_buckets(text, len(weights)), total)


def repeated_words(w: Column) -> Column:
    """How many words stand in a window of three words that the text has twice or more."""

    def counted(t: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda x, k: F.get(s, k)["t"] == x["t"]
            twice = F.filter(s, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        tagged = F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(F.array_sort(tagged), marked))

    # a window is named by its text; words hold no space
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(windows, counted)


def rule_columns(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), of)


def base_failed(rules: Column) -> Column:
    return (rules["n_words"] < 50) | (100 * rules["n_repeat_words"] > 50 * rules["n_words"])


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs with all its columns, __rules (the counts), __score and __kept."""
    weights = fit(docs, labels, buckets)
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.withColumns({"__rules": rule_columns(text), "__score": log_ratio(text, weights)})
    return out.withColumn("__kept", ~base_failed(F.col("__rules")) & (F.col("__score") >= threshold))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and score (the mean log ratio): one row for each input row.

    A null or empty text has no words and fails; very long texts are read whole; repeated rows are judged alike; an empty
    table gives an empty result; labels with null ids vouch for nothing and other columns are ignored.
    """
    d = judged(docs.select("doc_id", "text"), labels, threshold, buckets)
    return d.select("doc_id", "__rules.*", base_failed(F.col("__rules")).alias("base_failed"), F.col("__kept").alias("kept"), F.col("__score").alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all its columns, without the rejected rows."""
    return judged(docs, labels, threshold).where("__kept").drop("__rules", "__score", "__kept")
