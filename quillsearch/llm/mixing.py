"""Mixing by soft membership: document rates whose expected token totals by domain match target weights.

A classifier trained on a labelled table gives each document a posterior over the domains (with the domains' shares among the
labelled rows as prior), and so its tokens in each domain in expectation. The rates r >= 0 minimise

    1/2 sum_k ((sum_d r_d a_dk - b_k) / s_k)^2 + ridge/2 mean_d (r_d - 1)^2

(a: expected tokens, b: targets, s: scale). At the minimum r_d = max(0, 1 - u . a_d) for one K-vector u, which minimises a convex
function of K variables, quadratic in pieces: Newton steps on it, with the K x K curvature of the documents whose rate
is over 0, reach the minimum in a few rounds. A round needs one small aggregate over the table of expectations; each document's
rate follows from the K-vector, so that no state is kept or shuffled.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_key, words, worker_texts, written
from .subword import Scorer, scored, train

log = logging.getLogger(__name__)

DOMAINS = ("clean", "toxic", "low_quality")
#: Target share of the expected tokens of each domain.
TARGET = (0.98, 0.005, 0.015)
#: A bound on Newton steps, far over what they take; whether the minimum was reached is reported.
STEPS = 200
#: The minimum is reached where no total is further from where the objective is flat, by its goal.
SETTLED = 1e-6
#: A target is met if the total is so near, by its goal; the ridge alone keeps totals a little off.
MET = 0.05
RIDGE = 1e-5
#: The stage, whose rates are at most 1, is content with totals so near their goals, and its ridge keeps its steps few.
ENOUGH, STAGE_RIDGE = 0.01, 1e-2
#: The classifier's sample: so many documents of each domain, twice as many clean ones.
SAMPLE_DOCS = 1000


def domain(quality: Column, toxic: Column) -> Column:
    """Index into DOMAINS of a labelled row."""
    return F.when(toxic == 1, 1).when(quality == 0, 2).otherwise(0)


def expected_tokens(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, sha, n_words, tokens): each document's words and, in expectation, its words in each domain; sha is that of its text."""
    k = len(DOMAINS)
    known = labels.where("doc_id is not null and (quality in (0, 1) or toxic in (0, 1))")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0))).alias("label"))
    model = train(docs, known, k, True, **({"sample_docs": SAMPLE_DOCS} | options))

    def totals(scorer: Scorer, part: pd.DataFrame) -> pd.DataFrame:
        p, n = scorer.documents(part.text.tolist())
        return pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "sha": part.sha, "n_words": n, "tokens": list(p * n[:, None])})

    rows = worker_texts(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    if model is None:  # nothing to learn from: every domain alike
        even = rows.select("doc_id", "sha", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        return even.select("doc_id", "sha", "n_words", F.array(*[F.col("n_words") / k] * k).alias("tokens"))
    return scored(rows, model, totals, "doc_id long, sha string, n_words long, tokens array<double>")


def rate_at(pull: np.ndarray, most: float | None = None) -> Column:
    """The rate max(0, 1 - pull . tokens), and not over most."""
    rate = F.greatest(F.lit(0.0), way_at(pull))
    return rate if most is None else F.least(rate, F.lit(float(most)))


def way_at(pull: np.ndarray) -> Column:
    return F.lit(1.0) - sum((F.get("tokens", k) * float(x) for k, x in enumerate(pull)), F.lit(0.0))


def fitted_rates(expected: DataFrame, target: tuple[float, ...] = TARGET, total: float | None = None, steps: int = STEPS, ridge: float = RIDGE, most: float | None = None, enough: float = 0.0) -> tuple[DataFrame, dict]:
    """expected with the column rate, and how the totals came out: of each domain the tokens before (have), the goal (target), the
    tokens at the rates (got), whether the goal is met within MET of itself (met), and whether the rates are the minimum within
    SETTLED (settled). No rates of a lower objective meet a goal that is missed at settled rates. total: expected tokens of the mix; by
    default as many as leave the domain of the largest target whole. most: a bound on rates, 1 where rows can only be left out; a domain
    that then can't reach its target has all that it can give as its goal. enough: the steps end once all totals are so near their goals, by
    these; the rates then need not be the minimum."""
    k = len(target)
    first = expected.agg(*[F.sum(F.get("tokens", i)).alias(f"s{i}") for i in range(k)], F.count("*").alias("n")).first()
    have = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    if not first.n or not have.sum():
        return expected.withColumn("rate", F.lit(1.0)), {"have": have.tolist(), "target": have.tolist(), "got": have.tolist(), "met": [True] * k, "settled": True}
    share = np.array(target) / sum(target)
    lead = max((k for k in range(k) if have[k] > 0), key=lambda k: share[k])
    total = total or (have[lead] / share[lead] if share[lead] > 0 else have.sum())
    goal = share * total if most is None else np.minimum(share * total, most * have)
    # misses are told by the goal, so that a domain of few tokens counts as much as one of many; without a goal by the tokens there are
    some, scale = have > 0, np.where(goal > 0, goal, np.maximum(have, 1.0)) if most is None else np.maximum(have, 1.0)
    unit = np.where(some, first.n / scale, 0.0)
    want = np.where(some, goal / scale, 0.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Value, gradient and curvature of the function of u, and the totals by their scale."""
        rate, way, token = rate_at(u * unit, most), way_at(u * unit), lambda i: F.get("tokens", i) * float(unit[i])
        free = rate > 0 if most is None else (rate > 0) & (rate < most)
        sums = [F.avg(2 * rate * way - rate * rate).alias("v")] + [F.avg(token(i) * rate).alias(f"g{i}") for i in range(k)]
        row = expected.agg(*sums, *[F.avg(F.when(free, token(i) * token(j)).otherwise(0.0)).alias(f"h{i}_{j}") for i, j in pairs]).first()
        got, curve = np.array([row[f"g{i}"] for i in range(k)]), ridge * np.eye(k)
        for i, j in pairs:
            curve[i, j] += row[f"h{i}_{j}"]
            curve[j, i] = curve[i, j]
        return (ridge * u @ u + row.v) / 2 + u @ want, ridge * u + want - got, curve, got

    u = np.zeros(k)
    value, slope, curve, got = at(u)
    settled = lambda: bool(np.all(np.abs(slope) <= SETTLED * np.maximum(want, SETTLED)))
    for _ in range(steps):
        if settled() or np.all(np.abs(got - want) <= enough * want):
            break
        near = 0.0 if most is None else 0.1 * float(np.linalg.norm(slope))  # where most rates are at a bound there is little curvature
        way, size = -np.linalg.solve(curve + near * np.eye(k), slope), 1.0
        while True:
            then = at(u + size * way)
            if then[0] <= value + 1e-4 * size * (slope @ way) + 1e-15 * abs(value) or size < 1e-9:
                break
            size /= 2
        u = u + size * way
        value, slope, curve, got = then
    met = np.abs(got * scale - goal) <= MET * np.maximum(goal, 1)
    return expected.withColumn("rate", rate_at(u * unit, most)), {"have": have.tolist(), "target": goal.tolist(), "got": (got * scale).tolist(), "met": met.tolist(), "settled": settled()}


def mixture(docs: DataFrame, labels: DataFrame, target: tuple[float, ...] = TARGET, most: float | None = None, enough: float = 0.0, ridge: float = RIDGE, **options) -> tuple[DataFrame, dict]:
    """The rows of mixed(), with sha, and how the totals of the domains came out, as of fitted_rates(); what is missed is logged."""
    expected = written(expected_tokens(docs, labels, **options), "expected-tokens")
    rates, outcome = fitted_rates(expected, target, most=most, enough=enough, ridge=ridge)
    if not outcome["settled"] and not all(outcome["met"]):
        log.warning("the rates are not the minimum yet: %s", outcome)
    for name, met, goal, got in zip(DOMAINS, outcome["met"], outcome["target"], outcome["got"]):
        if not met:
            log.warning("target of %s not reached: %.0f expected tokens, goal %.0f", name, got, goal)
    share = lambda i: F.when(F.col("n_words") > 0, F.get("tokens", i) / F.col("n_words")).otherwise(F.lit(1 / len(DOMAINS)))
    return rates.select("doc_id", "sha", "n_words", *[share(i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate"), outcome


def mixed(docs: DataFrame, labels: DataFrame, target: tuple[float, ...] = TARGET, **options) -> DataFrame:
    """doc_id, n_words, a share of each domain (p_clean, p_toxic, p_low_quality), rate: one row for each input row.

    A null or empty text has no tokens, even shares and the rate 1. Texts are read whole; repeated rows get equal rates;
    without labels all domains are alike; an empty table gives an empty result; other columns are ignored. A target that the
    rates don't reach is logged as a warning; mixture() returns the totals.
    """
    return mixture(docs, labels, target, **options)[0].drop("sha")


def thinned(docs: DataFrame, labels: DataFrame, target: tuple[float, ...] = TARGET, **options) -> DataFrame:
    """docs with all its columns, each row kept with its rate, at most 1, as probability: by a hash of its id and text, so the same rows
    each time. Rows are told apart by id and text, those that agree in both stay or go together. A text without words stays;
    an empty table gives an empty result; columns named like those of mixed() are kept as they are."""
    rates = mixture(docs, labels, target, 1.0, ENOUGH, STAGE_RIDGE, **options)[0].groupBy(joined_key(F.col("doc_id"), F.col("sha")).alias("__key")).agg(F.min("rate").alias("__rate"))
    key = joined_key(docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col("__key")), F.lit(1 << 30)) / float(1 << 30)
    placed = docs.withColumn("__key", key).join(rates, "__key")
    return placed.where(u < F.col("__rate")).drop("__key", "__rate")
