"""Toxicity of documents: the softmax of the subword-bag classifier over the bag of a document's most telling windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_texts
from .subword import Scorer, scored, train

THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each input row.

    Learns from labels.toxic of the rows that aren't held out (crc32 of the id as text, mod 4, is not 2); nothing but the
    text enters a score. A null or empty text gets the share of toxic rows among the labelled ones. A null doc_id is not held out. Texts are read
    whole; repeated rows score alike; without usable labels every score is 0; an empty table gives an empty result; other
    columns are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    model = train(docs, known.where(~held_out(F.col("doc_id"))), 2, **options)
    if model is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    else:

        def judged(scorer: Scorer, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "score": scorer.documents(part.text.tolist())[0][:, 1]})

        rows = scored(worker_texts(docs), model, judged, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
