"""What the operators of this subpackage share: words, tables, shared scratch space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..shipping import shipped

#: ASCII white space, as a character class body; words are maximal runs of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

__all__ = ["SPACE", "WORD", "block_count", "give_back", "joined_key", "keep_rows", "table", "texts", "words", "worker_texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else the table holds; a null text is an empty one."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def worker_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """texts() for an operator with Python on the executors."""
    return texts(shipped(docs), id_col, text_col)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def give_back() -> None:
    """Returns a worker's freed memory to the system: between large groups, Python's and Arrow's allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = 12 << 20) -> int:
    """How many blocks of about block_bytes of text the table makes."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def joined_key(*parts: Column) -> Column:
    """One string that is never null and names the parts; parts hold no |."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of docs whose keys are in kept, one of those that agree in all keys. One exchange of docs: what follows the
    join groups by its key."""
    left = docs.withColumn("__key", joined_key(*keys.values()))
    right = kept.select(joined_key(*map(F.col, keys)).alias("__key"))
    return left.join(right, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
