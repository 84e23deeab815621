"""Reading catalogues and query logs, and writing results as JSON."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..lexicons import CATALOGUE_COLUMNS
from ..plans.index import Index
from .quoted import read_quoted

# The names under which an export is looked for, in order.
EXPORT_NAMES = ["card_database.csv", "card_database.csv.gz", "card_database.zip", "card_database.csv.zip", "cards.csv", "cards.csv.gz"]
READABLE = (".csv", ".csv.gz", ".zip")
REFUSED = {".7z": "unpack the archive and give the CSV file in it", ".xlsx": "save the sheet as CSV", ".xls": "save the sheet as CSV", ".xlsm": "save the sheet as CSV", ".ods": "save the sheet as CSV"}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue as strings, one column for each header name: CSV, CSV in gzip, or the first CSV file in a zip archive. Quotes are doubled, fields may
    hold line breaks, an empty field is an empty string; plain files are read by byte ranges. Columns that the engine reads and the file lacks are null."""
    for ending, advice in REFUSED.items():
        if path.lower().endswith(ending):
            raise ValueError(f"{path}: {ending} files can't be read; {advice}")
    if path.lower().endswith(".zip"):
        rows = _unzipped(spark, path)
    else:
        rows = read_quoted(spark, path)
    rows = rows.na.fill("")
    return rows.withColumns({c: F.lit(None).cast("string") for c in CATALOGUE_COLUMNS if c not in rows.columns})


def _opened(content: bytes):
    """The first CSV file of an archive."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = [n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX")]
    if not names:
        raise ValueError("the archive holds no CSV file")
    return z.open(names[0])


def _unzipped(spark: SparkSession, path: str) -> DataFrame:
    """Archives are read where they lie, by Spark, and unpacked on the executors, each as one unit; all columns of their headers are kept."""
    found = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"names": [list(pd.read_csv(_opened(c), dtype=str, nrows=0, encoding="utf-8").columns) for c in pdf.content]})

    names = list(dict.fromkeys(n for r in found.mapInPandas(headers, "names array<string>").collect() for n in r.names))  # one row for each archive

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf.content:
                for part in pd.read_csv(_opened(content), dtype=str, keep_default_na=False, chunksize=20000, encoding="utf-8"):
                    part = part.reindex(columns=names).astype(object)
                    yield part.where(part.notna(), None)

    return found.mapInPandas(rows, StructType([StructField(n, StringType()) for n in names]))


def find_export(explicit: str | None = None, folder: str = "data") -> str:
    """The catalogue file: the one named, else the first known name in the folder, else the only file that could be one."""
    if explicit:
        if not os.path.exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    for name in EXPORT_NAMES:
        if name in names:
            return os.path.join(folder, name)
    found = [n for n in names if n.lower().endswith(READABLE) and not n.startswith(".")]
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}: " + ("no catalogue file" if not found else f"more than one catalogue file: {', '.join(found)}"))
    return os.path.join(folder, found[0])


def read_query_log(spark: SparkSession, path: str, with_results: bool = False) -> DataFrame:
    """(query, times) or (query, times, results): tab-separated, unquoted; lines that begin with # and rows whose counts aren't integers
    are skipped, an empty query is kept as an empty string. A missing file is an empty log."""
    counts = ["times", "results"] if with_results else ["times"]
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "query string, " + ", ".join(f"{c} int" for c in counts))
    rows = spark.read.csv(path, sep="\t", header=True, quote="", comment="#", inferSchema=False)
    rows = rows.select(F.coalesce("query", F.lit("")).alias("query"), *[F.trim(c).try_cast("int").alias(c) for c in counts])
    return rows.where(" and ".join(f"{c} is not null" for c in counts))


def payload(index: Index, results: DataFrame) -> DataFrame:
    """(query_id, rank, json): what a page shows of each result of search()."""
    facets = index.facets.groupBy("doc", "kind").agg(F.sort_array(F.collect_set("value")).alias("values")).groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("facets"))
    d = index.docs.join(facets, "doc", "left")
    joined = results.select("query_id", "rank", "doc", "why").join(d, "doc")
    return joined.select("query_id", "rank", F.to_json(F.struct(*card_fields())).alias("json"))


def card_fields() -> list[Column]:
    rest = F.substring(F.col("category"), F.length("section") + 2, F.length("category"))
    default = lambda c: F.coalesce(F.nullif(F.coalesce(c, F.lit("")), F.lit("")), F.lit("gif"))
    return [
        F.col("number"), F.col("title"), F.col("description"), F.col("category"), F.col("category").alias("q1"), F.col("section").alias("occasion"),
        F.when(rest != "", rest).otherwise(F.col("section")).alias("subcat"), F.replace("url", F.lit(".html"), F.lit("")).alias("page"),
        default(F.col("card_thumb_extn")).alias("thumb_extn"), default(F.col("card_bigimage_extn")).alias("big_extn"), F.col("year"), F.col("why"), F.col("facets"),
    ]


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A URL template with {names} replaced by columns."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def request_numbers(requests: DataFrame) -> DataFrame:
    """limit and boost of a request, whatever was sent."""
    return requests.withColumns({"limit": T.clamped(F.col("limit"), 24, 1, 60), "boost": T.clamped(F.col("boost"), 0.15, 0.0, 1.0, "double")})
