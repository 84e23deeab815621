"""Catalogues and query logs made from other tables, so that the engine can run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_DOCS = """
select cast(d.doc_id as string) as card_number, substring(split_part(d.text, chr(10), 1), 1, 80) as card_title, d.text as card_description,
 concat_ws(',', split_part(d.text, ' ', 1), split_part(d.text, ' ', 2), d.lang) as card_tags, concat(d.lang, '_', d.source) as q1_value,
 concat('doc', cast(d.doc_id as string), '.html') as card_page_url,
 case d.doc_id % 5 when 0 then 'A' when 1 then 'F' when 2 then 'Y' else 'S' end as card_label_type,
 concat(cast(2002 + d.doc_id % 24 as string), '-01-01') as card_created_date,
 case when d.doc_id % 7 = 0 then 'mp3' else '' end as card_music_extn,
 case when coalesce(l.toxic, 0) = 1 then '2' else '1' end as status_id, case when coalesce(l.quality, 1) = 0 then '1' else '0' end as invalid_card,
 '' as card_thumb_extn, 'png' as card_bigimage_extn, d.source as dev_id
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""
CATALOG_PARTS = """
select cast(p_partkey as string) as card_number, p_name as card_title, concat(p_type, ' ', p_brand) as card_description,
 replace(p_name, ' ', ',') as card_tags, concat(lower(p_type), '_', replace(lower(p_brand), '#', '')) as q1_value,
 concat(replace(p_name, ' ', '_'), cast(p_partkey as string), '.html') as card_page_url,
 case p_size % 5 when 0 then 'A' when 1 then 'F' when 2 then 'Y' else 'S' end as card_label_type,
 concat(cast(2002 + p_size % 24 as string), '-01-01') as card_created_date,
 case when p_size % 7 = 0 then 'mp3' else '' end as card_music_extn, '1' as status_id, '0' as invalid_card,
 'jpg' as card_thumb_extn, '' as card_bigimage_extn, p_brand as dev_id
from {part}
"""


def docs_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG_DOCS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def parts_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG_PARTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def parts_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, times, results): each part name as a query; the same with its first two letters swapped; and written backwards."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.count("*").cast("int")
    names = part.groupBy(F.col("p_name").alias("name")).agg(n.alias("times"), F.when(F.min("p_partkey") % 4 == 0, 0).otherwise(n).cast("int").alias("results"))
    swapped = F.concat(F.substring("name", 2, 1), F.substring("name", 1, 1), F.substring("name", 3, 1 << 20))
    kinds = F.array(F.struct(F.col("name").alias("query"), "times", "results"), F.struct(swapped.alias("query"), "times", F.lit(0).alias("results")), F.struct(F.reverse("name").alias("query"), F.lit(1).alias("times"), F.lit(0).alias("results")))
    return names.select(F.explode(kinds).alias("q")).select("q.query", "q.times", "q.results", F.col("q.query").alias("query_id"))


def broad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, times, results): the first word of each name, its last two letters and its first one, as people search who know little; results are
    the rows that hold the letters, so that some match much of the catalogue. Blank queries and numbers are among them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    asked = part.select(F.explode(F.array(first, F.substring("p_name", -2, 2), F.substring("p_name", 1, 1), F.lit(" "), F.when(F.col("p_partkey") % 500 == 0, F.col("p_partkey").cast("string")))).alias("query")).where("query is not null")
    times = asked.groupBy("query").agg(F.count("*").cast("int").alias("times"))
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))  # as many as names differ
    met = times.join(names, F.contains("name", F.trim("query"))).groupBy("query").agg(F.sum("n").cast("int").alias("results"))
    return times.join(met, "query", "left").select(F.col("query").alias("query_id"), "query", "times", F.coalesce("results", F.lit(0)).alias("results"))
