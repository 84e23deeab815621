"""Merkle fixity audit of web archives.

A page becomes a WARC 1.1 record; the records of a replica, one after the other in page_id order, have byte offsets. The digests of
the records of one page_id make a leaf, and an ordered range of FANOUT leaves, cut at fixed page_ids, makes a node: its digest is that
of its children's digests in order, its offset range theirs. So it goes on up to one root. Ranges are cut by page_id and not by
ordinal or offset, so a record that is lost or added changes the nodes above it and no others; offsets are
reported, not hashed, as all records behind a lost one move. Two replicas are compared root against root, and where digests differ the
children are compared, so the work below the root follows the corruption and not the archive. What is left are the page_ids
whose records differ; within one, equal records are matched first. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: A node takes the ids that agree in all but SHIFT more bits.
SHIFT = 4
FANOUT = 1 << SHIFT
NULL_ID = -(1 << 63)


def record_id(page_id: Column, url: Column) -> Column:
    """A urn:uuid of the page, the same each time."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record(page_id: Column, url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A WARC resource record of a page, as text; the block is the page's UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: "), record_id(page_id, url), F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "))
    return F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def header(text: Column, name: str) -> Column:
    """A header field of a record."""
    return F.regexp_extract(text, rf"^WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?{name}: ?([^\r\n]*)\r\n", 1)


def block(text: Column) -> Column:
    """The block of a record."""
    return F.regexp_extract(text, r"(?s)^WARC/1\.1\r\n(?:[^\r\n]+\r\n)+\r\n(.*)\r\n\r\n$", 1)


def leaves(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, ordinal, start, stop, digest) of each record, in page_id order, ties by digest. Null ids come first."""
    n = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = record(pages["page_id"].cast("long"), pages["url"], pages["html"])
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # many copies of one record are in many ranges
    rows = written(rows.repartitionByRange(n, "page_id", "digest", "copy").withColumn("part", F.spark_partition_id()), "leaves")  # no texts
    here = Window.partitionBy("part").orderBy("page_id", "digest", "copy")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("part", "page_id", "size", "digest", (F.row_number().over(here) - 1).alias("i"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))  # one row for each range
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("first"), F.coalesce(F.sum("bytes").over(all_before), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("at")
    return rows.join(F.broadcast(parts), "part").select("page_id", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (start + F.col("size")).alias("stop"), "digest")


def entries(leaf: DataFrame) -> DataFrame:
    """Equal records of one page_id as one row: how many, and the first one's ordinal; they follow one another."""
    return leaf.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def joined_digest(*parts: Column) -> Column:
    """The digest of the group's parts in order."""
    children = F.array_sort(F.collect_list(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])))
    return F.sha2(F.concat_ws(" ", F.transform(children, lambda x: F.concat_ws(":", *[x[f"k{i}"].cast("string") for i in range(len(parts))]))).cast("binary"), 256)


def ranged(level: DataFrame, node: Column, *parts: Column) -> DataFrame:
    return level.groupBy(node.alias("node")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), joined_digest(*parts).alias("digest"))


def id_level(entry: DataFrame) -> DataFrame:
    """A node for each page_id: (node, start, stop, digest). The records of one are first put together by the start of their digest, so
    that one id of very many records is no single list."""
    by_start = entry.groupBy(F.coalesce("page_id", F.lit(NULL_ID)).alias("id"), F.substring("digest", 1, 3).alias("at"))
    by_start = by_start.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), joined_digest(F.col("digest"), F.col("n")).alias("digest"))
    return written(ranged(by_start, F.col("id"), F.col("at"), F.col("digest")), "tree-level")


def trees(ours: DataFrame, theirs: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The levels of both trees, from the page_ids up to the root, of equal height."""
    out, depth = [(id_level(ours), id_level(theirs))], 0
    while max(level.count() for level in out[-1]) > FANOUT:  # after 15 levels there are 16 nodes at most
        depth += 1
        out.append(tuple(written(ranged(level, F.shiftright("node", SHIFT), F.col("node"), F.col("digest")), "tree-level") for level in out[-1]))
    out.append(tuple(ranged(level, F.lit(0).cast("long"), F.col("node"), F.col("digest")) for level in out[-1]))
    return out


def differing(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(node): page_ids whose records differ between two trees (NULL_ID for null), those that only one has included."""
    suspects = None
    for k, (a, b) in enumerate(reversed(levels)):
        if k > 1:  # below the root come all its children
            up = suspects.select(F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.shiftright("node", SHIFT)).join(up, "up", "left_semi") for x in (a, b))
        pairs = a.select("node", F.col("digest").alias("a")).join(b.select("node", F.col("digest").alias("b")), "node", "full_outer")
        suspects = written(pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "suspects")
        if suspects.isEmpty():
            break
    return suspects


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """ordinal, page_id, start_offset, stop_offset, digest, replica_digest, status: one row for each record of either replica.

    status is ok, corrupt (the replica has another record of that page_id in its place), missing (it has none) or extra (it has more,
    then ordinal and digest are null and the offsets are the replica's). Records of one page_id are matched if equal, as
    often as both have them, and what is left is paired in digest order. Null urls and pages are empty, null ids are one id and come
    first; very long pages are hashed whole; with two empty tables the result is empty; other columns are ignored.
    """
    a, b = written(leaves(pages), "ours"), written(leaves(replica), "theirs")
    ea, eb = written(entries(a), "our-entries"), written(entries(b), "their-entries")
    bad = differing(trees(ea, eb))
    key = F.coalesce("page_id", F.lit(NULL_ID)).alias("id")
    ea, eb = (e.select(key, "digest", "n", "first").join(bad.withColumnRenamed("node", "id"), "id", "left_semi") for e in (ea, eb))
    held = ea.select("id", "digest", F.col("n").alias("na"), F.col("first").alias("fa")).join(eb.select("id", "digest", F.col("n").alias("nb"), F.col("first").alias("fb")), ["id", "digest"], "full_outer")
    held = written(held.fillna(0, ["na", "nb"]).where("na <> nb"), "unmatched")
    place = Window.partitionBy("id").orderBy("digest", "ordinal")

    def left_over(mine: str, other: str, first: str) -> DataFrame:
        """The records of one side beyond those that the other has too."""
        rows = held.where(F.col(mine) > F.col(other)).select("id", "digest", F.explode(F.sequence(F.col(first) + F.col(other), F.col(first) + F.col(mine) - 1)).alias("ordinal"))
        return rows.withColumn("nth", F.row_number().over(place))

    x, y = left_over("na", "nb", "fa"), left_over("nb", "na", "fb")
    y = y.join(b.select("ordinal", "start", "stop"), "ordinal").select("id", "nth", F.col("digest").alias("replica_digest"), F.col("start").alias("their_start"), F.col("stop").alias("their_stop"))
    bad = written(x.select("id", "nth", "ordinal").join(y, ["id", "nth"], "full_outer"), "unpaired")
    ours = a.join(bad.where("ordinal is not null").select("ordinal", "replica_digest", F.lit(True).alias("bad")), "ordinal", "left")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("replica_digest").isNull(), "missing").otherwise("corrupt")
    theirs = F.when(F.col("bad").isNull(), F.col("digest")).otherwise(F.col("replica_digest"))
    ours = ours.select("ordinal", "page_id", F.col("start").alias("start_offset"), F.col("stop").alias("stop_offset"), "digest", theirs.alias("replica_digest"), status.alias("status"))
    extra = bad.where("ordinal is null").select("ordinal", F.when(F.col("id") != NULL_ID, F.col("id")).alias("page_id"), F.col("their_start").alias("start_offset"), F.col("their_stop").alias("stop_offset"), F.lit(None).cast("string").alias("digest"), "replica_digest", F.lit("extra").alias("status"))
    return ours.unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage of known places: by the digest of the url the first < of some pages reads #, some pages are lost,
    some are there twice."""
    at = lambda lo, hi: F.coalesce(F.expr(f"md5(url) >= '{lo}' and md5(url) < '{hi}'"), F.lit(False))
    out = pages.withColumn("html", F.when(at("00", "06"), F.regexp_replace("html", "^<", "#")).otherwise(F.col("html")))
    return out.where(~at("06", "08")).unionByName(out.where(at("08", "0a")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


ORACLE = r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, coalesce(md5(url), 'z') as h, md5(concat_ws(' ', page_id, coalesce(url, ''))) as u from pages),
q as (select *, false as theirs from p union all
      select page_id, url, case when h < '06' then regexp_replace(html, '^<', '#') else html end, h, u, true from p where not (h >= '06' and h < '08') union all
      select *, true from p where h >= '08' and h < '0a'),
r as (select page_id, theirs, html, chr(13) || chr(10) as nl,
             concat_ws('-', substr(u, 1, 8), substr(u, 9, 4), substr(u, 13, 4), substr(u, 17, 4), substr(u, 21, 12)) as uuid, url from q),
t as (select page_id, theirs, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || uuid || '>' || nl || 'WARC-Target-URI: ' || url || nl
             || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || cast(strlen(html) as varchar) || nl || nl || html || nl || nl as rec from r),
d as (select page_id, theirs, strlen(rec) as n, sha256(rec) as digest, row_number() over () as k from t),
o as (select *, row_number() over w - 1 as ordinal, row_number() over (partition by theirs, page_id order by digest, k) as nth,
             sum(n) over (partition by theirs order by page_id, digest, k rows between unbounded preceding and current row) as stop
      from d window w as (partition by theirs order by page_id, digest, k)),
x as (select * from o where not theirs),
y as (select * from o where theirs)
select x.ordinal, x.page_id, cast(x.stop - x.n as bigint) as start_offset, cast(x.stop as bigint) as stop_offset, x.digest, y.digest as replica_digest,
       case when y.digest is null then 'missing' when x.digest = y.digest then 'ok' else 'corrupt' end as status
from x left join y on x.page_id = y.page_id and y.nth = 1
union all
select null, page_id, cast(stop - n as bigint), cast(stop as bigint), null, digest, 'extra' from y where nth > 1
"""
