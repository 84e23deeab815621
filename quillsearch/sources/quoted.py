"""CSV with quoted fields, read by byte ranges.

A line break in a quoted field is no record's end, and where a range starts can't be told whether it is within quotes. So each range is walked
under both speculations, which gives a function from the state before it to the state after it; a prefix pass over a file's ranges (a
row for each) resolves the states. Then ranges are cut into records on their own. What a range holds of a record that
begins or ends elsewhere is put together from the pieces, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..shipping import shipped

WITHIN = re.compile(r'[^"]*+(?:""[^"]*+)*+')
FIELD = re.compile(r'"([^"]*+(?:""[^"]*+)*+)"([^,]*+)|([^,]*+)')


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes. A quote opens at the start of a field only; elsewhere it is a character."""
    if '"' not in line:
        return inside
    at = 0
    while inside or at >= 0:
        if inside or line.startswith('"', at):
            closing = WITHIN.match(line, at if inside else at + 1).end()
            if closing == len(line):
                return True
            inside, at = False, line.find(",", closing + 1)
            at = at + 1 if at >= 0 else -1
        else:
            at = line.find(',"', at)
            at = at + 1 if at >= 0 else -1
    return False


def fields(record: str) -> list[str]:
    """A record's fields; what follows a closing quote belongs to its field, a quote that nothing closes is a character."""
    if '"' not in record:
        return record.split(",")
    out, at = [], 0
    while True:
        m = FIELD.match(record, at)
        out.append(m[3] if m[1] is None else m[1].replace('""', '"') + m[2])
        at = m.end() + 1
        if at > len(record):
            return out


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start) of each line, in order within a range; start is the byte at which its range starts."""
    return spark.read.text(path, lineSep="\n").select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, start, from_out, from_in) of each range: whether it ends within quotes, from either state."""
    where, a, b = None, False, True
    found = lambda: pd.DataFrame([(*where, a, b)], columns=["file", "start", "from_out", "from_in"])
    for pdf in batches:
        for line, *here in zip(pdf.value, pdf.file, pdf.start):
            if here != where:
                if where is not None:
                    yield found()
                where, a, b = here, False, True
            if '"' in line:
                a, b = (inside_after(line, a), inside_after(line, b)) if a != b else (inside_after(line, a),) * 2
    if where is not None:
        yield found()


def resolved(ranges: DataFrame) -> DataFrame:
    """ranges with inside, the state before each, and after: the last range with one outcome counts, and how often those since change the state."""
    order = lambda *of: Window.partitionBy("file", *of).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    certain = F.col("from_out") == F.col("from_in")
    known = ranges.withColumn("last", F.coalesce(F.last(F.when(certain, F.col("from_out")), ignorenulls=True).over(order()), F.lit(False)))
    known = known.withColumn("since", F.coalesce(F.sum(certain.cast("int")).over(order()), F.lit(0)))
    changes = F.coalesce(F.sum((~certain & F.col("from_out")).cast("int")).over(order("since")), F.lit(0))
    known = known.withColumn("inside", F.col("last") != (changes % 2 == 1))
    return known.select("file", "start", "inside", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("after"))


def records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(file, start, place, text, header) of each record and piece of a record of some ranges: place 0 is the piece that ends or goes on with a record
    begun before the range, 1 a whole record, 2 the piece of a record that goes on behind the range."""
    where, held = None, []

    def rest() -> Iterator[tuple]:
        if held:
            yield (*where, 0 if lead else 2, "\n".join(held), first and not lead)

    for pdf in batches:
        for line, inside, *here in zip(pdf.value, pdf.inside, pdf.file, pdf.start):
            if here != where:
                yield from rest()
                where, held, state, lead, first = here, [], bool(inside), bool(inside), here[1] == 0
            held.append(line)
            state = inside_after(line, state)
            if not state:
                text = "\n".join(held).removesuffix("\r")
                if lead or text:  # blank lines are no records
                    yield (*where, 0 if lead else 1, text, first and not lead)
                    lead = first = False
                held = []
    yield from rest()


def batches_of(rows: Iterator[tuple], columns: list[str], size: int = 10000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files as strings, with the names that Spark gives the columns of the first file's header. Each file's first record is its header.
    Quotes are doubled, fields may hold line breaks; records end with LF or CR LF; missing and empty fields are empty strings, fields
    beyond the header are left out, blank lines are skipped, bytes that are no UTF-8 become U+FFFD. Files in gzip are one range each."""
    names = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8").columns
    names[-1:] = [n.removesuffix("\r") for n in names[-1:]]  # Spark tells ends of lines by the first break, which may be in a name
    lines = shipped(lines_of(spark, path))
    ranges = written(resolved(lines.mapInPandas(transitions, "file string, start long, from_out boolean, from_in boolean")), "csv-ranges")
    started = lines.join(F.broadcast(ranges), ["file", "start"]).select("value", "file", "start", "inside", "after")  # a row for each range, of 128 MB by default
    n = len(names)

    def row(text: str) -> list[str]:
        return (fields(text) + [""] * n)[:n]

    def wholes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batches_of(({"f": row(text)} for *_, place, text, header in records(batches) if place == 1 and not header), ["f"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batches_of((r for r in records(batches) if r[2] != 1), ["file", "start", "place", "text", "header"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"f": [row(t.removesuffix("\r")) for t in pdf.text]})

    cut = started.where("inside or after").mapInPandas(pieces, "file string, start long, place int, text string, header boolean")
    begun = F.sum((F.col("place") == 2).cast("int")).over(Window.partitionBy("file").orderBy("start", "place"))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]))  # the pieces of one record
    across = cut.withColumn("record", begun).groupBy("file", "record").agg(text.alias("text"), F.max("header").alias("header")).where("not header").select("text")
    rows = started.mapInPandas(wholes, "f array<string>").unionByName(across.mapInPandas(joined, "f array<string>"))
    return rows.select(*[F.get("f", i).alias(name) for i, name in enumerate(names)])
