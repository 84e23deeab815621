"""Fill-in-the-middle examples: a text is cut at two places that its id decides, and its parts change places.

Places are counted in units: runs of characters of one class (white space or anything else), cut into at most `width` code points, from
left to right. One Aho-Corasick automaton goes over a text once and reports its events: the ASCII characters at which the class
changes, and the sentinels that mark the parts. Between two events nothing changes, so a gap of g code points holds
ceil(g / width) units; the running counts of the events are all that is kept of a text, and where unit u begins is a search in
them and a multiplication. With a width of 1 a unit is a code point, without a width a word or the space between two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
BREAKS = " \t\n\x0b\x0c\r"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CUTS = "units long, first long, second long, middle_words long, marked boolean"


@dataclass(frozen=True)
class Units:
    """How a text is counted: characters of breaks are one class, all others another; width is the most code points of a unit."""

    width: int | None = 1
    breaks: str = BREAKS


class Scan:
    """The automaton of the characters and sentinels that matter; one for each worker process and kind of units."""

    _made: dict[Units, Scan] = {}

    def __init__(self, units: Units):
        import ahocorasick

        self.units, self.automaton = units, ahocorasick.Automaton()
        for c in units.breaks:
            self.automaton.add_word(c, 0)
        for s in SENTINELS:
            self.automaton.add_word(s, 1)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, units: Units) -> Scan:
        if units not in cls._made:
            cls._made[units] = cls(units)
        return cls._made[units]

    def events(self, text: str) -> tuple[np.ndarray, bool]:
        """Positions of the class-changing characters in order, and whether any sentinel occurs."""
        found = np.fromiter((end << 1 | kind for end, kind in self.automaton.iter(text)), np.int64)
        marks = found & 1
        return (found >> 1)[marks == 0], bool(marks.any())

    def cuts(self, text: str, one: int, two: int) -> tuple[int, int, int, int, bool]:
        """Units of the text; where the unit before which the prefix ends and that before which the middle ends begin (code points), for
        the numbers one and two modulo units + 1; words that begin in the middle; whether the text holds a sentinel."""
        at, marked = self.events(text)
        n = len(text)
        opens = at[np.diff(at, prepend=-2) != 1]
        closes = at[np.diff(at, append=n + 2) != 1] + 1
        edges = np.concatenate([[0], np.stack([opens, closes], 1).ravel(), [n]])  # gaps of one class; the first or last may be empty
        gaps = np.diff(edges)
        units = (gaps > 0).astype(np.int64) if self.units.width is None else -(-gaps // self.units.width)
        upto = np.concatenate([[0], np.cumsum(units)])
        total = int(upto[-1])
        low, high = sorted((one % (total + 1), two % (total + 1)))

        def place(unit: int) -> int:
            if unit == total:
                return n
            k = int(np.searchsorted(upto, unit, "right")) - 1
            return int(edges[k]) + (unit - int(upto[k])) * (self.units.width or 0)

        a, b = place(low), place(high)
        words = edges[:-1:2][gaps[::2] > 0]  # every second gap is of other characters
        return total, a, b, int(np.searchsorted(words, b) - np.searchsorted(words, a)), marked


def cuts_of(units: Units):
    @F.pandas_udf(CUTS)
    def cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        scan = Scan.of(units)
        return pd.DataFrame([scan.cuts(*x) for x in zip(text, one.tolist(), two.tolist())], columns=["units", "first", "second", "middle_words", "marked"])

    return cuts


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that the seed and the id (null: the word null) decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of. Each sentinel is in it once: a text that holds one stays plain."""
    between = lambda left, right: F.split_part(F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, units: Units | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), middle_words, output: one row for each input row.

    A null text counts as empty. A text stays plain (form plain, output the text) if it is empty, holds a sentinel, or by lot
    (plain_percent); else it becomes spm by lot (spm_percent) or psm. The lot and the places are those of seed and id, so repeated rows
    come out alike; a null id draws as the word null. Texts are read whole, however long; an empty table gives an empty result; other
    columns are ignored. Rows stay where they lie: nothing is shuffled.
    """
    t = worker_texts(docs, id_col, text_col)
    one, two, plain, spm = draws(F.col("doc_id"), seed)
    cut = t.withColumn("cut", cuts_of(units or Units())(F.col("text"), one, two))
    form = F.when((F.col("text") == "") | F.col("cut.marked") | (plain % 100 >= 100 - plain_percent), "plain").when(spm % 100 < spm_percent, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", F.col("cut.units").alias("n"), form.alias("form"), F.col("cut.first").alias("a"), F.col("cut.second").alias("b"), "cut.middle_words")
    part = lambda start, length: F.substring("text", start, length)
    prefix = part(F.lit(1), F.col("a").cast("int"))
    middle = part((F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    suffix = part((F.col("b") + 1).cast("int"), F.length("text"))
    mark = {s: F.lit(s) for s in SENTINELS}
    output = F.when(F.col("form") == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)).when(F.col("form") == "spm", F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)).otherwise(F.col("text"))
    moved = lambda c: F.when(F.col("form") != "plain", c)
    return placed.select("doc_id", "n", "form", moved(F.col("a")).alias("prefix_chars"), moved(F.col("b") - F.col("a")).alias("middle_chars"), moved(F.col("middle_words")).alias("middle_words"), output.alias("output"))


def digests(examples: DataFrame) -> DataFrame:
    """The examples with digests of their output and of the text rebuilt from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"), "middle_words")
