"""Normalisation and comparison keys.

Spark has no Unicode normalisation. Texts of characters that NFKC leaves alone (after
full-width ASCII, which ``translate`` maps) never leave the JVM: ``normalized`` filters the
others out, sends them alone to an Arrow function and puts both together again.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Full-width ASCII and the ideographic space, with what NFKC makes of them.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Characters that stay as they are: ASCII, kana, common ideographs, dashes and marks.
STABLE = r"^[\x00-\x7Fぁ-ゖァ-ヾ一-鿿、。々-〇〜‐‒-―−]*$"
SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
_SPACE = re.compile(SPACE)


def nfkc(text: str) -> str:
    return _SPACE.sub("", unicodedata.normalize("NFKC", text))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else nfkc(t))


def is_stable(text: Column) -> Column:
    """Whether a text can be normalised in the JVM; true for null."""
    return F.coalesce(F.translate(text, WIDE, NARROW).rlike(STABLE), F.lit(True))


def normalize_stable(text: Column) -> Column:
    """Normalises texts known to hold stable characters only."""
    return F.regexp_replace(F.translate(text, WIDE, NARROW), SPACE, "")


def normalize(text: Column) -> Column:
    """NFKC without any white space; null stays null. Every row passes an Arrow function
    (nulls for stable texts); for tables see ``normalized``."""
    return F.when(is_stable(text), normalize_stable(text)).otherwise(_nfkc(F.when(~is_stable(text), text)))


def by_stability(rows: DataFrame, text: Column, make: Callable[[DataFrame, Callable[[Column], Column]], DataFrame]) -> DataFrame:
    """``make(rows, normalise)`` of the rows whose ``text`` is stable, in the JVM, and of the
    others, through Arrow. Whether there are others is looked up first (a stream may always
    have some): where there are none, the plan has one branch and no Python."""
    others = rows.where(~is_stable(text))
    if not rows.isStreaming and others.isEmpty():
        return make(rows, normalize_stable)
    return make(rows.where(is_stable(text)), normalize_stable).unionByName(make(others, _nfkc))


def normalized(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Rows with the normalised ``source`` as ``target``."""
    return by_stability(rows, F.col(source), lambda df, norm: df.withColumn(target, norm(F.col(source))))


#: Numerals by value, and the units that they multiply; 零 counts for nothing.
DIGITS, UNITS, NOTHING = "〇一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}, "零"
NUMERALS = DIGITS + "".join(UNITS) + NOTHING


def kanji_value(run: Column) -> Column:
    """Value of a run of kanji numerals: a fold over its characters. Adjacent digits
    overwrite each other, as only numbers with units are meant."""

    def step(now: Column, c: Column) -> Column:
        unit = functools.reduce(lambda w, u: w.when(c == u[0], F.lit(u[1]).cast("long")), UNITS.items(), F)
        digit = F.instr(F.lit(DIGITS), c).cast("long") - 1
        value = F.when(unit.isNotNull(), 0).when(digit >= 0, digit).otherwise(now["digit"])
        total = now["total"] + F.coalesce(unit * F.greatest(now["digit"], F.lit(1)), F.lit(0))
        return F.struct(total.cast("long").alias("total"), value.cast("long").alias("digit"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"))
    return F.aggregate(F.split(run, ""), zero, step, lambda end: end["total"] + end["digit"])


def fold_runs(text: Column) -> Column:
    """Runs of kanji numerals as integers, the rest as it is."""
    parts = F.regexp_extract_all(text, F.lit(f"([{NUMERALS}]+|[^{NUMERALS}]+)"), F.lit(1))
    folded = F.transform(parts, lambda x: F.when(F.substring(x, 1, 1).rlike(f"[{NUMERALS}]"), kanji_value(x).cast("string")).otherwise(x))
    return F.when(text.rlike(f"[{NUMERALS}]"), F.array_join(folded, "")).otherwise(text)


def fold_numbers(text: Column, norm: Callable[[Column], Column] | None = None) -> Column:
    """Normalised, with runs of kanji numerals as integers. ``norm`` as ``by_stability``
    gives it, here and below; without it every row passes an Arrow function."""
    return fold_runs((norm or normalize)(text))


def without_prefix(value: Column) -> Column:
    """Without one leading 大字 or 字, even if nothing is left."""
    return F.regexp_replace(value, "^(?:大字|字)", "")


def match_key(city: Column, *parts: Column, norm: Callable[[Column], Column] | None = None) -> Column:
    """Key under which two data sets' names of one place meet."""
    folded = F.concat(city, *(without_prefix(fold_numbers(F.coalesce(p, F.lit("")), norm)) for p in parts)) if parts else city
    return F.translate((norm or normalize)(folded), "ヶガが", "ケケケ")


def comparable(name: Column, norm: Callable[[Column], Column] | None = None) -> Column:
    """Town names for evaluation: numbers before 丁目 or 丁 as digits, 大字 and 字 dropped."""
    text, run = (norm or normalize)(name), f"[{NUMERALS}]+(?=丁)"
    parts = F.regexp_extract_all(text, F.lit(f"({run}|(?:(?!{run}).)++)"), F.lit(1))
    folded = F.transform(parts, lambda x: F.when(x.rlike(f"^[{NUMERALS}]+$") & ~x.rlike(f"[^{NUMERALS}]"), kanji_value(x).cast("string")).otherwise(x))
    return F.regexp_replace(F.when(text.rlike(run), F.array_join(folded, "")).otherwise(text), "大字|字", "")


def compare_key(name: Column, norm: Callable[[Column], Column] | None = None) -> Column:
    """Town names for comparison with other registers: the matching key, 大字 and 字 dropped
    wherever they stand."""
    return F.regexp_replace(match_key(F.lit(""), name, norm=norm), "大字|字", "")
