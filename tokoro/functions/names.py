"""Variants of place names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def pref_variants(pref) -> Column:
    """The empty text, the name, and the name without its one-character suffix."""
    p = _text(pref)
    short = F.when(p.rlike("^.+[都道府県]$"), F.regexp_replace(p, "[都道府県]$", ""))
    return F.array_distinct(F.array_compact(F.array(F.lit(""), F.when(p != "", p), short)))


def without(value, prefixes: str) -> Column:
    """Without the first of some prefixes (a regular expression), if something remains."""
    v = _text(value)
    return F.when(v.rlike(f"^(?>{prefixes})."), F.regexp_replace(v, f"^(?>{prefixes})", "")).otherwise(v)


def strip_variants(value, prefixes: str) -> Column:
    return F.array_distinct(F.array(_text(value), without(value, prefixes)))


def prefix_styles(oaza, koaza) -> Column:
    """(oaza, koaza) as written, and with both their prefixes dropped if that differs."""
    pair = lambda a, b: F.struct(a.alias("oaza"), b.alias("koaza"))
    return F.array_distinct(F.array(pair(_text(oaza), _text(koaza)), pair(without(oaza, "大字|字"), without(koaza, "字"))))


def kanji_number(n) -> Column:
    """1 to 999 in kanji without a leading one; else empty."""
    v = _c(n)
    digit = lambda d: F.substring(F.lit("一二三四五六七八九"), d, F.lit(1))

    def place(d: Column, unit: str) -> Column:
        return F.when(d == 0, "").when(d == 1, unit).otherwise(F.concat(digit(d), F.lit(unit)))

    hundreds, tens, ones = (v / 100).cast("int"), (v / 10).cast("int") % 10, (v % 10).cast("int")
    text = F.concat(place(hundreds, "百"), place(tens, "十"), F.when(ones == 0, "").otherwise(digit(ones)))
    return F.when((v > 0) & (v < 1000), text).otherwise("")


def chome_variants(chome, number) -> Column:
    """The chome as written and by its number: with 丁目, bare, and in kanji."""
    c, n = _text(chome), _text(number)
    kanji = kanji_number(F.when(n.rlike(r"^\d{1,9}$"), n).otherwise("0").cast("int"))
    forms = F.array(c, F.concat(n, F.lit("丁目")), n, F.when(kanji != "", F.concat(kanji, F.lit("丁目"))).otherwise(c))
    return F.when(c == "", F.array(F.lit(""))).when(n == "", F.array(c)).otherwise(F.array_distinct(forms))


def city_cores(county, city, ward) -> Column:
    """County, city and ward, and without the county if there is one."""
    short = F.concat(_text(city), _text(ward))
    return F.array_distinct(F.array(F.concat(_text(county), short), short))


def display(*names) -> Column:
    """Names put together."""
    return F.concat(*(_text(n) for n in names))
