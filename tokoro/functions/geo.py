"""Check digits, distances, quantiles, token estimates and perturbed inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokoro.functions.text import NARROW, WIDE

EARTH_M = 6_371_000.0


def check_digit(code5: Column) -> Column:
    """Sixth digit of a five-digit municipality code."""
    digits = [F.substring(code5, i, 1).cast("int") for i in range(1, 6)]
    total = sum((d * w for d, w in zip(digits[1:], (5, 4, 3, 2), strict=True)), digits[0] * 6)
    return (F.lit(11) - total % 11) % 10


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def token_estimate(options: Column, request: int = 0) -> Column:
    """Tokens a question's options take: two a character, six an option."""
    chars = F.aggregate(F.transform(options, F.length), F.lit(0), lambda a, n: a + n)
    return (chars * 2.0).cast("int") + F.size(options) * 6 + request


#: Characters that are written for one another, and that are taken for one another.
VARIANTS = ("ケヶ沢澤辺邉斎斉浜濱", "ヶケ澤沢邉辺斉斎濱浜")
CONFUSED = ("大犬木本田由日目石右土士", "犬大本木由田目日右石士土")


def _kanji_chome_digits(chome: Column) -> Column:
    """The digits of a kanji chome read one by one; empty if it isn't one."""
    body = F.regexp_replace(chome, "[^〇一二三四五六七八九]", "")
    return F.when(chome.endswith("丁目"), F.translate(body, "〇一二三四五六七八九", "0123456789")).otherwise("")


def perturb(text: Column, pref: Column, kind: str, start: Column | int = 0, end: Column | None = None, chome: Column | None = None, seed: int = 0, pick: Column | None = None) -> Column:
    """One of the input perturbations, or null where it can't be made.

    One-character changes fall into the town's name, the characters from ``start`` up to
    ``end`` (0-based; the whole text by default), on one of the characters that they can be
    made at: the ``pick``-th of these, counted round (a hash of text and seed by default).
    """
    if kind == "as_is":
        return text
    if kind == "full_width":
        wide = F.translate(text, NARROW, WIDE)
        return F.when(wide != text, wide)
    if kind == "arabic_chome":
        own = F.coalesce(chome, F.lit(""))
        digits = _kanji_chome_digits(own)
        return F.when(digits != "", F.replace(text, own, F.concat(digits, F.lit("丁目"))))
    if kind == "drop_pref":
        return F.when((pref != "") & text.startswith(pref), F.substring(text, F.length(pref) + 1, F.length(text)))
    table = {"variant": VARIANTS, "typo": CONFUSED, "drop_char": None}[kind]
    least = 2 if table is None else 1
    first, last = (F.lit(start) if isinstance(start, int) else start) + 1, F.length(text) if end is None else end
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.substring(text, i, F.lit(1))
    spots = F.filter(places, lambda i: ~one(i).rlike("[0-9]") if table is None else F.instr(F.lit(table[0]), one(i)) > 0)
    number = F.xxhash64(text, F.lit(seed)) if pick is None else pick
    at = F.try_element_at(spots, (F.pmod(number, F.greatest(F.size(spots), F.lit(1))) + 1).cast("int"))
    new = F.lit("") if table is None else F.translate(one(at), *table)
    return F.when(F.size(spots) >= least, F.overlay(text, new, at, F.lit(1)))


PERTURBATIONS = ("as_is", "full_width", "arabic_chome", "drop_pref", "variant", "typo", "drop_char")
