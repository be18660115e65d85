"""The numeric tail of an address, and what is shown of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokoro.schema import BLOCK, CITY, KIND_BLOCK, KIND_PARCEL, KIND_RSDT, UNKNOWN

#: Separators between numbers, and units that carry a number on.
SEPARATORS = r"[\-ー−–—―‐‑‒〜~/・.,、 　]"
UNITS = "丁目|丁|番地|番|号|地割|の|ノ"
AFTER_UNITS = "丁目|番地|番|号室|号|地割|の|ノ"
TRIM = r"[\-ー−–—―‐ 　,、]"


#: What a number of more than 18 digits counts as: the registry has none so large.
TOO_LARGE = 10**18 - 1


def whole_number(digits: Column) -> Column:
    """Digits as a 64-bit integer, ``TOO_LARGE`` where they are more."""
    own = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(own) > 18, F.lit(TOO_LARGE)).otherwise(own.try_cast("bigint"))


def tail_parts(text: Column) -> tuple[Column, Column]:
    """(numbers, skipped) of a tail: at most three numbers parted by separators and units
    only (a unit is taken whole or not at all), and the text before the first."""
    body = F.regexp_replace(text, f"^{SEPARATORS}+", "")
    run = F.regexp_extract(body, rf"^\D*+(\d++(?:(?:{SEPARATORS}|(?>{UNITS}))*+\d++)*+)", 1)
    numbers = F.transform(F.slice(F.regexp_extract_all(run, F.lit(r"(\d+)")), 1, 3), whole_number)
    return numbers, F.regexp_extract(body, r"^(\D*+)\d", 1)


def tail(text: Column) -> Column:
    numbers, skipped = tail_parts(text)
    return F.struct(numbers.alias("numbers"), text.alias("raw"), skipped.alias("skipped"))


def entry_size(num2: Column, num3: Column) -> Column:
    """How many of an entry's numbers are shown: trailing zeros aren't, one always is."""
    return F.when(num3 != 0, 3).when(num2 != 0, 2).otherwise(1)


def numbers_array(num1: Column, num2: Column, num3: Column) -> Column:
    return F.slice(F.array(num1, num2, num3), F.lit(1), entry_size(num2, num3))


def number_at(numbers: Column, i: int) -> Column:
    """The i-th number; 0 where there are fewer."""
    return F.coalesce(F.try_element_at(numbers, F.lit(i)), F.lit(0))


def format_banchi(kind: Column, numbers: Column) -> Column:
    a, b, c = (F.try_element_at(numbers, F.lit(i)).cast("string") for i in (1, 2, 3))
    n = F.size(numbers)
    house = F.concat(a, F.lit("番"), b, F.lit("号"), F.when((n > 2) & (c != "0"), F.concat(F.lit("の"), c)).otherwise(""))
    return (
        F.when(numbers.isNull() | (n <= 0), "")
        .when((kind == KIND_BLOCK) | ((kind == KIND_RSDT) & (n < 2)), F.concat(a, F.lit("番")))
        .when(kind == KIND_RSDT, house)
        .otherwise(F.concat(F.array_join(numbers, "-"), F.lit("番地")))
    )


def banchi_granularity(kind: Column, numbers: Column) -> Column:
    return F.when((kind == KIND_RSDT) & (F.size(numbers) < 2), BLOCK).otherwise(kind + 3)


def remainder_after(text: Column, size: Column) -> Column:
    """What follows the first ``size`` numbers of a tail and one unit after them."""
    out = F.lit("")
    for k in (1, 2, 3):
        numbers = rf"^(?:\D*+\d++){{{k}}}"
        rest = F.regexp_replace(text, rf"{numbers}(?>{AFTER_UNITS})?+", "")
        out = F.when((size == k) & text.rlike(numbers), F.regexp_replace(F.regexp_replace(rest, f"^{TRIM}+", ""), f"{TRIM}+$", "")).otherwise(out)
    return out


def point_source(lat: Column, own_lat: Column, granularity: int | Column, fallback: int = CITY) -> Column:
    """Of which granularity a point is."""
    level = granularity if isinstance(granularity, Column) else F.lit(granularity)
    return F.when(lat.isNull(), UNKNOWN).when(own_lat.isNotNull(), level).otherwise(fallback)


def code(n: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", n)


def block_id(num1: Column) -> Column:
    return code(num1, 3)


def second_id(num: Column) -> Column:
    return F.when(num == 0, "").otherwise(code(num, 3))


def parcel_id(num1: Column, num2: Column, num3: Column) -> Column:
    return F.concat(code(num1, 5), code(num2, 5), code(num3, 5))


def house_ids(kind: Column, num1: Column, num2: Column, num3: Column) -> tuple[Column, Column, Column, Column]:
    """(block, house, second house, parcel) ids; empty where they don't apply."""
    empty = F.lit("")
    parcel = kind == KIND_PARCEL
    house = kind == KIND_RSDT
    return (
        F.when(~parcel, block_id(num1)).otherwise(empty),
        F.when(house, code(num2, 3)).otherwise(empty),
        F.when(house, second_id(num3)).otherwise(empty),
        F.when(parcel, parcel_id(num1, num2, num3)).otherwise(empty),
    )
