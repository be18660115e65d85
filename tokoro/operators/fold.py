"""Folding of registry rows to towns, and the supplement.

The rules are told row by row in the order of the file (``ord``), but none needs a
sequential scan: the first row of an id fixes its place, the first id of a place is the
town, and whatever the rest adds is an aggregate over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.functions.text import by_stability, match_key, without_prefix
from tokoro.operators.aliases import split_keys
from tokoro.schema import REGISTRY, SUPPLEMENT
from tokoro.storage import stored

NAME_COLUMNS = ["pref", "county", "city", "ward", "oaza_cho", "chome", "chome_number", "koaza"]


def _first_point(order: str = "ord"):
    """Aggregate: the first point there is."""
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return F.min_by(F.when(has, F.struct("lat", "lon")), F.when(has, F.col(order)))


def _first_row(columns: list[str]):
    return F.min_by(F.struct(*columns), F.col("ord")).alias("first")


def fold_same_id(rows: DataFrame) -> DataFrame:
    """One row for each (lg_code, machiaza_id): the first, with the largest flag and the
    first point of all."""
    out = rows.groupBy("lg_code", "machiaza_id").agg(_first_row(["ord", *NAME_COLUMNS]), F.max("rsdt_addr_flg").alias("rsdt_addr_flg"), _first_point().alias("p"))
    return out.select("lg_code", "machiaza_id", "rsdt_addr_flg", "first.*", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def with_place(rows: DataFrame) -> DataFrame:
    """Rows and their group's place: that of the first row of the same id. ``head``: the
    row is that first row."""
    own = Window.partitionBy("lg_code", "machiaza_id").orderBy("ord")
    place = F.struct(without_prefix(F.coalesce("oaza_cho", F.lit(""))).alias("oaza"), F.coalesce("chome", F.lit("")).alias("chome"), without_prefix(F.coalesce("koaza", F.lit(""))).alias("koaza"))
    return rows.withColumn("place", F.first(place).over(own)).withColumn("head", F.row_number().over(own) == 1)


def fold_towns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold rows of one id, then ids of one place. Returns the towns (with the name columns
    and, in order, the folded ids) and the rows whose names give keys, each with the
    ``owner`` (ord of its town)."""
    placed = with_place(rows)
    head = F.col("head")
    towns = placed.groupBy("lg_code", "place").agg(
        F.min_by(F.struct("ord", "machiaza_id", *NAME_COLUMNS), F.when(head, F.col("ord"))).alias("first"),
        F.array_sort(F.collect_list(F.when(head, F.struct("ord", "machiaza_id")))).alias("ids"),
        F.max("rsdt_addr_flg").alias("rsdt_addr_flg"),
        _first_point().alias("p"),
    )
    towns = towns.select(
        "lg_code", "place", "first.*", "rsdt_addr_flg", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
        F.transform(F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0))), lambda x: x["machiaza_id"]).alias("alt_machiaza"),
    )
    owners = placed.where("head").select("ord", "lg_code", "place", *NAME_COLUMNS).join(towns.select("lg_code", "place", F.col("ord").alias("owner")), ["lg_code", "place"])
    return towns.drop("place"), owners.drop("place", "lg_code")


def numbered(towns: DataFrame) -> DataFrame:
    """Dense row ids in order of arrival.

    Ids follow ranges of ``ord``: a range's rows are numbered by a window of its own, and
    the ranges' counts, one row each, give the offsets.
    """
    ranges = F.floor(F.col("ord") / 65_536)
    own = towns.withColumn("_range", ranges)
    counts = own.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("ord")) - 1
    return own.withColumn("_place", place).join(counts, "_range").withColumn("row_id", (F.col("_base") + F.col("_place")).cast("int")).drop("_range", "_place", "_base")


def build_towns(rows: DataFrame, supplement: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(town table, heads, keys, counts) of registry rows and a supplement (ord, pref, city,
    town, koaza, lat, lon). A row without any key gives no town."""
    rows = rows.where(F.concat(*(F.coalesce(c, F.lit("")) for c in NAME_COLUMNS)) != "")
    towns, owners = fold_towns(rows)
    towns = numbered(towns).withColumn("source", F.lit(REGISTRY))
    named = owners.join(towns.select(F.col("ord").alias("owner"), "row_id"), "owner").select("row_id", *NAME_COLUMNS)
    stats = {"rows": rows.count(), "towns": towns.count()}
    stats["folded"] = owners.count() - stats["towns"]
    if supplement is None:
        return towns.drop("ord", "chome_number"), *split_keys(named), stats | {"added": 0, "merged": 0}

    text = lambda c: F.coalesce(c, F.lit(""))
    city = F.concat(*(text(c) for c in ("pref", "county", "city", "ward")))
    town = [F.col(c) for c in ("oaza_cho", "chome", "koaza")]
    both = lambda own, *rest: lambda df, norm: df.withColumn("city_at", match_key(own, norm=norm)).withColumn("at", match_key(own, *rest, norm=norm))
    keyed = stored(by_stability(towns.select("row_id", "lg_code", "pref", "county", "city", "ward", "oaza_cho", "chome", "koaza"), F.concat(city, *map(text, ("oaza_cho", "chome", "koaza"))), both(city, *town)))
    places = keyed.groupBy("at").agg(F.min("row_id").alias("owner_row"))
    cities = keyed.groupBy("city_at").agg(F.min(F.struct("row_id", "lg_code", "pref", "county", "city", "ward")).alias("c"))
    given = F.concat(text("pref"), text("city"))
    extra = by_stability(supplement, F.concat(given, text("town"), text("koaza")), both(given, F.col("town"), F.lit(""), F.col("koaza"))).drop("pref", "city")
    extra = extra.join(cities, "city_at").join(places, "at", "left").select(
        "ord", "at", "owner_row", "c.lg_code", "c.pref", "c.county", "c.city", "c.ward", F.col("town").alias("oaza_cho"), F.lit("").alias("chome"), F.lit("").alias("chome_number"), text("koaza").alias("koaza"), "lat", "lon"
    )
    known, fresh = extra.where("owner_row is not null"), extra.where("owner_row is null")
    firsts = fresh.groupBy("at").agg(F.min_by(F.struct("ord", "lg_code", *NAME_COLUMNS), F.col("ord")).alias("first"), _first_point().alias("p"))
    firsts = numbered(firsts.select("at", "first.*", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))).withColumnRenamed("row_id", "machiaza_id")
    added = firsts.withColumn("row_id", F.col("machiaza_id") + stats["towns"])
    points = known.groupBy(F.col("owner_row").alias("row_id")).agg(_first_point().alias("q"))
    filled = towns.drop("chome_number", "ord").join(points, "row_id", "left").withColumn("_fill", F.col("lat").isNull())
    filled = filled.withColumn("lat", F.when(F.col("_fill"), F.col("q.lat")).otherwise(F.col("lat"))).withColumn("lon", F.when(F.col("_fill"), F.col("q.lon")).otherwise(F.col("lon"))).drop("q", "_fill")
    new = added.select("row_id", "lg_code", "machiaza_id", *[c for c in NAME_COLUMNS if c != "chome_number"], F.lit(0).alias("rsdt_addr_flg"), "lat", "lon", F.array().cast("array<int>").alias("alt_machiaza"), F.lit(SUPPLEMENT).alias("source"))
    also = known.withColumnRenamed("owner_row", "row_id").unionByName(fresh.drop("owner_row").join(added.select("at", "row_id"), "at")).select("row_id", *NAME_COLUMNS)
    n_new = added.count()
    return filled.unionByName(new), *split_keys(named.unionByName(also.select("row_id", *NAME_COLUMNS))), stats | {"added": n_new, "merged": extra.count() - n_new}
