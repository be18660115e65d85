"""The registry's CSV files as typed DataFrames.

Files come zipped. Members are unzipped on the executors from ``binaryFile`` rows (any
store that Spark reads), a member a time. Every column is text until it is cast here.
"""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokoro.schema import KIND_BLOCK, KIND_PARCEL, KIND_RSDT

#: The columns read of each kind of file.
COLUMNS = {
    "mt_pref": ["lg_code", "pref"],
    "mt_city": ["lg_code", "pref", "county", "city", "ward", "status_flg"],
    "mt_town": ["lg_code", "machiaza_id", "rsdt_addr_flg", "pref", "county", "city", "ward", "oaza_cho", "chome", "chome_number", "koaza", "status_flg"],
    "mt_rsdtdsp_blk": ["lg_code", "machiaza_id", "blk_id", "blk_num", "status_flg"],
    "mt_rsdtdsp_rsdt": ["lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "blk_num", "rsdt_num", "rsdt_num2", "status_flg"],
    "mt_parcel": ["lg_code", "machiaza_id", "prc_id", "status_flg"],
    "mt_pref_pos": ["lg_code", "rep_lat", "rep_lon"],
    "mt_city_pos": ["lg_code", "rep_lat", "rep_lon"],
    "mt_town_pos": ["lg_code", "machiaza_id", "rsdt_addr_flg", "rep_lat", "rep_lon"],
    "mt_rsdtdsp_blk_pos": ["lg_code", "machiaza_id", "blk_id", "rep_lat", "rep_lon"],
    "mt_rsdtdsp_rsdt_pos": ["lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "rep_lat", "rep_lon"],
    "mt_parcel_pos": ["lg_code", "machiaza_id", "prc_id", "rep_lat", "rep_lon"],
}
KIND_OF = {"mt_rsdtdsp_blk": KIND_BLOCK, "mt_rsdtdsp_rsdt": KIND_RSDT, "mt_parcel": KIND_PARCEL}
FIELD_LIMIT, BATCH = 10_000_000, 10_000


def read_zips(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """Rows of all CSV members of zip files, in order: ``ord`` counts file by file (files
    by path), columns a file lacks are null; ``path`` is the file as given. A file without
    a CSV member is an error. Many files are read by many tasks, each row of a file by the
    task that has the file."""

    def unzip(batches):
        import pyarrow as pa

        csv.field_size_limit(FIELD_LIMIT)
        names = ["path", "line", *columns]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, line = [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise ValueError(f"no CSV file in {path}")
                    for member in members:
                        with archive.open(member) as raw:
                            for r in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline="")):
                                rows.append((path, line, *(r.get(c) for c in columns)))
                                line += 1
                                if len(rows) == BATCH:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(columns)]
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(unzip, "path string, line long, " + ", ".join(f"{c} string" for c in columns))
    order = files.select("path").distinct().withColumn("_f", F.row_number().over(Window.orderBy("path")) - 1)  # one row a file
    return rows.join(F.broadcast(order), "path").withColumn("ord", F.shiftleft(F.col("_f").cast("long"), 40) + F.col("line")).drop("line", "_f")


def _int(c: str) -> Column:
    """A cell as an integer; blank is 0."""
    return F.coalesce(F.col(c).try_cast("int"), F.lit(0))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def in_force(rows: DataFrame) -> DataFrame:
    """Without abolished rows (status 3); a missing status stays."""
    return rows.where(~F.col("status_flg").eqNullSafe("3"))


def positions(rows: DataFrame, key: dict[str, Column]) -> DataFrame:
    """(key, lat, lon): rows with both coordinates, the last of a key."""
    usable = rows.where("coalesce(rep_lat, '') <> '' and coalesce(rep_lon, '') <> ''")
    keyed = usable.select(*(c.alias(k) for k, c in key.items()), "ord", F.col("rep_lat").try_cast("double").alias("lat"), F.col("rep_lon").try_cast("double").alias("lon"))
    last = keyed.groupBy(*key).agg(F.max_by(F.struct("lat", "lon"), F.col("ord")).alias("p"))
    return last.select(*key, "p.lat", "p.lon")


def prefs(body: DataFrame, pos: DataFrame) -> DataFrame:
    return body.select(_int("lg_code").alias("lg_code"), _text("pref")).join(positions(pos, {"lg_code": _int("lg_code")}), "lg_code", "left")


def cities(body: DataFrame, pos: DataFrame) -> DataFrame:
    own = in_force(body).select(_int("lg_code").alias("lg_code"), *map(_text, ("pref", "county", "city", "ward")))
    return own.join(positions(pos, {"lg_code": _int("lg_code")}), "lg_code", "left")


def with_town_points(towns: DataFrame, pos: DataFrame) -> DataFrame:
    """Towns with the point of their own flag, else of flag 0, else of flag 1.
    pos: lg_code, machiaza_id, flag, ord, lat, lon; a later row replaces an earlier."""
    last = pos.groupBy("lg_code", "machiaza_id").agg(*(F.max_by(F.struct("lat", "lon"), F.when(F.col("flag") == k, F.col("ord"))).alias(f"_p{k}") for k in (0, 1)))
    own = F.when(F.col("rsdt_addr_flg") == 1, F.coalesce("_p1", "_p0")).otherwise(F.coalesce("_p0", "_p1"))
    return towns.join(last, ["lg_code", "machiaza_id"], "left").withColumn("_p", own).select(*towns.columns, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


def towns(body: DataFrame, pos: DataFrame) -> DataFrame:
    """Town rows in file order with their points, as folding takes them."""
    own = in_force(body).select("ord", _int("lg_code").alias("lg_code"), _int("machiaza_id").alias("machiaza_id"), _int("rsdt_addr_flg").alias("rsdt_addr_flg"), *map(_text, ("pref", "county", "city", "ward", "oaza_cho", "chome", "chome_number", "koaza")))
    usable = pos.where("coalesce(rep_lat, '') <> '' and coalesce(rep_lon, '') <> ''")
    points = usable.select(_int("lg_code").alias("lg_code"), _int("machiaza_id").alias("machiaza_id"), _int("rsdt_addr_flg").alias("flag"), "ord", F.col("rep_lat").try_cast("double").alias("lat"), F.col("rep_lon").try_cast("double").alias("lon"))
    return with_town_points(own, points)


def _numbers(kind: int) -> list[Column]:
    if kind == KIND_BLOCK:
        return [_int("blk_num"), F.lit(0), F.lit(0)]
    if kind == KIND_RSDT:
        return [_int("blk_num"), _int("rsdt_num"), _int("rsdt_num2")]
    return [F.coalesce(F.substring("prc_id", at, 5).try_cast("int"), F.lit(0)) for at in (1, 6, 11)]


def _record_key(kind: int) -> dict[str, Column]:
    """Ids as separate integers: packed into one they would collide."""
    ids = {KIND_BLOCK: ("blk_id",), KIND_RSDT: ("blk_id", "rsdt_id", "rsdt2_id"), KIND_PARCEL: ()}[kind]
    own = {c: _int(c) for c in ("lg_code", "machiaza_id", *ids)}
    if kind == KIND_PARCEL:
        own |= {f"prc{i}": F.coalesce(F.substring("prc_id", at, 5).try_cast("int"), F.lit(0)) for i, at in enumerate((1, 6, 11))}
    return own


def number_rows(kind: int, body: DataFrame, pos: DataFrame | None) -> DataFrame:
    """(lg_code, machiaza_id, kind, num1, num2, num3, lat, lon) of any number of files of
    one kind; points meet their records by id, whichever files they are in."""
    key = _record_key(kind)
    shown = [c.alias(f"num{i}") for i, c in enumerate(_numbers(kind), 1)]
    own = in_force(body).select(*(c.alias(k) for k, c in key.items()), *shown)
    points = positions(pos, key) if pos is not None else None
    out = own.join(points, list(key), "left") if points is not None else own.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double"))
    return out.select("lg_code", "machiaza_id", F.lit(kind).alias("kind"), "num1", "num2", "num3", "lat", "lon")
