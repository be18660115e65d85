"""The registry's file catalogue: a DCAT feed as a DataFrame, and which files to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The feed's address, the files' host and the kinds of files.
FEED_URL = "https://dataset.address-br.digital.go.jp/api/feed/dcat-us/1.1.json"
DATA_HOST = "data.address-br.digital.go.jp"
FEED = "dataset array<struct<title:string,modified:string,distribution:array<struct<accessURL:string,downloadURL:string>>>>"
#: Kinds of files by build level; each level has those of the ones before it.
LEVELS = {"machiaza": ("mt_pref", "mt_city", "mt_town"), "rsdt": ("mt_rsdtdsp_blk", "mt_rsdtdsp_rsdt"), "parcel": ("mt_parcel",)}


def kinds_for_level(level: str) -> list[str]:
    """All kinds up to a level, then their position files."""
    names = list(LEVELS)
    body = [k for name in names[: names.index(level) + 1] for k in LEVELS[name]]
    return body + [f"{k}_pos" for k in body]


def parse_feed(feeds: DataFrame, column: str = "json") -> DataFrame:
    """(ord, kind, scope, code, url, title, modified): one row for each data URL, the first
    of repeats; ``ord`` is its place in the feed."""
    sets = feeds.select(F.posexplode(F.from_json(column, FEED)["dataset"]).alias("i", "d"))
    links = sets.select("i", "d.title", "d.modified", F.posexplode("d.distribution").alias("j", "x"))
    url = F.coalesce(F.when(F.col("x.accessURL") != "", F.col("x.accessURL")), F.col("x.downloadURL"), F.lit(""))
    pattern = rf"^https://{DATA_HOST.replace('.', '[.]')}/([a-z0-9_]+)/(?:(pref|city)/)?([A-Za-z0-9_]+)[.]csv[.]zip$"
    part = lambda g: F.regexp_extract("url", pattern, g)
    rows = links.select("title", "modified", url.alias("url"), (F.shiftleft(F.col("i").cast("long"), 20) + F.col("j")).alias("ord")).where(F.col("url").rlike(pattern))
    first = rows.groupBy("url").agg(F.min_by(F.struct("ord", F.coalesce("title", F.lit("")).alias("title"), F.nullif("modified", F.lit("")).alias("modified")), F.col("ord")).alias("r"))
    out = first.select("url", "r.*").withColumn("kind", part(1)).withColumn("scope", F.coalesce(F.nullif(part(2), F.lit("")), F.lit("all")))
    return out.withColumn("code", F.regexp_extract(part(3), r"(?:pref|city)(\d+)$", 1)).select("ord", "kind", "scope", "code", "url", "title", "modified")


def select_files(refs: DataFrame, kinds: list[str], prefs: list[str] | None = None, cities: list[str] | None = None) -> DataFrame:
    """For each kind the fewest files that cover the wanted area: without a filter the
    national one, else all prefectures', else all cities'; with one the wanted cities', the
    wanted prefectures', those prefectures' cities', or the national one."""
    cities, prefs = list(cities or ()), list(prefs or ())
    implied = sorted({*prefs, *(c[:2] for c in cities)})
    scope, code = F.col("scope"), F.col("code")
    if not implied:
        priority = F.when(scope == "all", 0).when(scope == "pref", 1).otherwise(2)
    else:
        priority = (
            F.when((scope == "city") & code.isin(cities) if cities else F.lit(False), 0)
            .when((scope == "pref") & code.isin(implied), 1)
            .when((scope == "city") & F.substring(code, 1, 2).isin(implied), 2)
            .when(scope == "all", 3)
        )
    own = refs.where(F.col("kind").isin(kinds)).withColumn("_p", priority).where("_p is not null")
    best = own.groupBy("kind").agg(F.min("_p").alias("_p"))
    own = own.join(best, ["kind", "_p"])
    rank = F.row_number().over(Window.partitionBy("kind", "scope").orderBy("ord"))
    return own.withColumn("_r", rank).where("scope <> 'all' or _r = 1").drop("_p", "_r")


def pair_files(refs: DataFrame) -> DataFrame:
    """Body files with their position file: of the same kind, scope and code, else of the
    same kind and code in any scope, the first in the feed; else null."""
    body = refs.where("not endswith(kind, '_pos')")
    pos = refs.where("endswith(kind, '_pos')").select(F.regexp_replace("kind", "_pos$", "").alias("kind"), F.col("scope").alias("pos_scope"), "code", F.col("url").alias("pos_url"), F.col("ord").alias("pos_ord"))
    order = F.struct((F.col("scope") != F.col("pos_scope")).alias("x"), F.when(F.col("scope") == F.col("pos_scope"), -F.col("pos_ord")).otherwise(F.col("pos_ord")).alias("y"))
    best = body.join(pos, ["kind", "code"]).groupBy("url").agg(F.min_by("pos_url", order).alias("pos_url"))
    return body.join(best, "url", "left")


def stale(selected: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files to ingest: without those whose last change the ledger already holds."""
    if force:
        return selected
    known = ledger.where("last_modified is not null").select("url", "last_modified")
    return selected.join(known, ["url", "last_modified"], "left_anti")
