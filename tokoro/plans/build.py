"""Build the tables from registry files: names and keys always, numbers where they changed."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokoro.operators.fold import build_towns
from tokoro.sources import registry
from tokoro.sources.catalog import kinds_for_level, pair_files, parse_feed, select_files, stale
from tokoro.sources.fetch import _open, download, download_all, fetch_feed
from tokoro.sources.store import VERSION, Store
from tokoro.sources.supplement import SUPPLEMENT_ATTRIBUTION, SUPPLEMENT_URL, read_supplement
from tokoro.storage import stored

ATTRIBUTION = "Contains data of the address base registry (Digital Agency, Japan)."
Progress = Callable[[str, int, int, str], None]


def silent(phase: str, done: int, total: int, detail: str) -> None:
    pass


def _plain(path):
    """A local path without its scheme, as Spark reports and as it is given."""
    return F.regexp_replace(path, "^file:/+", "/")


def build(
    spark: SparkSession, root: str, files: dict[str, list[str]], level: str = "machiaza", supplement: str | None = None, modified: dict[str, str] | None = None,
    positions: dict[str, str | None] | None = None, force: bool = False, progress: Progress = silent,
) -> dict:
    """files: zip paths by kind, position files under ``<kind>_pos``. Returns counts.

    Numbers: files whose Last-Modified (``modified``, by path) the ledger holds are skipped
    unless forced; all others of a kind are read in one job, with the position files that
    ``positions`` names for them, or all of the kind's. Points meet records by id, so a
    missing position file leaves its records without a point and shifts no others. Each kind
    is recorded when its numbers are written, so a stopped build goes on where it was. A
    missing or unreadable supplement is noted, not fatal.
    """
    store, modified, report = Store(spark, root), modified or {}, {"notes": []}

    def read(kind: str, paths: list[str]) -> DataFrame:
        columns = registry.COLUMNS[kind]
        if not paths:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", path string, ord bigint")
        return registry.read_zips(spark, paths, columns)

    all_of = lambda kind: read(kind, files.get(kind, []))
    progress("names", 0, 3, "")
    store.replace("pref", registry.prefs(all_of("mt_pref"), all_of("mt_pref_pos")))
    store.replace("city", registry.cities(all_of("mt_city"), all_of("mt_city_pos")))
    extra = None
    if supplement:
        try:
            extra = stored(read_supplement(spark, supplement))
        except Exception as error:  # noqa: BLE001
            report["notes"].append(f"supplement left out: {error}")
    progress("names", 1, 3, "towns")
    towns, heads, keys, stats = build_towns(registry.towns(all_of("mt_town"), all_of("mt_town_pos")), extra)
    for k, (table, rows) in enumerate((("machiaza", towns), ("machiaza_head", heads), ("machiaza_key", keys))):
        store.replace(table, rows)
        progress("names", 1 + k, 3, table)
    report |= stats
    now = datetime.now(timezone.utc).isoformat()
    wanted = [k for k in registry.KIND_OF if k in kinds_for_level(level)]
    for done, kind in enumerate(wanted):
        progress("numbers", done, len(wanted), kind)
        if not files.get(kind):
            continue
        given = spark.createDataFrame([(p, kind, modified.get(p)) for p in files[kind]], "url string, kind string, last_modified string")
        changed = stale(given, store.sources(), force)
        paths = sorted(r["url"] for r in changed.collect())  # a row a file
        if not paths:
            continue
        own = files.get(f"{kind}_pos", []) if positions is None else sorted({p for b in paths if (p := positions.get(b))})
        body = read(kind, paths)
        store.put_numbers(registry.number_rows(registry.KIND_OF[kind], body, read(f"{kind}_pos", own) if own else None))
        counts = registry.in_force(body).groupBy(_plain(F.col("path")).alias("path")).agg(F.count("*").alias("rows"))
        ledger = changed.join(counts, _plain(F.col("url")) == F.col("path"), "left")
        store.mark_source(ledger.select("url", "kind", "last_modified", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(now).alias("ingested_at")))
    store.set_meta(version=VERSION, level=level, built_at=now, attribution=ATTRIBUTION + (f" {SUPPLEMENT_ATTRIBUTION}" if extra is not None else ""))
    return report | {"numbers": store.read("banchi").count()}


def build_from_catalog(
    spark: SparkSession, root: str, level: str = "machiaza", prefs: list[str] | None = None, cities: list[str] | None = None, cache: str | None = None,
    concurrency: int = 4, force: bool = False, with_supplement: bool = True, opener=_open, progress: Progress = silent,
) -> dict:
    """Feed, selection, downloads, pairing, build. ``cache``: the folder for downloads (on a
    cluster one that executors see), ``<root>/cache`` by default. Files that didn't change
    since the last time aren't fetched again. Nothing selected: a note, and no build."""
    began, cache = time.monotonic(), cache or f"{root}/cache"
    progress("catalog", 0, 1, "")
    refs = stored(parse_feed(spark.createDataFrame([(fetch_feed(opener),)], "json string")))
    chosen = stored(select_files(refs, kinds_for_level(level), prefs, cities))
    rows = chosen.orderBy("ord").collect()  # a row a file: a few thousand at most
    progress("catalog", 1, 1, f"{len(rows)} files")
    if not rows:
        return {"files": 0, "notes": ["no file covers this area"]}
    got = {d.url: d for d in download_all([r["url"] for r in rows], cache, concurrency, opener, lambda *x: progress("download", *x))}
    files: dict[str, list[str]] = {}
    for r in rows:
        files.setdefault(r["kind"], []).append(got[r["url"]].path)
    path = lambda url: got[url].path if url in got else None
    pairs = {path(r["url"]): path(r["pos_url"]) for r in pair_files(chosen).collect()}
    notes, supplement = [], None
    if with_supplement and "mt_town" in files:
        try:
            supplement = download(SUPPLEMENT_URL, cache, 300.0, opener).path
        except Exception as error:  # noqa: BLE001  it completes the towns, no more
            notes.append(f"supplement left out: {error}")
    report = build(spark, root, files, level, supplement, {d.path: d.last_modified for d in got.values()}, pairs, force, progress)
    report["notes"] = notes + report["notes"]
    fresh = sum(not d.cached for d in got.values())
    return {"files": len(rows), "downloaded": fresh, "unchanged": len(rows) - fresh} | report | {"seconds": round(time.monotonic() - began, 1)}
