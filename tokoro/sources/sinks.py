"""Results as JSON lines or as a report for people, and a summary of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokoro.sources.store import Store

FIELDS = [
    "query", "address", "granularity", "granularity_label", "resolved", "pref", "county", "city", "ward", "machiaza", "banchi",
    "remainder", "lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "prc_id", "lat", "lon", "point_granularity", "confidence", "probability", "note",
]
NULLABLE = {"pref", "county", "city", "ward", "machiaza", "banchi", "remainder", "lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "prc_id", "note"}


def json_lines(results: DataFrame) -> DataFrame:
    """(qid, value): one JSON object a result; empty texts become null."""

    def field(name: str) -> Column:
        if name in NULLABLE:
            return F.nullif(F.col(name), F.lit("")).alias(name)
        return F.round(name, 4).alias(name) if name in ("confidence", "probability") else F.col(name)

    return results.select("qid", F.to_json(F.struct(*map(field, FIELDS)), {"ignoreNullFields": "false"}).alias("value"))


def human(results: DataFrame) -> DataFrame:
    """(qid, value): a few lines for each result; parts that are missing are left out."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name}: "), c))
    point = F.when(F.col("lat").isNotNull(), F.concat(F.format_string("%.6f, %.6f", "lat", "lon"), F.when(F.col("point_is_coarser"), F.concat(F.lit(" (of the "), "point_granularity", F.lit(")"))).otherwise("")))
    sure = F.when(F.col("confidence") > 0, F.format_string("%.2f", "confidence"))
    parts = [F.col("query"), line("address", F.col("address")), line("level", F.concat_ws(" / ", "granularity", "granularity_label")), line("rest", F.col("remainder")), line("point", point), line("confidence", sure), line("note", F.col("note"))]
    return results.select("qid", F.concat_ws("\n", *parts).alias("value"))


def info(store: Store) -> str:
    meta, counts = store.meta(), store.counts()
    return "\n".join([f"version {meta.get('version', '?')}, level {meta.get('level', '?')}, built {meta.get('built_at', '?')}", *(f"{k}: {n:,}" for k, n in counts.items()), meta.get("attribution", "")])
