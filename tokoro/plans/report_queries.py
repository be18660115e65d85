"""Queries of evaluation, reports, the supplement and point look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.functions import geo
from tokoro.functions.text import NARROW, WIDE
from tokoro.plans import synthetic
from tokoro.plans.evaluate import accuracy, evaluate_perturbations
from tokoro.plans.geocode import geocode
from tokoro.plans.queries import _GEO, WITH, _g, query
from tokoro.plans.source_queries import _KEPT, _changed
from tokoro.sources import sinks
from tokoro.sources.store import Store
from tokoro.sources.supplement import HEADERS, read_supplement
from tokoro.storage import scratch

# ---- evaluation

_NARROW, _WIDE = ("'" + x.replace("'", "''") + "'" for x in (NARROW, WIDE))
_PERTURBED = {
    "as_is": "t",
    "full_width": f"translate(t, {_NARROW}, {_WIDE})",
    "arabic_chome": "CASE WHEN regexp_matches(chome, '^[一二三四五六七八九]+丁目$') THEN replace(t, chome, translate(chome, '一二三四五六七八九', '123456789')) END",
    "drop_pref": "substring(t, length(pref) + 1)",
    "variant": _changed(geo.VARIANTS),
    "typo": _changed(geo.CONFUSED),
    "drop_char": f"CASE WHEN len({_KEPT}) > 1 THEN left(t, {_KEPT}[row_id % len({_KEPT}) + 1] - 1) || substring(t, {_KEPT}[row_id % len({_KEPT}) + 1] + 1) END",
}
_INPUTS = " UNION ALL ".join(f"SELECT CAST(row_id AS BIGINT) * 7 + {k} AS qid, '{c}' AS condition, {sql} AS query, row_id FROM whole" for k, (c, sql) in enumerate(_PERTURBED.items()))
_G_QUERY = f"""g_input AS (WITH whole AS (SELECT *, pref || county || city || ward || oaza_cho || chome || koaza || '1-2' AS t, length(pref || county || city || ward) AS start,
  length(pref || county || city || ward || oaza_cho || chome || koaza) AS stop FROM g_town) {_INPUTS}), g_query AS (SELECT qid, query FROM g_input WHERE query IS NOT NULL)"""
_TOWNS_GEO = WITH.partition(", g_query AS (")[0] + ", " + _G_QUERY + _GEO[len(WITH) :].replace("regexp_replace(query, '\\s+', '', 'g') AS norm", f"translate(query, {_WIDE}, {_NARROW}) AS norm")


@query(f"""{_TOWNS_GEO}, found AS (SELECT DISTINCT qid, row_id FROM hit WHERE NOT splits),
own AS (SELECT i.condition, f.qid IS NOT NULL AS found, coalesce(r.resolved, FALSE) AS resolved, r.lg_code = printf('%06d', t.lg_code) AND r.machiaza_id <> '' AND r.machiaza_id = CASE WHEN t.source = 'registry' THEN printf('%07d', t.machiaza_id) ELSE '' END AS correct
  FROM g_input i JOIN result r ON r.qid = i.qid JOIN g_town t ON t.row_id = i.row_id LEFT JOIN found f ON f.qid = i.qid AND f.row_id = i.row_id)
SELECT condition, count(*) AS n, avg(CAST(found AS INT)) AS recall, avg(CAST(correct AS INT)) AS correct, avg(CAST(resolved AS INT)) AS resolved FROM own GROUP BY 1""")
def ag5_perturbations(spark, sf_dir):
    """Every town in seven inputs, geocoded once; recall and precision by perturbation."""
    return evaluate_perturbations(synthetic.index(spark, sf_dir), Config())


@query(f"""{_GEO} SELECT count(*) AS n, avg(CAST(r.lg_code = printf('%06d', t.lg_code) AS INT)) AS accuracy FROM result r JOIN g_town t ON t.row_id = r.qid * 7 % (SELECT count(*) FROM g_town)""")
def jn16_accuracy(spark, sf_dir):
    """Results met with labels by id."""
    g, index = _g(spark, sf_dir), synthetic.index(spark, sf_dir)
    towns = index.towns.select("row_id", F.format_string("%06d", "lg_code").alias("label"))
    labels = g["g_query"].select("qid", (F.col("qid") * 7 % index.towns.count()).cast("int").alias("row_id")).join(towns, "row_id").select("qid", "label")
    return accuracy(geocode(g["g_query"], index), labels, "lg_code", "label")


# ---- reports

_LEVEL = "list_position(['unknown', 'pref', 'city', 'machiaza', 'block', 'rsdt', 'parcel'], {})"


@query(f"{_GEO} SELECT qid, lat IS NOT NULL AND {_LEVEL.format('point_granularity')} < {_LEVEL.format('granularity')} AS coarser FROM result")
def fn20_coarser_points(spark, sf_dir):
    """Whether a result's point is of a coarser level than the result."""
    return geocode(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir)).select("qid", F.col("point_is_coarser").alias("coarser"))


@query(f"{_GEO} SELECT qid, CAST(24 AS INT) AS fields, query, address, nullif(machiaza, '') AS machiaza, nullif(prc_id, '') AS prc_id, CASE WHEN coalesce(resolved, FALSE) THEN 'true' ELSE 'false' END AS resolved FROM result")
def snk5_json_lines(spark, sf_dir):
    """One object a result, all fields in it, empty texts null."""
    lines = sinks.json_lines(geocode(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir)))
    get = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return lines.select("qid", F.size(F.json_object_keys("value")).alias("fields"), *map(get, ("query", "address", "machiaza", "prc_id", "resolved")))


@query(f"""{_GEO} SELECT qid, 'query' || chr(10) || query AS head, address = '' AS unknown FROM result""")
def snk6_reports(spark, sf_dir):
    """Reports begin with the query; parts that are missing are left out."""
    lines = sinks.human(geocode(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir)))
    parts = F.split("value", "\n")
    return lines.select("qid", F.concat(F.lit("query\n"), parts[0]).alias("head"), (~F.exists(parts, lambda x: x.startswith("  address: "))).alias("unknown"))


# ---- the supplement and look-ups

#: Rows of the list: some without a town, some with coordinates that aren't numbers.
LISTED = """SELECT pref, county || city || ward AS city, CASE WHEN row_id % 7 = 3 THEN '' WHEN row_id % 7 = 4 THEN ' ' || oaza_cho || ',"x" ' ELSE oaza_cho END AS town, koaza,
  CASE WHEN row_id % 5 = 1 THEN 'x' WHEN row_id % 5 = 2 THEN NULL ELSE CAST(row_id AS STRING) END AS lat, CAST(row_id + 1 AS STRING) AS lon FROM {g_town}"""


@query(f"""{WITH}, listed AS ({LISTED.format(g_town="g_town")}) SELECT pref, city, trim(town) AS town, koaza, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM listed WHERE trim(town) <> ''""")
def src7_supplement(spark, sf_dir):
    """The list of towns read from CSV with its own headers."""
    at, names = scratch(spark), {v: k for k, v in HEADERS.items()}
    listed = spark.sql(LISTED, g_town=_g(spark, sf_dir)["g_town"])
    listed.select(*(F.col(c).alias(names[c]) for c in listed.columns)).write.csv(at, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_supplement(spark, at).select("pref", "city", "town", "koaza", "lat", "lon")


@query(f"""{WITH}, k AS (SELECT lg_code, machiaza_id, kind, num1, count(*) AS n FROM g_number GROUP BY 1, 2, 3, 4 ORDER BY n DESC, lg_code, machiaza_id, kind, num1 LIMIT 1)
SELECT row_number() OVER (ORDER BY n.num1, n.num2, n.num3) - 1 AS place, n.num1, n.num2, n.num3, lat, lon FROM g_number n JOIN k USING (lg_code, machiaza_id, kind, num1)""")
def src11_by_number(spark, sf_dir):
    """The entries of one first number, in the order of their numbers."""
    store, own = Store(spark, scratch(spark)), _g(spark, sf_dir)["g_number"]
    store.put_numbers(own)
    most = own.groupBy("lg_code", "machiaza_id", "kind", "num1").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lg_code", "machiaza_id", "kind", "num1").first()
    found = store.lookup(*most[:4]).coalesce(1)  # a town's entries of one number
    return found.select(F.monotonically_increasing_id().alias("place"), "num1", "num2", "num3", "lat", "lon")
