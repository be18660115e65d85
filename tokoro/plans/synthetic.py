"""A gazetteer and queries made from the star-schema tables, for tests and benchmarks.

The statements below run unchanged in Spark and in DuckDB; with them both engines start
from the same prefectures, cities, towns, numbers and query texts. Names are characters
that NFKC leaves alone. City names end in digits, so that some are prefixes of others;
towns of one name lie in several cities, and some twice in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokoro.operators.aliases import split_keys
from tokoro.operators.index import Index
from tokoro.storage import stored

PREF = """
SELECT CAST((r_regionkey + 11) * 10000 AS INT) AS lg_code, replace(r_name, ' ', '') || '県' AS pref,
  CAST(30 + r_regionkey AS DOUBLE) AS lat, CAST(130 + r_regionkey AS DOUBLE) AS lon FROM {region}
"""
JIS = "(n_regionkey + 11) * 1000 + n_nationkey"
DIGIT = (
    f"(11 - (CAST(floor(({JIS}) / 10000) AS INT) % 10 * 6 + CAST(floor(({JIS}) / 1000) AS INT) % 10 * 5 + CAST(floor(({JIS}) / 100) AS INT) % 10 * 4"
    f" + CAST(floor(({JIS}) / 10) AS INT) % 10 * 3 + ({JIS}) % 10 * 2) % 11) % 10"
)
CITY = f"""
SELECT CAST(({JIS}) * 10 + {DIGIT} AS INT) AS lg_code, n_nationkey AS nation, replace(r_name, ' ', '') || '県' AS pref,
  CASE WHEN n_nationkey % 5 = 0 THEN '北郡' ELSE '' END AS county, n_name || '市' AS city,
  CASE WHEN n_nationkey % 6 = 1 THEN '中区' ELSE '' END AS ward,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(30 + n_nationkey AS DOUBLE) / 10 END AS lat,
  CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(130 + n_nationkey AS DOUBLE) / 10 END AS lon
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
"""
TOWN = """
SELECT CAST(p_partkey AS INT) AS row_id, lg_code, CAST(p_partkey AS INT) AS machiaza_id, pref, county, city, ward,
  CASE WHEN p_partkey % 4 = 0 THEN '大字' ELSE '' END || replace(p_name, ' ', '') AS oaza_cho,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 2 AND p_size < 10 THEN substring('一二三四五六七八九', p_size, 1) || '丁目'
    ELSE CAST(p_size AS STRING) || '丁目' END AS chome,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS chome_number,
  CASE WHEN p_partkey % 7 = 0 THEN '字' || replace(p_type, ' ', '') ELSE '' END AS koaza,
  CAST(p_partkey % 2 AS INT) AS rsdt_addr_flg,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) / 1000 END AS lat,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) / 500 END AS lon,
  CASE WHEN p_partkey % 11 = 10 THEN 'supplement' ELSE 'registry' END AS source
FROM {part} JOIN {g_city} ON nation = p_partkey % 25
"""
NUMBER = """
SELECT DISTINCT lg_code, machiaza_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS kind,
  CAST(l_orderkey % 12 + 1 AS INT) AS num1, CAST(l_linenumber AS INT) AS num2, CAST(l_quantity AS INT) % 3 AS num3,
  CASE WHEN l_orderkey % 12 % 4 = 0 THEN NULL ELSE CAST(l_partkey * 10 + l_orderkey % 12 AS DOUBLE) / 100 END AS lat,
  CASE WHEN l_orderkey % 12 % 4 = 0 THEN NULL ELSE CAST(l_partkey * 10 + l_linenumber AS DOUBLE) / 100 END AS lon
FROM {lineitem} JOIN {g_town} ON machiaza_id = l_partkey
"""
QUERY = """
SELECT o_orderkey AS qid, CASE o_orderkey % 11
  WHEN 0 THEN pref || county || city || ward || oaza_cho || chome || koaza || num || '番' || branch || '号'
  WHEN 1 THEN county || city || ward || oaza_cho || chome_number || '-' || num || '-' || branch || ' HOUSE 301'
  WHEN 2 THEN pref || city || ward || oaza_cho || chome || koaza || num || '番地' || branch
  WHEN 3 THEN pref || county || city || ward
  WHEN 4 THEN pref
  WHEN 5 THEN substring(pref || county || city || ward || oaza_cho, 1, length(pref || county || city || ward || oaza_cho) - 2) || num || '-' || branch
  WHEN 6 THEN '不明町' || num || '-' || branch
  WHEN 7 THEN pref || city || ward || ' ' || replace(oaza_cho, '大字', '') || chome || replace(koaza, '字', '') || num || '番地'
  WHEN 8 THEN pref || county || city || ward || '変' || oaza_cho || num || '番'
  WHEN 9 THEN pref || '見知らぬ市' || num
  ELSE city || ward || oaza_cho || chome || koaza || 'の先' || num || '-' || branch END AS query
FROM (SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS STRING) AS num, CAST(o_custkey % 7 + 1 AS STRING) AS branch,
    (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM {part}) AS pick FROM {orders}) o
  JOIN {g_town} ON row_id = pick
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """g_pref, g_city, g_town, g_number and g_query over the tables in a folder."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation, part = read("region"), read("nation"), read("part")
    city = spark.sql(CITY, nation=nation, region=region)
    town = spark.sql(TOWN, part=part, g_city=city)
    return {
        "g_pref": spark.sql(PREF, region=region),
        "g_city": city,
        "g_town": town,
        "g_number": spark.sql(NUMBER, lineitem=read("lineitem"), g_town=town),
        "g_query": spark.sql(QUERY, part=part, orders=read("orders"), g_town=town),
    }


_BUILT: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over the gazetteer of a folder. It is built and written once in a session,
    as a user's is, and every query reads it."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _BUILT:
        g = tables(spark, sf_dir)
        towns = stored(g["g_town"])
        heads, keys = split_keys(towns)
        towns = towns.withColumn("alt_machiaza", F.when(F.col("row_id") % 9 == 0, F.array(F.col("machiaza_id") + 25)))
        _BUILT[known] = Index(towns, stored(heads), stored(keys), stored(g["g_city"].drop("nation")), stored(g["g_pref"]), stored(g["g_number"]))
    return _BUILT[known]


#: The same tables for DuckDB, as common table expressions.
WITH = "WITH RECURSIVE g_pref AS ({}), g_city AS ({}), g_town AS ({}), g_number AS ({}), g_query AS ({})".format(
    *(s.format(**{t: t for t in ("region", "nation", "part", "lineitem", "orders", "g_city", "g_town")}) for s in (PREF, CITY, TOWN, NUMBER, QUERY))
)
