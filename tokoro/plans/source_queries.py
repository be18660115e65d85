"""Queries of sources, sinks and small rules, over files and rows made from the tables.

Statements named in capitals run unchanged in both engines and make the inputs; the SQL
then says the operator's rule in another way.
"""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from tokoro.functions import geo, numbers, text
from tokoro.functions.text import NARROW, WIDE
from tokoro.operators import banchi
from tokoro.plans.queries import WITH, _g, _read, query
from tokoro.schema import KIND_BLOCK, KIND_PARCEL, KIND_RSDT
from tokoro.sources import catalog, registry
from tokoro.sources.store import Store
from tokoro.storage import scratch

# ---- small rules

_UNIT = "CASE WHEN {d} = 0 THEN '' WHEN {d} = 1 THEN '{u}' ELSE substring('一二三四五六七八九', {d}, 1) || '{u}' END"
_D = [f"CAST(floor(n / {p}) AS INT) % 10" for p in (1000, 100, 10, 1)]
#: Digits in a row, and numbers with units up to thousands, with a zero between.
KANJI = f"""SELECT k, n, CASE WHEN k % 2 = 0 THEN translate(CAST(n AS STRING), '0123456789', '〇一二三四五六七八九')
  ELSE {' || '.join(_UNIT.format(d=d, u=u) for d, u in zip(_D, '千百十', strict=False))} || '零' || CASE WHEN {_D[3]} = 0 THEN '' ELSE substring('一二三四五六七八九', {_D[3]}, 1) END END || '番' AS t
FROM (SELECT p_partkey AS k, CAST(p_partkey * 37 % 10000 AS INT) AS n FROM {{part}}) x"""


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN n % 10 ELSE n END || '番' AS folded FROM ({KANJI.format(part='part')})")
def fn7_kanji_value(spark, sf_dir):
    """Adjacent digits overwrite each other; with units, a number is its value."""
    rows = spark.sql(KANJI, part=_read(spark, sf_dir, "part"))
    return text.by_stability(rows, F.col("t"), lambda df, norm: df.select("k", text.fold_numbers(F.col("t"), norm).alias("folded")))


@query(f"""{WITH} SELECT n.machiaza_id, kind, num1, num2, num3, CASE WHEN n.lat IS NOT NULL THEN kind + 3 WHEN t.lat IS NOT NULL THEN 3 ELSE 0 END AS source FROM g_number n JOIN g_town t USING (machiaza_id)""")
def fn18_point_source(spark, sf_dir):
    g = _g(spark, sf_dir)
    both = g["g_number"].withColumnRenamed("lat", "own").join(g["g_town"].select("machiaza_id", F.col("lat").alias("town_lat")), "machiaza_id")
    source = numbers.point_source(F.coalesce("own", "town_lat"), F.col("own"), F.col("kind") + 3, 3)
    return both.select("machiaza_id", "kind", "num1", "num2", "num3", source.alias("source"))


_DIGITS = "translate({}, '一二三四五六七八九', '123456789')"


@query(f"""{WITH} SELECT row_id, regexp_replace(oaza_cho || {_DIGITS.format('chome')} || koaza, '大字|字', '', 'g') AS comparable,
  regexp_replace(regexp_replace('大字' || {_DIGITS.format("chome || oaza_cho || 'ケヶガが' || koaza")}, '大字|字', '', 'g'), '[ヶガが]', 'ケ', 'g') AS compare_key FROM g_town""")
def fn24_comparison_keys(spark, sf_dir):
    one, two = F.concat("oaza_cho", "chome", "koaza"), F.concat(F.lit("大字"), "chome", "oaza_cho", F.lit("ケヶガが"), "koaza")
    keys = lambda df, norm: df.select("row_id", text.comparable(one, norm).alias("comparable"), text.compare_key(two, norm).alias("compare_key"))
    return text.by_stability(_g(spark, sf_dir)["g_town"], one, keys)


_QUOTED = lambda t: t.replace("'", "''")
_SPOTS = "list_filter(range(start + 1, stop + 1), lambda i: {})"


def _changed(table: tuple[str, str]) -> str:
    spots = _SPOTS.format(f"contains('{table[0]}', substring(t, i, 1))")
    at = f"{spots}[row_id % len({spots}) + 1]"
    return f"CASE WHEN len({spots}) > 0 THEN left(t, {at} - 1) || translate(substring(t, {at}, 1), '{table[0]}', '{table[1]}') || substring(t, {at} + 1) END"


_KEPT = _SPOTS.format("NOT regexp_matches(substring(t, i, 1), '[0-9]')")
#: Towns with some characters that can be mistaken.
MISTAKEN = "SELECT row_id, pref, pref || city AS head, translate(oaza_cho, 'aebt', '沢大ケ本') AS oaza, chome FROM {g_town}"


@query(f"""{WITH}, x AS ({MISTAKEN.format(g_town='g_town')}), y AS (SELECT *, head || oaza || chome || '1-2' AS t, length(head) AS start, length(head || oaza || chome) AS stop FROM x)
SELECT row_id, t AS as_is, translate(t, '{_QUOTED(NARROW)}', '{_QUOTED(WIDE)}') AS full_width,
  CASE WHEN regexp_matches(chome, '^[一二三四五六七八九]+丁目$') THEN replace(t, chome, {_DIGITS.format('chome')}) END AS arabic_chome, substring(t, length(pref) + 1) AS drop_pref,
  {_changed(geo.VARIANTS)} AS variant, {_changed(geo.CONFUSED)} AS typo,
  CASE WHEN len({_KEPT}) > 1 THEN left(t, {_KEPT}[row_id % len({_KEPT}) + 1] - 1) || substring(t, {_KEPT}[row_id % len({_KEPT}) + 1] + 1) END AS drop_char FROM y""")
def fn26_kinds(spark, sf_dir):
    x = spark.sql(MISTAKEN, g_town=_g(spark, sf_dir)["g_town"])
    whole, start, end = F.concat("head", "oaza", "chome", F.lit("1-2")), F.length("head"), F.length(F.concat("head", "oaza", "chome"))
    return x.select("row_id", *(geo.perturb(whole, F.col("pref"), kind, start, end, F.col("chome"), pick=F.col("row_id")).alias(kind) for kind in geo.PERTURBATIONS))


LONG = "SELECT o_orderkey AS qid, CAST(o_orderkey % 3 AS STRING) || repeat('9', CAST(o_custkey % 24 AS INT)) || '番地' || repeat('0', CAST(o_custkey % 5 AS INT)) || CAST(o_custkey AS STRING) AS t FROM {orders}"
FEW = "SELECT * FROM VALUES (1, 1, 3, 0, 0, 0), (1, 1, 3, 1, 0, 0), (1, 1, 3, 29, 4, 0), (1, 1, 3, 19, 5, 0) AS v(lg_code, machiaza_id, kind, num1, num2, num3)"
_INTEGER = "CASE WHEN length(ltrim(x, '0')) > 18 THEN '999999999999999999' WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END"


@query(f"""WITH q AS (SELECT qid, list_transform(regexp_extract_all(t, '\\d+'), lambda x: {_INTEGER}) AS nums FROM ({LONG.format(orders='orders')}))
SELECT qid, array_to_string(nums, '-') AS numbers, (SELECT count(*) FROM ({FEW}) n WHERE n.num1 = CAST(nums[1] AS HUGEINT)) AS found FROM q""")
def nb1_tail_long(spark, sf_dir):
    """Numbers of up to 25 digits, and what they find: never an entry with number 0."""
    q = spark.sql(LONG, orders=_read(spark, sf_dir, "orders")).select("qid", numbers.tail_parts(F.col("t"))[0].alias("numbers"))
    few = spark.sql(FEW).withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    tails = q.select("qid", F.lit(1).alias("lg_code"), F.lit(1).alias("machiaza_id"), F.lit(None).cast("array<int>").alias("alt_machiaza"), F.lit(0).alias("rsdt_addr_flg"), "numbers")
    found = banchi.with_entries(tails, few).groupBy("qid").agg(F.count("*").alias("found"))
    return q.join(found, "qid", "left").select("qid", F.array_join("numbers", "-").alias("numbers"), F.coalesce("found", F.lit(0)).alias("found"))


# ---- registry files


def _zipped(rows, columns: list[str], at: str):
    """The rows as zipped CSV files, one for each partition: their paths."""

    def write(frames):
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(at)
        store.create_dir(top, recursive=True)
        path = f"{top}/{uuid.uuid4().hex}.zip"
        with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("readme.txt", "w") as note:
                note.write(b"no rows here")
            with z.open("DATA.CSV", "w") as member:
                member.write(("\ufeff" + ",".join(columns) + "\r\n").encode())
                for frame in frames:
                    member.write(frame[columns].to_csv(index=False, header=False, lineterminator="\r\n").encode())
        import pandas as pd

        yield pd.DataFrame({"path": [path]})

    return [r["path"] for r in rows.mapInPandas(write, "path string").collect()]  # one row a file


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "x"' || chr(10) || '字' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(NULL AS VARCHAR) AS absent FROM customer""")
def src1_zip_files(spark, sf_dir):
    """CSV members with a byte order mark, quotes and line breaks, from several zip files."""
    own = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) c_custkey", """c_name || ', "x"\n字' AS c_name""", "cast(c_nationkey as string) c_nationkey").repartition(3, "c_custkey")
    paths = _zipped(own, ["c_nationkey", "c_name", "c_custkey"], scratch(spark))
    return registry.read_zips(spark, paths, ["c_custkey", "c_name", "c_nationkey", "absent"]).select("c_custkey", "c_name", "c_nationkey", "absent")


#: Registry rows of numbers, and their positions in two generations, the later one counting.
BODY = """SELECT CAST(lg_code AS STRING) AS lg_code, CAST(machiaza_id AS STRING) AS machiaza_id, CAST(num1 AS STRING) AS blk_id, CAST(num2 AS STRING) AS rsdt_id,
  CASE WHEN num3 = 0 THEN '' ELSE CAST(num3 AS STRING) END AS rsdt2_id, CAST(num1 AS STRING) AS blk_num, CAST(num2 AS STRING) AS rsdt_num, CASE WHEN num3 = 0 THEN '' ELSE CAST(num3 AS STRING) END AS rsdt_num2,
  lpad(CAST(num1 AS STRING), 5, '0') || lpad(CAST(num2 AS STRING), 5, '0') || lpad(CAST(num3 AS STRING), 5, '0') AS prc_id,
  CASE WHEN (num1 + num2 + num3) % 5 = 0 THEN '3' WHEN (num1 + num2 + num3) % 5 = 1 THEN NULL ELSE '1' END AS status_flg, num1, num2, num3 FROM {g_number} WHERE kind = {KIND}"""
_POS = "CASE WHEN (num1 + num2 + {g}) % {k} = 0 THEN {empty} ELSE CAST(num1 * 100 + num2 * 10 + num3 + {g} AS STRING) END"
POSITIONS = " UNION ALL ".join(
    f"SELECT lg_code, machiaza_id, blk_id, rsdt_id, rsdt2_id, prc_id, CAST({g} AS BIGINT) AS ord, {_POS.format(g=g, k=3, empty=repr(''))} AS rep_lat, {_POS.format(g=g, k=4, empty='NULL')} AS rep_lon FROM {{body}} WHERE num2 % 4 <> 1" for g in (0, 1)
)
_IDS = {KIND_BLOCK: ["blk_id"], KIND_RSDT: ["blk_id", "rsdt_id", "rsdt2_id"], KIND_PARCEL: ["prc_id"]}


def _number_sql(kind: int) -> str:
    ids = ["lg_code", "machiaza_id", *_IDS[kind]]
    columns = "lg_code, machiaza_id, blk_id, blk_num, status_flg, num1, 0 AS num2, 0 AS num3" if kind == KIND_BLOCK else "*"
    distinct = "DISTINCT" if kind == KIND_BLOCK else ""
    return f"""{WITH}, raw AS ({BODY.format(g_number='g_number', KIND=kind)}), pos AS ({POSITIONS.format(body='raw')}),
good AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(ids)} ORDER BY ord DESC, rep_lat, rep_lon) AS r FROM (SELECT DISTINCT {', '.join(ids)}, ord, rep_lat, rep_lon FROM pos WHERE rep_lat <> '' AND rep_lon IS NOT NULL)),
body AS (SELECT {distinct} {columns} FROM raw WHERE status_flg IS DISTINCT FROM '3')
SELECT CAST(b.lg_code AS INT) AS lg_code, CAST(b.machiaza_id AS INT) AS machiaza_id, {kind} AS kind, num1, num2, num3, CAST(rep_lat AS DOUBLE) AS lat, CAST(rep_lon AS DOUBLE) AS lon
FROM body b LEFT JOIN good g ON r = 1 AND {' AND '.join(f'g.{c} = b.{c}' for c in ids)}"""


def _number_rows(spark, sf_dir, kind):
    raw = spark.sql(BODY.replace("{KIND}", str(kind)), g_number=_g(spark, sf_dir)["g_number"])
    pos = spark.sql(POSITIONS, body=raw)
    if kind == KIND_BLOCK:  # a block's position is that of its smallest row
        pos = pos.groupBy("lg_code", "machiaza_id", "blk_id", "ord").agg(F.min(F.when((F.col("rep_lat") != "") & F.col("rep_lon").isNotNull(), F.struct("rep_lat", "rep_lon"))).alias("p")).select("lg_code", "machiaza_id", "blk_id", "ord", "p.*")
        raw = raw.select("lg_code", "machiaza_id", "blk_id", "blk_num", "status_flg").distinct()
    return registry.number_rows(kind, raw, pos)


@query(_number_sql(KIND_BLOCK))
def bd9_blocks(spark, sf_dir):
    return _number_rows(spark, sf_dir, KIND_BLOCK)


@query(_number_sql(KIND_RSDT))
def bd9_houses(spark, sf_dir):
    """Also JN10: points met by integer ids, the last of a key, both coordinates or none."""
    return _number_rows(spark, sf_dir, KIND_RSDT)


@query(_number_sql(KIND_PARCEL))
def bd9_parcels(spark, sf_dir):
    return _number_rows(spark, sf_dir, KIND_PARCEL)


@query(f"""{WITH}, raw AS ({BODY.format(g_number='g_number', KIND=3)}) SELECT machiaza_id, prc_id, status_flg FROM raw WHERE status_flg IS NULL OR status_flg <> '3'""")
def pr1_in_force(spark, sf_dir):
    raw = spark.sql(BODY.replace("{KIND}", "3"), g_number=_g(spark, sf_dir)["g_number"])
    return registry.in_force(raw).select("machiaza_id", "prc_id", "status_flg")


@query(f"""{WITH}, raw AS ({BODY.format(g_number='g_number', KIND=3)}), pos AS ({POSITIONS.format(body='raw')}),
usable AS (SELECT * FROM pos WHERE coalesce(rep_lat, '') <> '' AND coalesce(rep_lon, '') <> '')
SELECT machiaza_id, prc_id, CAST(max_by(rep_lat, ord) AS DOUBLE) AS lat, CAST(max_by(rep_lon, ord) AS DOUBLE) AS lon FROM usable GROUP BY 1, 2""")
def pr2_positions(spark, sf_dir):
    raw = spark.sql(BODY.replace("{KIND}", "3"), g_number=_g(spark, sf_dir)["g_number"])
    return registry.positions(spark.sql(POSITIONS, body=raw), {"machiaza_id": F.col("machiaza_id"), "prc_id": F.col("prc_id")})


CITY_BODY = "SELECT CAST(lg_code AS STRING) AS lg_code, pref, county, city, ward, CASE WHEN nation % 6 = 4 THEN '3' ELSE '1' END AS status_flg FROM {g_city}"
CITY_POS = "SELECT CAST(lg_code AS STRING) AS lg_code, CAST(nation AS BIGINT) AS ord, CAST(nation * 10 AS STRING) AS rep_lat, CASE WHEN nation % 5 = 2 THEN '' ELSE CAST(nation AS STRING) END AS rep_lon FROM {g_city} WHERE nation % 7 <> 3"


@query(f"""{WITH}, body AS ({CITY_BODY.format(g_city='g_city')}), pos AS ({CITY_POS.format(g_city='g_city')})
SELECT CAST(b.lg_code AS INT) AS lg_code, city, CAST(p.rep_lat AS DOUBLE) AS lat, CAST(p.rep_lon AS DOUBLE) AS lon FROM body b LEFT JOIN pos p ON p.lg_code = b.lg_code AND rep_lon <> '' WHERE status_flg <> '3'""")
def jn11_city_points(spark, sf_dir):
    g = _g(spark, sf_dir)["g_city"]
    return registry.cities(spark.sql(CITY_BODY, g_city=g), spark.sql(CITY_POS, g_city=g)).select("lg_code", "city", "lat", "lon")


# ---- catalogue

_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'mt_town' WHEN 1 THEN 'mt_town_pos' WHEN 2 THEN 'mt_parcel' WHEN 3 THEN 'mt_parcel_pos' ELSE 'mt_city' END"
_SCOPE = "CASE p_size % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'pref' ELSE 'city' END"
_CODE = "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(10 + p_partkey % 37 AS STRING) ELSE CAST(100000 + p_partkey * 991 % 370000 AS STRING) END"
_URL = "'https://data.address-br.digital.go.jp/' || kind || '/' || CASE scope WHEN 'all' THEN kind || '_all' ELSE scope || '/' || kind || '_' || scope || code END || '.csv.zip'"
FILES = f"SELECT p_partkey AS ord, kind, scope, code, {_URL} AS url, p_name AS title, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'm' || CAST(p_partkey % 4 AS STRING) END AS modified FROM (SELECT *, {_KIND} AS kind, {_SCOPE} AS scope, {_CODE} AS code FROM {{part}}) x"

def _files(spark, sf_dir):
    return spark.sql(FILES, part=_read(spark, sf_dir, "part"))


@query(f"WITH files AS ({FILES.format(part='part')}) SELECT kind, scope, code, url, title, modified FROM files WHERE ord IN (SELECT min(ord) FROM files GROUP BY url)")
def src2_feed(spark, sf_dir):
    """Feeds parsed: an address or the other, each once, others dropped."""
    files = _files(spark, sf_dir)
    firsts = files.groupBy("url").agg(F.min("ord").alias("ord"))
    feeds = files.select("ord", _feed_json())
    return catalog.parse_feed(feeds.join(firsts, "ord").select("json")).select("kind", "scope", "code", "url", "title", "modified")


def _feed_json():
    link = lambda access, download: F.struct(access.alias("accessURL"), download.alias("downloadURL"))
    none = F.lit(None).cast("string")
    links = F.array(link(F.when(F.col("ord") % 2 == 0, F.col("url")).otherwise(F.lit("")), F.col("url")), link(none, F.col("url")), link(F.concat(F.lit("https://elsewhere.example/"), F.col("ord").cast("string"), F.lit(".csv.zip")), none), link(none, none))
    own = F.struct(F.col("title"), F.coalesce("modified", F.lit("")).alias("modified"), links.alias("distribution"))
    return F.to_json(F.struct(F.array(own, F.struct(F.lit("no files").alias("title"), F.lit("").alias("modified"), F.lit(None).cast(LINKS).alias("distribution"))).alias("dataset"))).alias("json")


LINKS = "array<struct<accessURL:string,downloadURL:string>>"
_KINDS = ["mt_town", "mt_parcel", "mt_town_pos"]
_OWN = f"files AS ({FILES.format(part='part')}), own AS (SELECT * FROM files WHERE kind IN ('mt_town', 'mt_parcel', 'mt_town_pos'))"


@query(f"""WITH {_OWN} SELECT kind, scope, code, ord FROM own o WHERE scope = 'all' AND ord = (SELECT min(ord) FROM own x WHERE x.kind = o.kind AND x.scope = 'all')
UNION ALL SELECT kind, scope, code, ord FROM own o WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.kind = o.kind AND x.scope = 'all')
  AND (scope = 'pref' OR NOT EXISTS (SELECT 1 FROM own x WHERE x.kind = o.kind AND x.scope = 'pref'))""")
def src4_national(spark, sf_dir):
    return catalog.select_files(_files(spark, sf_dir), _KINDS).select("kind", "scope", "code", "ord")


@query(f"""WITH {_OWN}, fit AS (SELECT *, CASE WHEN scope = 'pref' AND code IN ('12', '20') THEN 1 WHEN scope = 'city' AND left(code, 2) IN ('12', '20') THEN 2 WHEN scope = 'all' THEN 3 END AS p FROM own)
SELECT kind, scope, code, ord FROM fit f WHERE p = (SELECT min(p) FROM fit x WHERE x.kind = f.kind) AND (scope <> 'all' OR ord = (SELECT min(ord) FROM fit x WHERE x.kind = f.kind AND scope = 'all'))""")
def src4_by_area(spark, sf_dir):
    return catalog.select_files(_files(spark, sf_dir), _KINDS, ["12", "20"]).select("kind", "scope", "code", "ord")


@query(f"""WITH files AS ({FILES.format(part='part')}), once AS (SELECT * FROM files f WHERE ord = (SELECT min(ord) FROM files x WHERE x.url = f.url)), pos AS (SELECT * FROM once WHERE kind LIKE '%_pos')
SELECT b.url, (SELECT p.url FROM pos p WHERE p.kind = b.kind || '_pos' AND p.code = b.code ORDER BY p.scope <> b.scope, p.ord LIMIT 1) AS pos_url FROM once b WHERE b.kind NOT LIKE '%_pos'""")
def src8_pairs(spark, sf_dir):
    files = _files(spark, sf_dir)
    once = files.join(files.groupBy("url").agg(F.min("ord").alias("ord")), ["url", "ord"], "left_semi")
    return catalog.pair_files(once).select("url", "pos_url")


@query(f"""WITH files AS ({FILES.format(part='part')}) SELECT f.ord FROM files f WHERE NOT EXISTS (SELECT 1 FROM files l WHERE l.ord % 3 = 0 AND l.url = f.url AND l.modified = f.modified)""")
def jn15_stale(spark, sf_dir):
    """Files to read again: what the ledger (every third file) doesn't hold as it is now."""
    files = _files(spark, sf_dir)
    held = files.where("ord % 3 = 0").select("url", F.col("modified").alias("last_modified"))
    return catalog.stale(files.withColumnRenamed("modified", "last_modified"), held).select("ord")


# ---- store


@query(f"""{WITH}, late AS (SELECT lg_code, machiaza_id, kind, num1 + 100 AS num1, num2, num3, lat, lon FROM g_number WHERE machiaza_id % 3 = 0 AND num1 < 5)
SELECT lg_code, machiaza_id, CAST(kind AS INT) AS kind, num1, num2, num3, lat, lon FROM late UNION ALL SELECT lg_code, machiaza_id, kind, num1, num2, num3, lat, lon FROM g_number n
WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.lg_code = n.lg_code AND l.machiaza_id = n.machiaza_id AND l.kind = n.kind)""")
def snk2_numbers_replaced(spark, sf_dir):
    """Numbers written twice: lists of towns and kinds that come again replace those held."""
    store, own = Store(spark, scratch(spark)), _g(spark, sf_dir)["g_number"]
    store.put_numbers(own)
    store.put_numbers(own.where("machiaza_id % 3 = 0 and num1 < 5").withColumn("num1", F.col("num1") + 100))
    return store.read("banchi")


@query(f"""{WITH}, least AS (SELECT min(CAST(lg_code AS BIGINT) * 100000000 + machiaza_id * 100 + kind) AS k FROM g_number)
SELECT num1, num2, num3, lat, lon FROM g_number, least WHERE CAST(lg_code AS BIGINT) * 100000000 + machiaza_id * 100 + kind = k""")
def src11_lookup(spark, sf_dir):
    store, own = Store(spark, scratch(spark)), _g(spark, sf_dir)["g_number"]
    store.put_numbers(own)
    first = own.agg(F.min(F.struct("lg_code", "machiaza_id", "kind")).alias("k")).first()["k"]
    return store.lookup(*first).select("num1", "num2", "num3", "lat", "lon")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 4 = 1 THEN 'new' ELSE n_name END AS value FROM nation UNION ALL SELECT 'more', 'new'")
def snk1_upsert(spark, sf_dir):
    store, own = Store(spark, scratch(spark)), _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    store.replace("meta", own)
    again = own.where("cast(key as int) % 4 = 1").withColumn("value", F.lit("new")).unionByName(spark.createDataFrame([("more", "new")], "key string, value string"))
    store.upsert("meta", again, ["key"])
    return store.read("meta")
