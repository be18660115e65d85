"""A small invented gazetteer: siblings with and without chome, a one-character and a
prefixed name, a chome in full-width digits, a county, two towns of one name, a town without
a point, and a town with a folded second id."""

from pyspark.sql import functions as F

from tokoro.operators.index import Index
from tokoro.schema import CITY_TABLE, NAMES, NUMBER_TABLE, PREF_TABLE

SHIO, KAZE = ("架空県", "", "汐見市", ""), ("見本県", "南試郡", "風待町", "")
TOWNS = [
    (0, 501018, 31000, 0, *SHIO, "若葉", "", "", "", 41.1001, 141.2001, None),
    (1, 501018, 31003, 1, *SHIO, "若葉", "三丁目", "3", "", 41.1003, 141.2003, None),
    (2, 501018, 31004, 1, *SHIO, "若葉", "四丁目", "4", "", 41.1004, 141.2004, None),
    (3, 501018, 7000, 0, *SHIO, "梢", "", "", "", 41.15, 141.25, None),
    (4, 501018, 8000, 0, *SHIO, "大字葉月", "", "", "", 41.16, 141.26, None),
    (5, 520021, 4005, 1, "例示都", "", "星見区", "", "虹が谷", "５丁目", "5", "", 36.505, 138.505, None),
    (6, 530034, 60000, 0, "試作府", "", "雲井市", "東区", "小文字町", "", "", "", 34.01, 136.01, None),
    (7, 530034, 61000, 0, "試作府", "", "雲井市", "東区", "小文字町", "", "", "", 34.02, 136.02, None),
    (8, 514047, 9000, 0, *KAZE, "貝浜免", "", "", "", 32.501, 130.501, None),
    (9, 501018, 99000, 0, *SHIO, "遠野町", "", "", "字沢口", None, None, None),
    (10, 514047, 9500, 0, *KAZE, "字松浦免", "", "", "", 32.601, 130.601, [9700]),
]
CITIES = [(501018, *SHIO, 41.0, 141.0), (514047, *KAZE, 32.4, 130.4), (520021, "例示都", "", "星見区", "", 36.5, 138.5), (530034, "試作府", "", "雲井市", "東区", 34.0, 136.0)]
PREFS = [(500003, "架空県", 40.9, 140.9), (510009, "見本県", 32.0, 130.0), (520004, "例示都", 36.0, 138.0), (530000, "試作府", 33.9, 135.9)]
NUMBERS = [
    (501018, 31003, 2, 4, 5, 0, 41.10031, 141.20031), (501018, 31003, 2, 4, 6, 0, 41.10032, 141.20032), (501018, 31003, 2, 8, 1, 0, 41.10033, 141.20033),
    (514047, 9000, 3, 12, 1, 0, 32.50101, 130.50101), (514047, 9000, 3, 12, 3, 0, 32.50102, 130.50102), (514047, 9000, 3, 15, 1, 0, 32.50103, 130.50103),
    (514047, 9000, 3, 0, 0, 0, 32.5, 130.5),
    (514047, 9500, 3, 33, 0, 0, 32.60101, 130.60101), (514047, 9700, 3, 410, 0, 0, 32.60201, 130.60201),
]


def index(spark) -> Index:
    towns = spark.createDataFrame(TOWNS, f"row_id int, lg_code int, machiaza_id int, rsdt_addr_flg int, {NAMES}, lat double, lon double, alt_machiaza array<int>")
    towns = towns.withColumn("source", F.lit("registry"))
    return Index.of_towns(towns, spark.createDataFrame(CITIES, CITY_TABLE), spark.createDataFrame(PREFS, PREF_TABLE), spark.createDataFrame(NUMBERS, NUMBER_TABLE))


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
