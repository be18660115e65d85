"""End to end without a model, over the small world."""

import pytest
import world

from tokoro.operators.index import Index
from tokoro.plans.geocode import geocode
from tokoro.storage import stored
from tokoro.streaming.stream import geocode_stream

CASES = [
    ("架空県汐見市若葉三丁目4番6号メゾン205", {"granularity": "rsdt", "machiaza": "若葉三丁目", "banchi": "4番6号", "blk_id": "004", "rsdt_id": "006", "remainder": "メゾン205", "resolved": True, "lat": 41.10032}),
    ("汐見市若葉3丁目4-6", {"granularity": "rsdt", "address": "架空県汐見市若葉三丁目4番6号", "point_granularity": "rsdt"}),
    ("見本県南試郡風待町貝浜免12番地3", {"granularity": "parcel", "banchi": "12-3番地", "prc_id": "000120000300000", "lat": 32.50102}),
    ("風待町貝浜免12番地", {"granularity": "parcel", "banchi": "12番地", "prc_id": "", "note_code": "BRANCH_UNKNOWN", "lat": 32.50101}),
    ("見本県風待町松浦免410", {"granularity": "parcel", "prc_id": "004100000000000", "machiaza_id": "0009500"}),
    ("架空県汐見市", {"granularity": "city", "resolved": True, "confidence": 1.0, "lg_code": "501018", "note_code": ""}),
    ("架空県", {"granularity": "pref", "resolved": True, "lg_code": "500003"}),
    ("住所ではない文", {"granularity": "unknown", "resolved": False, "note_code": "NO_CANDIDATE"}),
    ("", {"granularity": "unknown", "note_code": "NO_CANDIDATE"}),
    ("架空県汐見市若葉77-8", {"granularity": "machiaza", "machiaza": "若葉", "machiaza_id": "0031000", "point_granularity": "machiaza"}),
    ("雲井市東区小文字町９", {"granularity": "city", "resolved": False, "note_code": "MODEL_NOT_CONFIGURED", "confidence": 0.0}),
    ("架空県汐見市遠野町字沢口", {"granularity": "machiaza", "point_granularity": "city", "point_is_coarser": True, "lat": 41.0}),
    ("架空県汐見市若", {"granularity": "city", "note_code": "MODEL_NOT_CONFIGURED"}),
    ("架空県汐見市苦葉三丁目4", {"granularity": "city", "note_code": "MODEL_NOT_CONFIGURED"}),
    ("若葉三丁目4番6号", {"granularity": "unknown"}),
    ("架空県汐見市葉月", {"machiaza": "大字葉月", "resolved": True}),
    ("例示都星見区虹が谷五丁目", {"machiaza": "虹が谷５丁目"}),
    ("架空県 汐見市　若葉三丁目８番１号", {"granularity": "rsdt", "banchi": "8番1号"}),
    ("架空県汐見市若葉三丁目4番", {"granularity": "block", "banchi": "4番", "blk_id": "", "note_code": "BRANCH_UNKNOWN"}),
    ("見本県岬市", {"granularity": "pref", "resolved": False, "note_code": "UNDETERMINED"}),
    ("架空県汐見市若葉三丁目6番6号", {"granularity": "machiaza", "resolved": True, "remainder": "6番6号", "note_code": ""}),
    # numbers beyond 32 and 64 bits are found nowhere, not under 0
    ("風待町貝浜免9999999999番地", {"granularity": "machiaza", "banchi": "", "prc_id": "", "remainder": "9999999999番地"}),
    ("風待町貝浜免99999999999999999999番地", {"granularity": "machiaza", "prc_id": ""}),
    ("風待町貝浜免12番地99999999999999999999", {"granularity": "machiaza", "prc_id": ""}),
    ("風待町貝浜免0番地", {"granularity": "parcel", "prc_id": "000000000000000"}),
    ("ｶｸｳ県", {"granularity": "unknown"}),
    ("汐見市若葉㊂丁目", {"granularity": "machiaza", "machiaza": "若葉三丁目"}),
]


@pytest.fixture(scope="module")
def results(spark):
    return {r["query"]: r for r in geocode(world.queries(spark, [q for q, _ in CASES]), world.index(spark)).collect()}


@pytest.mark.parametrize("query, expected", CASES)
def test_case(results, query, expected):
    row = results[query]
    assert {k: row[k] for k in expected} == expected


def test_one_row_a_query(results):
    assert len(results) == len({q for q, _ in CASES})


def test_a_stream_is_geocoded_batch_by_batch(spark, tmp_path, results):
    world.queries(spark, [q for q, _ in CASES[:4]]).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, query string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = geocode_stream(stream, world.index(spark), str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    got = {r["query"]: r["address"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {q: results[q]["address"] for q, _ in CASES[:4]}


def test_plans_of_stable_texts_need_no_python(spark):
    """The look-up joins are broadcast joins, and no Python stands between stable texts and them."""
    from tokoro.operators.candidates import town_hits

    texts, made = stored(world.queries(spark, ["架空県汐見市若葉"]).withColumnRenamed("query", "norm")), world.index(spark)
    made = Index(made.towns, stored(made.heads), stored(made.keys), stored(made.cities), stored(made.prefs), made.numbers)
    plan = town_hits(texts, made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    assert "Exchange hash" not in plan.split("BroadcastExchange")[0]  # the texts aren't shuffled
