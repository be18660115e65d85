"""The decision stage with a deterministic model, and a build from zip files."""

import io
import json
import sys
import time
import urllib.error
import zipfile

import pytest
import world
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tokoro import cli
from tokoro.config import Config
from tokoro.plans.build import build
from tokoro.plans.decide import Decision, Question, Usage, ask, decode, encode, geocode_with_model, latencies, merged, pack
from tokoro.plans.evaluate import accuracy, recall_and_precision
from tokoro.plans.geocode import geocode
from tokoro.sources.catalog import FEED_URL, kinds_for_level, pair_files, parse_feed, select_files
from tokoro.sources.fetch import download_all
from tokoro.sources.model_http import HttpModel, ModelUnavailable, configured
from tokoro.sources.sinks import human, info, json_lines
from tokoro.sources.store import Store
from tokoro.sources.supplement import SUPPLEMENT_URL


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Fake:
    """Takes an option by number; the rest of the mass is spread evenly."""

    def __init__(self, pick=0, confidence=0.95, fail=False):
        self.pick, self.confidence, self.fail = pick, confidence, fail

    def choose(self, questions):
        if self.fail:
            raise RuntimeError("down")
        if self.pick is None:
            out = [Decision(None, self.confidence, self.confidence, 1 - self.confidence) for _ in questions]
        else:
            out = [Decision(min(self.pick, len(q.options) - 1), self.confidence, self.confidence, 1 - (1 - self.confidence) / max(1, len(q.options))) for q in questions]
        return out, Usage(100, 10, 1)


SAME, TYPO, NUMBER = "試作府雲井市東区小文字町", "架空県汐見市苦葉", "風待町貝浜免15番地9"


@pytest.mark.parametrize(
    "model, expected",
    [
        (Fake(), {SAME: {"granularity": "machiaza", "note_code": "SAME_NAME", "machiaza_id": "0060000", "confidence": 0.95}, TYPO: {"granularity": "machiaza", "resolved": True}, NUMBER: {"granularity": "parcel", "banchi": "15-1番地"}}),
        (Fake(fail=True), {SAME: {"granularity": "city", "note_code": "MODEL_FAILED"}}),
        (Fake(None, 0.6), {SAME: {"granularity": "city", "note_code": "UNDETERMINED"}, NUMBER: {"granularity": "machiaza", "note_code": "NUMBER_NOT_FOUND", "resolved": True}}),
    ],
)
def test_model(spark, model, expected):
    rows, _ = geocode_with_model(world.queries(spark, [*expected, "架空県汐見市梢"]), world.index(spark), Config(), model)
    by = {r["query"]: r for r in rows.collect()}
    assert {q: {k: by[q][k] for k in want} for q, want in expected.items()} == expected
    assert by["架空県汐見市梢"]["machiaza"] == "梢"


def test_narrowing(spark):
    cfg = Config(max_options=4)
    rows, usage = geocode_with_model(world.queries(spark, ["架空県汐見市苦葉三丁目"]), world.index(spark), cfg, Fake())
    assert rows.first()["granularity"] == "machiaza" and 2 <= usage["requests"] <= 3


def test_packing_and_codec():
    sizes = lambda owners, budget: [len(g) for g in pack(({"qid": q} for q in owners), lambda r: 10, budget, 1, 99)]
    assert sizes([1, 1, 2], 820) == [2, 1] and sizes([1, 1, 1], 815) == [1, 1, 1]
    assert decode("1", {"1": 0.7, "none": 0.2}, 0.9, "none", 3) == Decision(1, 0.7, 0.9, 0.8)
    assert decode(None, {"none": 0.9}, 0.9, "none", 3).index is None and decode("x", {}, 0.1, "none", 3).index is None
    request = encode([Question({"a": "1"}, "?", ["x"], "1"), Question({"a": "1"}, "?", ["y"], "2")])
    assert len(request["subjects"]) == 1 and list(request["questions"][0]["options"]) == ["0", "none"]
    with pytest.raises(ValueError):
        Config(max_options=256)


def test_sinks(spark):
    rows = geocode(world.queries(spark, ["架空県汐見市", "架空県汐見市遠野町字沢口"]), world.index(spark))
    out = [json.loads(r["value"]) for r in json_lines(rows).sort("qid").collect()]
    assert out[0]["machiaza"] is None and out[0]["city"] == "汐見市" and "normalized" not in out[0]
    assert "(of the city)" in human(rows).sort("qid").collect()[1]["value"]


def test_catalogue(spark):
    host = "https://data.address-br.digital.go.jp"
    urls = [f"{host}/mt_town/mt_town_all.csv.zip", f"{host}/mt_town/pref/mt_town_pref31.csv.zip", f"{host}/mt_town/city/mt_town_city312011.csv.zip", f"{host}/mt_town_pos/pref/mt_town_pos_pref31.csv.zip", "https://elsewhere/x.csv.zip"]
    feed = json.dumps({"dataset": [{"title": "t", "distribution": [{"accessURL": u}, {"downloadURL": u}]} for u in urls]})
    refs = parse_feed(spark.createDataFrame([(feed,)], "json string"))
    assert refs.count() == 4
    pick = lambda **k: [r["code"] for r in select_files(refs, ["mt_town"], **k).collect()]
    assert pick() == [""] and pick(prefs=["31"]) == ["31"] and pick(cities=["312011"]) == ["312011"] and pick(prefs=["01"]) == [""]
    pairs = {r["code"]: r["pos_url"] for r in pair_files(refs).collect()}
    assert pairs["31"] == urls[3] and pairs["312011"] is None
    assert kinds_for_level("rsdt")[-1] == "mt_rsdtdsp_rsdt_pos"


def zipped(folder, name, text):
    path = folder / f"{name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{name}.csv", "\ufeff" + text)
    return str(path)


TEXTS = {
    "mt_pref": "lg_code,pref\n500003,架空県\n",
    "mt_city": "lg_code,pref,county,city,ward,status_flg\n501018,架空県,,汐見市,,1\n599999,架空県,,廃市,,3\n",
    "mt_city_pos": "lg_code,rep_lat,rep_lon\n501018,41.0,141.0\n",
    "mt_town": "lg_code,machiaza_id,rsdt_addr_flg,pref,county,city,ward,oaza_cho,chome,chome_number,koaza,status_flg\n501018,1,0,架空県,,汐見市,,大字葉月,,,字上,1\n501018,2,0,架空県,,汐見市,,葉月,,,上,1\n501018,3,1,架空県,,汐見市,,若葉,一丁目,1,,1\n501018,4,1,架空県,,汐見市,,廃町,,,,3\n",
    "mt_town_pos": "lg_code,machiaza_id,rsdt_addr_flg,rep_lat,rep_lon\n501018,2,0,41.1,141.1\n501018,3,0,41.2,141.2\n501018,1,0,,141.3\n",
    "mt_parcel": "lg_code,machiaza_id,prc_id,status_flg\n501018,2,000070000000000,1\n501018,1,000080000200000,\n501018,1,000090000000000,3\n",
    "mt_parcel_pos": "lg_code,machiaza_id,prc_id,rep_lat,rep_lon\n501018,2,000070000000000,41.11,141.11\n501018,1,000080000200000,41.12,\n",
    "mt_rsdtdsp_blk": "lg_code,machiaza_id,blk_id,blk_num,status_flg\n501018,3,005,5,1\n501018,3,006,6,1\n",
    "mt_rsdtdsp_blk_pos": "lg_code,machiaza_id,blk_id,rep_lat,rep_lon\n501018,3,006,41.26,141.26\n",
    "mt_rsdtdsp_rsdt": "lg_code,machiaza_id,blk_id,rsdt_id,rsdt2_id,blk_num,rsdt_num,rsdt_num2,status_flg\n501018,3,005,001,,5,1,,1\n501018,3,005,001,002,5,1,2,1\n",
    "mt_rsdtdsp_rsdt_pos": "lg_code,machiaza_id,blk_id,rsdt_id,rsdt2_id,rep_lat,rep_lon\n501018,3,005,001,002,41.27,141.27\n501018,3,005,001,,41.28,141.28\n",
}
EXTRA = "都道府県コード,都道府県名,市区町村コード,市区町村名,大字町丁目名,小字・通称名,緯度,経度\n50,架空県,1,汐見市,新町,,41.3,x\n50,架空県,1,汐見市,若葉1丁目,,41.9,141.9\n50,架空県,1,無い市,町,,1,1\n50,架空県,1,汐見市,,,1,1\n"


def test_build(spark, tmp_path):
    files = {k: [zipped(tmp_path, k, t)] for k, t in TEXTS.items()}
    extra = tmp_path / "extra.csv"
    extra.write_text(EXTRA)
    root = str(tmp_path / "data")
    report = build(spark, root, files, "parcel", str(extra), modified={files["mt_parcel"][0]: "m1"})
    assert (report["towns"], report["folded"], report["added"], report["merged"], report["numbers"]) == (2, 1, 1, 1, 6)
    store = Store(spark, root)
    assert store.counts() == {"pref": 1, "city": 1, "machiaza": 3, "banchi": 6}
    assert [r["num1"] for r in store.lookup(501018, 2, 3, 7).collect()] == [7]
    assert [(r["num1"], r["lat"]) for r in store.lookup(501018, 3, 1).collect()] == [(5, None), (6, 41.26)]
    assert [(r["num2"], r["num3"], r["lat"]) for r in store.lookup(501018, 3, 2).collect()] == [(1, 0, 41.28), (1, 2, 41.27)]
    assert [r["lat"] for r in store.lookup(501018, 1, 3).collect()] == [None]  # one coordinate is none
    rows = {r["query"]: r for r in geocode(world.queries(spark, ["汐見市葉月上7番地", "架空県汐見市若葉1丁目", "汐見市新町3", "汐見市若葉1丁目5番1号の2", "汐見市若葉1丁目6"]), store.index()).collect()}
    assert rows["汐見市葉月上7番地"]["prc_id"] == "000070000000000" and rows["汐見市葉月上7番地"]["lat"] == 41.11
    assert rows["架空県汐見市若葉1丁目"]["lat"] == 41.2 and rows["汐見市新町3"]["machiaza_id"] == ""
    assert rows["汐見市若葉1丁目5番1号の2"]["rsdt2_id"] == "002" and rows["汐見市若葉1丁目6"]["granularity"] == "block"
    ledger = {r["kind"]: (r["rows"], r["last_modified"]) for r in store.sources().collect()}
    assert ledger == {"mt_parcel": (2, "m1"), "mt_rsdtdsp_blk": (2, None), "mt_rsdtdsp_rsdt": (2, None)}
    build(spark, root, files, "parcel", modified={files["mt_parcel"][0]: "m1"})  # the unchanged number file is skipped
    assert store.counts()["banchi"] == 6 and "version 2" in info(store)


def test_a_table_is_switched_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = (spark.createDataFrame([(k, k)], "key string, value string") for k in "ab")
    assert store.read("meta").count() == 0
    store.replace("meta", one)
    reader = store.read("meta")
    store.replace("meta", store.read("meta").unionByName(two))
    assert reader.count() == 1 and store.read("meta").count() == 2  # a reader of the old table can finish
    with pytest.raises(Exception, match="no such"):
        store.replace("meta", two.withColumn("key", F.expr("raise_error('no such')")))
    assert {r["key"] for r in store.read("meta").collect()} == {"a", "b"}  # a lost job leaves what was there


HOST = "https://data.address-br.digital.go.jp"


class Site:
    """Answers like the registry's servers: a feed, files with Last-Modified, a supplement."""

    def __init__(self, folder, texts, codes):
        self.files, self.asked, urls = {}, [], []
        for kind, text in texts.items():
            for code in codes:
                scope = "all" if kind in ("mt_pref", "mt_pref_pos") else "city"
                url = f"{HOST}/{kind}/{kind}_all.csv.zip" if scope == "all" else f"{HOST}/{kind}/city/{kind}_city{code}.csv.zip"
                if url not in urls:
                    urls.append(url)
                    self.files[url] = open(zipped(folder, f"{kind}{code}", text.replace("501018", code)), "rb").read()
        self.urls = urls

    def __call__(self, url, headers, timeout):
        self.asked.append(url)
        if url == FEED_URL:
            body = json.dumps({"dataset": [{"title": "t", "modified": "1", "distribution": [{"accessURL": u}]} for u in self.urls]}).encode()
        elif url == SUPPLEMENT_URL:
            body = EXTRA.encode()
        elif url not in self.files:
            raise urllib.error.HTTPError(url, 404, "none", {}, None)
        elif headers.get("If-Modified-Since") == "m1":
            raise urllib.error.HTTPError(url, 304, "same", {}, None)
        else:
            body = self.files[url]
        answer = io.BytesIO(body)
        answer.headers = {"Last-Modified": "m1"}
        return answer


def test_build_from_the_catalogue_by_command_line(spark, tmp_path, capsys):
    site = Site(tmp_path, TEXTS, ["501018", "502022"])
    site.urls.remove(f"{HOST}/mt_parcel_pos/city/mt_parcel_pos_city501018.csv.zip")  # one position file is missing
    root = str(tmp_path / "own")
    assert cli.main(["build", "--data", root, "--level", "parcel", "--pref", "50"], site) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["files"] == report["downloaded"] == len(site.urls) and report["numbers"] == 12 and report["notes"] == []
    assert report["added"] == 1 and report["merged"] == 1
    store = Store(spark, root)
    assert [r["lat"] for r in store.lookup(501018, 2, 3).collect()] == [None] and [r["lat"] for r in store.lookup(502022, 2, 3).collect()] == [41.11]
    before = len(site.asked)
    assert cli.main(["build", "--data", root, "--level", "parcel", "--city", "502022", "--no-supplement"], site) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["unchanged"] == report["files"] == len(site.asked) - before - 1 and report["downloaded"] == 0 and store.counts()["banchi"] == 12
    assert cli.main(["build", "--data", str(tmp_path / "none"), "--pref", "99", "--no-supplement"], Site(tmp_path, {}, [])) == 0
    assert "no file covers" in capsys.readouterr().out
    assert cli.main(["info", "--data", root]) == 0 and "banchi: 12" in capsys.readouterr().out
    assert cli.main(["normalize", "--data", root, "--no-model", "汐見市葉月上7番地"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["granularity"] == "parcel"  # the names are those of the last selection


def test_downloads_are_replaced_whole(tmp_path):
    site = Site(tmp_path, {"mt_pref": TEXTS["mt_pref"]}, ["501018"])
    first = download_all(site.urls, str(tmp_path / "c"), 2, site)
    assert [d.cached for d in first] == [False] and open(first[0].path, "rb").read() == site.files[site.urls[0]]
    assert [d.cached for d in download_all(site.urls, str(tmp_path / "c"), 2, site)] == [True]
    with pytest.raises(urllib.error.HTTPError):
        download_all([f"{HOST}/mt_pref/missing.csv.zip"], str(tmp_path / "c"), 2, site)


def test_http_model():
    asked = []

    def send(url, body, headers, timeout):
        asked.append((url, json.loads(body), headers))
        return json.dumps({"answers": [{"choice": "1", "probabilities": {"1": 0.8, "none": 0.1}, "confidence": 0.7}, None], "usage": {"input_tokens": 9, "output_tokens": 2}}).encode()

    questions = [Question({"a": "1"}, "?", ["x", "y"], str(k)) for k in range(3)]
    decisions, usage = HttpModel("http://model", "secret", send=send).choose(questions)
    assert decisions == [Decision(1, 0.8, 0.7, 0.9), Decision(None), Decision(None)] and usage == Usage(9, 2, 1)  # missing answers are no decisions
    (url, body, headers) = asked[0]
    assert headers["Authorization"] == "Bearer secret" and len(body["subjects"]) == 1 and len(body["questions"]) == 3
    for broken in (lambda *_: b"no json", lambda *_: 1 / 0):
        with pytest.raises(ModelUnavailable):
            HttpModel("http://model", send=broken).choose(questions)
    assert configured("http://x").url == "http://x" and configured() is None


class Flaky:
    """Fails for the second area question of an input, and answers too few of the others."""

    def choose(self, questions):
        if questions[0].question.startswith("Which of these areas") and questions[0].options[0].endswith("若葉"):
            raise RuntimeError("down")
        return [Decision(0, 0.9, 0.9, 0.95)], Usage(1, 1, 1)


def test_a_failed_request_drops_its_own_chunk(spark):
    cfg = Config(max_options=3, batch_size=8, narrow_max_machiaza=100, narrow_token_budget=1)
    rows, usage = geocode_with_model(world.queries(spark, ["架空県汐見市苦葉三丁目"]), world.index(spark), cfg, Flaky())
    row = rows.first()
    assert usage["narrow_requests"] == 1 and row["note_code"] != "NARROW_EMPTY" and row["machiaza"] not in ("", "若葉")
    rows, usage = geocode_with_model(world.queries(spark, ["試作府雲井市東区小文字町", "架空県汐見市苦葉"]), world.index(spark), Config(batch_size=8, concurrency=1), Flaky())
    notes = {r["qid"]: (r["granularity"], r["note_code"]) for r in rows.collect()}
    assert notes[0][0] == "machiaza" and notes[1][0] == "city"  # the second got no answer: no confidence


def test_candidates_are_listed_once_for_all_texts_that_share_them(spark, monkeypatch):
    """What a question's options are made of doesn't grow with the queries of a city: areas,
    survivors, and towns by display."""
    from tokoro.plans import decide

    seen, group = [], decide.group_first

    def counted(candidates, *a):
        seen.append(candidates.count())
        return group(candidates, *a)

    monkeypatch.setattr(decide, "group_first", counted)
    index, cfg, made, notes = world.index(spark), Config(max_options=3, narrow_max_machiaza=100, narrow_token_budget=1), [], []
    for n in (1, 12):
        seen.clear()
        texts = [f"{q}{k}番" for k in range(n) for q in ("架空県汐見市苦葉三丁目", "試作府雲井市東区小文字町", "風待町貝浜")]
        rows, usage = geocode_with_model(world.queries(spark, texts), index, cfg, Fake())
        notes.append(sorted({(r["machiaza"], r["note_code"]) for r in rows.collect()}))
        made.append((list(seen), usage["narrow_requests"] / n))
    assert made[0] == made[1] and made[0][1] > 1 and notes[0] == notes[1] and len(notes[0]) == 3


class Counting:
    """Says in each decision how many requests are under way in its worker."""

    def __init__(self):
        self.now = 0

    def choose(self, questions):
        self.now += 1
        time.sleep(0.05)
        seen, self.now = self.now, self.now - 1
        return [Decision(0, seen, seen, 1.0) for _ in questions], Usage(1, 1, 1)


@pytest.mark.parametrize("concurrency, tasks, most", [(6, 1, 6), (1, 4, 1), (5, 2, 3)])
def test_requests_in_flight(spark, concurrency, tasks, most):
    """As many as asked for, whatever the number of tasks; each query's answer is its own."""
    asked = spark.range(60).select(F.col("id").alias("qid"), F.lit(0).alias("part"), F.create_map(F.lit("input"), F.lit("x")).alias("subject"), F.array(F.lit("a"), F.lit("b")).alias("options"))
    answers = ask(asked, Counting(), Config(batch_size=2, concurrency=concurrency, request_tasks=tasks), "?")
    rows = answers.collect()
    assert sorted(r["qid"] for r in rows) == list(range(60)) and all(r["answered"] for r in rows)
    assert max(r["probability"] for r in rows) == most
    assert 30 <= sum(r["requests"] for r in rows) <= 30 + tasks


def test_requests_are_packed_as_they_stream():
    rows = [{"qid": q, "options": ["x"] * n} for q, n in ((1, 1), (1, 1), (1, 9), (2, 1), (3, 1), (3, 1))]
    tokens = lambda r: 10 * len(r["options"])
    sizes = lambda *a, **k: [len(g) for g in pack(iter(rows), tokens, *a, **k)]
    assert sizes(1000, 1, 99, request=0) == [3, 1, 2] and sizes(30, 9, 99, request=0) == [2, 1, 3]
    assert sizes(1, 9, 99) == [1] * 6 and sizes(1000, 9, 4) == [4, 2]


def test_batches_are_merged(spark):
    outcomes = [geocode_with_model(world.queries(spark, [q]), world.index(spark), Config(), Fake()) for q in (SAME, TYPO)]
    rows, usage = merged(*outcomes)
    assert rows.count() == 2 and usage["requests"] == sum(u["requests"] for _, u in outcomes) == 2 and usage["input_tokens"] == 200
    answers = spark.createDataFrame([(1.0,), (3.0,), (None,), (9.0,)], "millis double")
    assert tuple(latencies(answers).first()) == (3, 3.0, 9.0, 9.0)


def test_recall_and_precision(spark):
    candidates = spark.createDataFrame([(1, 5), (2, 6)], "qid long, row_id int")
    gold = spark.createDataFrame([(1, "typo", 5, "501018", "0000005"), (2, "typo", 7, "501018", "0000007")], "qid long, condition string, row_id int, lg_code string, machiaza_id string")
    results = spark.createDataFrame([(1, "501018", "0000005", True), (2, "501018", "0000006", True)], "qid long, lg_code string, machiaza_id string, resolved boolean")
    assert tuple(recall_and_precision(candidates, results, gold).first()) == ("typo", 2, 0.5, 0.5, 1.0)
    labels = spark.createDataFrame([(1, "0000005"), (2, "x")], "qid long, label string")
    assert tuple(accuracy(results, labels, "machiaza_id", "label").first()) == (2, 0.5)


def test_scratch_folders_can_be_cleared(spark, tmp_path):
    from tokoro import storage

    spark.conf.set(storage.SETTING, f"file://{tmp_path}")
    try:
        assert storage.stored(spark.range(3)).count() == 3
        own = tmp_path / "tokoro" / spark.sparkContext.applicationId
        assert len(list(own.iterdir())) == 1
        storage.clear(spark)
        assert not own.exists()
    finally:
        spark.conf.unset(storage.SETTING)
    assert str(tmp_path) not in storage.scratch(spark)
