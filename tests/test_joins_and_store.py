"""Look-ups beyond the broadcast bound, sorted keys, numerals, skew, atomic numbers, downloads."""

import random
import unicodedata
from dataclasses import replace

import pytest
import world
from pyspark.sql import functions as F

from tokoro.functions import text
from tokoro.operators import candidates, prefix_join
from tokoro.plans.geocode import geocode, with_town
from tokoro.sources.fetch import download_all
from tokoro.sources.store import Store
from tokoro.storage import stored


def test_bit_map_lets_all_keys_through_and_few_others(spark):
    keys = stored(spark.range(2000).select((F.col("id") % 7).cast("int").alias("place"), F.concat(F.lit("町"), F.col("id").cast("string")).alias("tail")))
    known = prefix_join.lookup(keys, "tail", 0, ["place", "tail"])
    assert known.known.bits == 32768
    assert known.possible(keys, ["place", "tail"]).count() == 2000
    others = keys.withColumn("place", F.col("place") + 7)
    assert known.possible(others, ["place", "tail"]).count() < 40
    assert prefix_join.lookup(keys.limit(0), "tail", -1).possible(keys, ["tail"]).count() == 0


def test_prefixes_dealt_out_are_hardly_more_than_hits(spark):
    index = replace(world.index(spark), broadcast_bytes=0)
    texts = spark.createDataFrame([(i, q) for i, q in enumerate(["架空県汐見市若葉三丁目4番", "風待町貝浜免12", "星見区虹が谷5丁目", "雲井市東区小文字町の先", "汐見市無い町1", "x", ""] * 20)], "qid long, norm string")
    seen = []
    possible = prefix_join.Lookup.possible

    def counted(self, rows, columns):
        out = possible(self, rows, columns)
        seen.append((rows.count(), out.count()))
        return out

    prefix_join.Lookup.possible = counted
    try:
        hits = candidates.town_hits(texts, index)
        n = hits.count()
    finally:
        prefix_join.Lookup.possible = possible
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, candidates.town_hits(texts, world.index(spark)).collect()))
    before, after = seen[-1]
    assert n > 50 and after <= 1.1 * n < before


def test_sorted_keys(spark, monkeypatch):
    """Stems of any length, before, between and after all keys, with ties over blocks."""
    monkeypatch.setattr(prefix_join, "BLOCK", 3)
    r = random.Random(2)
    keys = [("".join(r.choice("あ市町x") for _ in range(r.randint(1, 4))), i) for i in range(150)] + [("同", i) for i in range(200, 230)]
    stems = sorted({k[:n] for k, _ in keys for n in (1, 2, 3)}) + ["", "無", "\U0010fffe", "!", "同同", "x" * 9]
    made = prefix_join.sorted_keys(spark.createDataFrame(keys, "key string, row_id int"))
    assert made.n >= 60
    found = prefix_join.extension_join(spark.createDataFrame([(s, i) for i, s in enumerate(stems)], "stem string, at int"), made)
    assert found.columns == ["stem", "at", "key", "row_id"]
    assert sorted((x["stem"], x["key"], x["row_id"]) for x in found.collect()) == sorted((s, k, i) for s in stems if s for k, i in keys if k.startswith(s))
    assert prefix_join.extension_join(spark.createDataFrame([("a",)], "stem string"), prefix_join.sorted_keys(spark.createDataFrame([], "key string, row_id int"))).count() == 0


def value(run):
    total = digit = 0
    for c in run:
        if c in text.UNITS:
            total, digit = total + (digit or 1) * text.UNITS[c], 0
        elif c in text.DIGITS:
            digit = text.DIGITS.index(c)
    return total + digit


def test_numerals_fold_like_a_plain_reading(spark):
    r, rows = random.Random(4), ["", "〇", "零", "二千二十四年", "三十三間堂", "千", "百十", "一二三丁目", "十二丁目三", "町", None, "ｱ百", "㈱二丁目", "が三"]
    rows += ["".join(r.choice(text.NUMERALS + "丁目町A１") for _ in range(r.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, t string")
    make = lambda df, norm: df.select("id", text.fold_numbers(F.col("t"), norm).alias("a"), text.comparable(F.col("t"), norm).alias("b"))
    got = {x["id"]: (x["a"], x["b"]) for x in text.by_stability(df, F.col("t"), make).collect()}
    import re

    run = f"[{text.NUMERALS}]+"
    for i, t in enumerate(rows):
        if t is None:
            assert got[i] == (None, None)
            continue
        n = "".join(unicodedata.normalize("NFKC", t).split())
        assert got[i][0] == re.sub(run, lambda m: str(value(m[0])), n)
        assert got[i][1] == re.sub("大字|字", "", re.sub(f"({run})(?=丁)", lambda m: str(value(m[0])), n))
    stable = text.by_stability(df.where("t not rlike '[ｱ㈱゙]'"), F.col("t"), make)
    assert "ArrowEvalPython" not in stable._jdf.queryExecution().toString() and stable.count() > 200


def test_texts_without_a_town_are_dealt_out(spark):
    """Half of the texts have no town and the towns aren't broadcast: partitions stay even."""
    index = world.index(spark)
    state = spark.range(4000).select(F.col("id").alias("qid"), F.lit("x1").alias("norm"), F.when(F.col("id") % 2 == 0, (F.col("id") % 11).cast("int")).alias("town_row"), F.lit(1).alias("town_n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("8", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        out = with_town(state, index)
        parts = {r["p"]: r["n"] for r in out.where("t_row_id is null").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(parts.values()) == 2000 and len(parts) == 8 and max(parts.values()) < 350
    assert out.where("t_row_id is not null").count() == 2000


def numbers(spark, rows):
    return spark.createDataFrame([(a, b, c, d, 0, 0, 1.0, 2.0) for a, b, c, d in rows], "lg_code int, machiaza_id int, kind int, num1 int, num2 int, num3 int, lat double, lon double")


def test_numbers_are_switched_at_once(spark, tmp_path, monkeypatch):
    """A job that fails while it writes, or is lost before the switch, leaves the old state;
    a reader of the last state can finish."""
    store = Store(spark, f"file://{tmp_path}/own")
    held = lambda s=store: sorted((r["lg_code"], r["machiaza_id"], r["num1"]) for r in s.read("banchi").collect())
    assert held() == []
    store.put_numbers(numbers(spark, [(1, 1, 3, 5), (1, 2, 3, 6), (2, 1, 3, 7)]))
    first = [(1, 1, 5), (1, 2, 6), (2, 1, 7)]
    assert held() == first
    reader = store.read("banchi")
    with pytest.raises(Exception, match="no such"):
        store.put_numbers(numbers(spark, [(1, 1, 3, 8), (3, 1, 3, 9)]).withColumn("lat", F.expr("if(lg_code = 3, cast(raise_error('no such') as double), 0)")))
    assert held() == first
    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.put_numbers(numbers(spark, [(1, 1, 3, 8), (3, 1, 3, 9)]))
    assert held() == held(Store(spark, store.root)) == first
    store.put_numbers(numbers(spark, [(1, 1, 3, 8), (3, 1, 3, 9)]))
    assert held() == [(1, 1, 8), (1, 2, 6), (2, 1, 7), (3, 1, 9)]
    assert reader.count() == 3  # read the state before
    store.put_numbers(numbers(spark, []))
    assert len(held()) == 4
    store.put_numbers(numbers(spark, [(2, 1, 3, 1)]))
    top = tmp_path / "own" / "banchi"
    used = set(store.versions(store._named("banchi")).values())
    assert len(used) == 2 and len([p for p in top.iterdir() if p.name.startswith("version=")]) == 3 and len([p for p in top.iterdir() if p.name.startswith("m-")]) == 2


def test_a_number_is_found_in_few_row_groups(spark, tmp_path, monkeypatch):
    """Files are sorted and have small row groups, whose minima and maxima rule most out."""
    import pyarrow.parquet as pq

    from tokoro.sources import store as module

    monkeypatch.setattr(module, "SPLITS", 1)
    monkeypatch.setattr(module, "GROUP_BYTES", 1 << 14)
    store = Store(spark, str(tmp_path))
    rows = spark.range(60_000).select(F.lit(1).alias("lg_code"), (F.col("id") % 40).cast("int").alias("machiaza_id"), F.lit(3).alias("kind"), F.floor(F.col("id") / 40).cast("int").alias("num1"), F.lit(0).alias("num2"), F.lit(0).alias("num3"), F.rand(1).alias("lat"), F.rand(2).alias("lon"))
    store.put_numbers(rows)
    assert [r["num1"] for r in store.lookup(1, 7, 3, 123).collect()] == [123]
    (folder,) = {p.parent for p in tmp_path.rglob("lg_code=1/*.parquet")}
    kept = every = 0
    for path in folder.glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            span = lambda c: meta.row_group(g).column(at[c]).statistics  # noqa: B023, E731
            every += 1
            kept += span("machiaza_id").min <= 7 <= span("machiaza_id").max and span("num1").min <= 123 <= span("num1").max
    assert every >= 20 and kept <= 2


class Answer:
    def __init__(self, body):
        import io

        self.stream, self.headers = io.BytesIO(body), {"Last-Modified": "m1"}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self, n):
        return self.stream.read(n)


def test_downloads_into_a_folder_given_as_a_uri(tmp_path):
    import urllib.error

    def opener(url, headers, timeout):
        if headers.get("If-Modified-Since") == "m1":
            raise urllib.error.HTTPError(url, 304, "same", {}, None)
        return Answer(b"x" * 3_000_000)

    for folder in (f"file://{tmp_path}/a", f"file:{tmp_path}/b", str(tmp_path / "c")):
        (one,) = download_all(["http://h/f.zip"], folder, 1, opener)
        assert (one.cached, one.last_modified, one.path) == (False, "m1", f"{folder}/f.zip")
        assert (tmp_path / folder[-1] / "f.zip").stat().st_size == 3_000_000
        assert download_all(["http://h/f.zip"], folder, 1, opener)[0].cached


def test_geocoding_without_broadcasts_is_the_same(spark):
    queries = world.queries(spark, ["架空県汐見市若葉三丁目4番6号", "汐見市苦葉", "風待町貝浜免12番地3", "架空県", "無い"])
    rows = [sorted(geocode(queries, i).select("qid", "address", "granularity", "note_code").collect()) for i in (world.index(spark), replace(world.index(spark), broadcast_bytes=0))]
    assert rows[0] == rows[1]


def crowd(spark, n=40):
    """The small world with n more towns of one name; rows from 100 on."""
    index = world.index(spark)
    more = spark.createDataFrame([(100 + i, 70000 + i) for i in range(n)], "row_id int, machiaza_id int")
    more = index.towns.where("row_id = 6").drop("row_id", "machiaza_id").crossJoin(more).select(index.towns.columns)
    towns = stored(index.towns.unionByName(more))
    keys = stored(index.keys.unionByName(index.keys.where("row_id = 6").drop("row_id").crossJoin(more.select("row_id"))))
    return replace(index, towns=towns, heads=stored(index.heads), keys=keys)


def test_towns_of_one_name_are_met_once(spark):
    """A text meets towns that are alike as one group, as many as there are; ends, lists and
    extensions are those of a plain reading."""
    index, towns = crowd(spark), [6, 7, *range(100, 140)]
    texts = spark.createDataFrame([(i, q) for i, q in enumerate(["試作府雲井市東区小文字町9", "雲井市東区小文字町9", "架空県汐見市若葉三丁目4", "雲井市東区小文", "架空県汐見市若葉77"])], "qid long, norm string")
    hits = candidates.alike_hits(texts, index)
    assert sorted((r["qid"], r["alike"]) for r in hits.collect()) == [(0, 6), (1, 6), (2, 0), (2, 1), (4, 0)]
    state = {r["qid"]: (r["n"], r["first_row"], r["last_row"]) for r in candidates.forward(texts, index).collect()}
    assert state == {0: (12, 6, 139), 1: (9, 6, 139), 2: (11, 1, 1), 3: (None, None, None), 4: (8, 0, 0)}
    for cap in (None, 1, 3, 41, 99):
        got = {}
        for r in candidates.forward_candidates(texts, index, cap).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["row_id"], r["n"]))
        assert got[0] == [(k + 1, t, 12) for k, t in enumerate(towns[:cap])] and [t for _, t, _ in got[1]] == towns[:cap]
        assert got[2] == [(1, 1, 11), (2, 0, 8)][:cap] and 3 not in got
    for cap in (1, 3, 99):
        assert [r["row_id"] for r in candidates.extensions(texts.where("qid = 3"), index, cap).orderBy("rank").collect()] == towns[:cap]


def test_a_perturbed_town_is_found_among_many_of_its_name(spark):
    """Recall counts all candidates, not the first that a question has room for, and no list
    of candidates is made for it."""
    from tokoro.config import Config
    from tokoro.plans.evaluate import evaluate_perturbations

    got = {r["condition"]: r for r in evaluate_perturbations(crowd(spark), Config(max_options=3), ("as_is", "drop_pref")).collect()}
    assert (got["as_is"]["n"], got["as_is"]["recall"], got["drop_pref"]["recall"]) == (51, 1.0, 1.0)


def test_all_candidates_are_listed_and_grouped(spark):
    """More towns than a question has room for: every one has its rank, and groups count all."""
    from tokoro.functions.names import display

    index, n = crowd(spark, 300), 302
    texts = spark.createDataFrame([(i, f"試作府雲井市東区小文字町{i}") for i in range(3)] + [(9, "架空県汐見市若葉三丁目4")], "qid long, norm string")
    ranks = [(r["rank"], r["row_id"]) for r in candidates.forward_candidates(texts, index).where("qid = 1").orderBy("rank").collect()]
    assert ranks == [(k + 1, t) for k, t in enumerate([6, 7, *range(100, 400)])] and len(ranks) == n
    shown = candidates.forward_displays(texts, index, display("pref", "county", "city", "ward", "oaza_cho", "chome", "koaza"))
    assert shown.columns == ["qid", "option", "display", "row_id", "size"]
    got = sorted(map(tuple, shown.collect()))
    assert got == [(i, 0, "試作府雲井市東区小文字町", 6, n) for i in range(3)] + [(9, 0, "架空県汐見市若葉三丁目", 1, 1), (9, 1, "架空県汐見市若葉", 0, 1)]


def test_pairs_are_made_once_without_comparing_them(spark):
    """Two heads of a place, one the beginning of the other, meet one key twice; where there
    are none such, pairs aren't dealt out to find them."""
    towns = spark.createDataFrame([(0, 1, 1, 0, "", "", "甲市", "", "町", "", "", "")], "row_id int, lg_code int, machiaza_id int, rsdt_addr_flg int, pref string, county string, city string, ward string, oaza_cho string, chome string, chome_number string, koaza string")
    heads = stored(spark.createDataFrame([("甲市", 1), ("甲市町", 1), ("乙市", 2)], "head string, place int"))
    keys = stored(spark.createDataFrame([(1, "町町", 0), (1, "町", 0), (2, "町", 5)], "place int, tail string, row_id int"))
    index = replace(world.index(spark), towns=towns, heads=heads, keys=keys)
    texts = stored(spark.createDataFrame([(1, "甲市町町1"), (2, "乙市町1"), (3, "丙")], "qid long, norm string"))
    assert candidates.town_hits(texts, index).count() == 4
    assert sorted(map(tuple, candidates.town_pairs(texts, index).collect())) == [(1, 0, 3), (1, 0, 4), (2, 5, 3)]
    plain = replace(index, heads=stored(heads.where("head <> '甲市町'")))
    pairs = candidates.town_pairs(texts, plain)
    assert sorted(map(tuple, pairs.collect())) == [(1, 0, 3), (1, 0, 4), (2, 5, 3)]
    assert "Exchange hash" not in pairs._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_reports_read_written_results(spark):
    """The plans of reports hold their results' plan not once for each aggregation."""
    from tokoro.plans.evaluate import distance_report, stop_reasons

    rows = spark.range(100).select(F.col("id").alias("qid"), F.concat(F.lit("q"), "id").alias("query"), F.when(F.col("id") % 3 == 0, "A").otherwise("").alias("note_code"), (F.col("id") * 20.0).alias("m"))
    reasons, report = stop_reasons(rows), distance_report(rows, "m", 1000)
    assert [(r["note_code"], r["queries"], r["samples"]) for r in reasons.collect()] == [("A", 34, ["q0", "q3", "q6"])]
    assert tuple(report.first()) == (100, 1000.0, 1800.0, 49)
    for df in (reasons, report):
        assert "Range (" not in df._jdf.queryExecution().optimizedPlan().toString()
