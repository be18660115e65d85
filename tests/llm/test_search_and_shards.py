"""Operators 1, 4 and 9 against brute force."""

import itertools
import math
import random
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import EDGE, prose

from pyspark.sql import functions as F

from tokoro.llm import hilbert_shards, impact_search, minhash
from tokoro.llm.common import shared_dir

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def exact(rows, k):
    low, high = -(2**63), 2**63 - 1
    clip = lambda x: min(high, max(low, x))
    ok = [(i, [clip(math.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = Counter()
    for i, q in asked.items():
        found = sorted((-clip(sum(a * b for a, b in zip(q, v))), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += Counter((i, r, j, -s) for r, (s, j) in enumerate(found, 1))
    return out


@pytest.mark.parametrize("chunk, block", [(1 << 24, 4096), (60, 16)])
def test_top_k(spark, chunk, block):
    r = random.Random(1)
    rows = [(i, [r.randint(-40, 40) / 64 for _ in range(6)]) for i in range(0, 600, 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(15)]  # ties
    rows += [(901, None), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (None, [1.0] * 6), (903, [float("inf")] * 6), (800, [0.5, 0.25]), (700, [0.0] * 6), (1100, [])]
    rows += [(300, [0.5] * 6), (300, [-0.5] * 6), (301, [0.25] * 6), (301, [0.25] * 6)]  # repeated ids
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], VECTORS)
    assert Counter(map(tuple, impact_search.top_k(df, "vec_id % 100 = 0", 10, chunk, block).collect())) == exact(rows, 10)


def test_top_k_of_huge_components(spark):
    """Beyond 64 bits the nearest that 64 bits hold; just below, exact."""
    rows = [(100, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 1.0]), (200, [1e12, 3.0]), (3, [4096.0, -1e9]), (4, [0.0, 0.0]), (5, [2e6, 2e6])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], VECTORS.replace("array<float>", "array<double>"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        x = np.array([[1 << 62, -5, 0], [3, 1 << 61, 0]])
        impact_search.Block(np.arange(3), x).members(np.array([1 << 40, 0]), 9, 2, -np.inf)
    assert Counter(map(tuple, impact_search.top_k(df, "vec_id % 100 = 0").collect())) == exact(rows, 10)


def test_top_k_of_nothing(spark):
    assert impact_search.top_k(spark.createDataFrame([], VECTORS), "vec_id % 100 = 0").count() == 0


def test_curve_visits_neighbours():
    table, bits = hilbert_shards.curve_table(3), 3
    at = {}
    for p in itertools.product(range(1 << bits), repeat=3):
        state = h = 0
        for b in reversed(range(bits)):
            v = table[state * 8 + sum((p[i] >> b & 1) << i for i in range(3))]
            h, state = h * 8 + (v & 7), v >> 3
        at[h] = p
    assert len(at) == 8**bits
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def test_sql_index_is_the_table(spark):
    df = spark.range(512).selectExpr("cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y", "cast(id div 64 as int) z")
    rows = df.select("x", "y", "z", hilbert_shards.hilbert_index(["x", "y", "z"], 3).alias("h")).collect()
    by = {r["h"]: r[:3] for r in rows}
    assert sorted(by) == list(range(512)) and all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1])) == 1 for i in range(511))


def test_shards(spark, make, tmp_path):
    rows = EDGE + [(100 + i, prose(i, 5 + i % 9)) for i in range(90)]
    got = hilbert_shards.shard_documents(make(rows), 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    for k in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 7, len(rows) // 7 + 1)
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert hilbert_shards.shard_documents(make([]), 40).count() == 0
    docs = make(rows).withColumn("shard", F.lit("own"))
    written = hilbert_shards.write_shards(docs, str(tmp_path / "s"), 3)
    assert written.columns == [*docs.columns, "shard_"]
    assert Counter(map(tuple, written.drop("shard_").collect())) == Counter(map(tuple, docs.collect()))


def test_shards_can_be_skipped(spark):
    """Sources, languages and lengths keep their order, so that filters on each skip most
    shards by their minima and maxima; shards by hash of the id would skip none."""
    r, rows = random.Random(4), []
    for i in range(4000):
        source = "hot" if r.random() < 0.33 else f"s{r.randrange(60):02d}"
        rows.append((i, "w" * int(2 ** r.uniform(3, 12)), r.choice(["de", "en", "en", "en", "es", "fr", None]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    by = {i: row for i, *row in rows}
    spans: dict = {}
    for x in hilbert_shards.shard_documents(docs, 40).collect():
        text, lang, source = by[x["doc_id"]]
        spans.setdefault(x["shard"], []).append((len(text), lang or "", source))
    skipped = lambda k, wanted: sum(not any(min(o[k] for o in own) <= v <= max(o[k] for o in own) for v in wanted) for own in spans.values())
    assert skipped(1, ["fr"]) >= 20 and skipped(2, ["s07"]) >= 15 and skipped(0, [3000]) >= 8
    assert hilbert_shards.cuts(docs, "lang", shared_dir(spark)) == ["en", "es", "fr"]
    begins = hilbert_shards.cuts(docs, "source", shared_dir(spark))
    assert begins == sorted(begins) and 15 <= len(begins) < 32


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows():
    r, rows = random.Random(3), []
    for g in range(6):
        base = prose(g, 90).split()
        for k in range(12):  # chains: each copy differs from the last in a few words
            rows.append((100 * g + k, " ".join(base)))
            for _ in range(r.randint(0, 2)):
                base[r.randrange(90)] = f"new{g}{k}{r.randint(0, 99)}"
    return rows + [(9000 + i, t) for i, t in enumerate(["", None, "  ", "a b", "A B", "b a", "one two three four five", "ONE two three four FIVE", prose(99, 4000)])]


def test_near_duplicates(spark, make, monkeypatch):
    rows = near_rows()
    want = brute(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(make(rows)).collect()}
    assert got == want
    monkeypatch.setattr(minhash, "BLOCK", 3)  # many blocks a band
    monkeypatch.setattr(minhash, "MAP_MEMBERS", 0)  # texts joined instead of mapped
    assert {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(make(rows)).collect()} == want


def test_near_duplicates_edges(spark, make):
    assert minhash.near_duplicates(make([])).count() == 0
    rows = minhash.near_duplicates(make([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e F")])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in rows) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    kept = minhash.keep(make([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]))
    assert kept.columns == make([]).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_half_of_the_documents_are_empty_and_many_are_copies(spark, make):
    """Null digests, a large class of copies and a large component keep their results."""
    base = prose(1, 60)
    rows = [(i, None if i % 2 else "") for i in range(300)] + [(1000 + i, base) for i in range(150)] + [(2000 + i, base + f" end{i}") for i in range(100)]
    want = brute(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(make(rows)).collect()} == want


def test_documents_without_some_ids(spark, make, monkeypatch):
    """Broadcast ids, a bit map of them, and a join give the same rows."""
    rows = [(i % 90, f"t{i}") for i in range(200)] + [(None, "x"), (None, "x")]
    docs, dropped = make(rows), spark.createDataFrame([(i,) for i in range(0, 90, 3)] + [(999,)], "doc_id long")
    want = Counter((i, t) for i, t in rows if i is None or i % 3)
    for sent, members in ((1 << 20, 1 << 24), (0, 1 << 24), (0, 0)):
        monkeypatch.setattr(minhash, "SENT_IDS", sent)
        monkeypatch.setattr(minhash, "MAP_MEMBERS", members)
        got = minhash.without_ids(docs, dropped)
        assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_bands_and_estimates_of_pairs_at_the_threshold():
    """Pairs at or just above the threshold share a band; estimates stay within the margin."""
    rng = np.random.default_rng(7)
    for per_cent in (80, 85):
        bands = minhash.bands_for(per_cent)
        assert (1 - (per_cent / 100) ** minhash.ROWS) ** bands <= minhash.MISSED < (1 - (per_cent / 100) ** minhash.ROWS) ** (bands - 1)
        for n in (40, 200, 1500):
            for _ in range(25):
                both = -(-2 * n * per_cent // (100 + per_cent))  # shared, of sets of n each
                pool = np.unique(rng.integers(0, 1 << 63, 3 * n, "u8"))
                a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : 2 * n - both]])
                exact_ = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                assert minhash.linked(a, b, per_cent) == (100 * exact_ >= per_cent - 1e-9)
                assert set(minhash.band_keys(a, bands).tolist()) & set(minhash.band_keys(b, bands).tolist())
                x, y = minhash.planes([minhash.signature(a)]), minhash.planes([minhash.signature(b)])
                assert abs(minhash.estimate(x[0], y)[0] - exact_) < minhash.MARGIN


def test_a_hot_band_is_dealt_in_blocks(spark, monkeypatch):
    """A band of one large component and few others: no group holds more than two blocks,
    and copies grow with the others, not with the square of the band."""
    monkeypatch.setattr(minhash, "BLOCK", 10)
    rows = [(1, i, 500, 0 if i < 495 else i) for i in range(500)] + [(2, i, 4, 7) for i in range(4)]
    got = minhash.open_rows(spark.createDataFrame(rows, "key long, rep long, size long, comp long")).collect()
    assert {r["key"] for r in got} == {1} and len(got) == 500 + 5 * 50
    groups = Counter((r["key"], r["i"], r["j"], r["asks"]) for r in got)
    assert max(n for k, n in groups.items() if not k[3]) < 30 and max(n for k, n in groups.items() if k[3]) == 5
    asked = {(r["rep"], o["rep"]) for r in got if r["asks"] for o in got if not o["asks"] and (o["i"], o["j"]) == (r["i"], r["j"])}
    assert asked == {(a, b) for a in range(495, 500) for b in range(500)}
