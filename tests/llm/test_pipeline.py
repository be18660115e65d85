"""corpus_pipeline.py against its stages told plainly, and on edge cases."""

import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
from conftest import EDGE, prose
from test_search_and_shards import shingle_set
from tokenizers import Tokenizer

from tokoro.llm import packing, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    r, rows, labels = random.Random(12), [], []
    for i in range(2000, 2300):
        words, bad, toxic = prose(i, r.randint(30, 90)).split(), i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilewort", "grubface", "snarlgut"])
        rows.append((i, " ".join(w + "###" if bad else w for w in words)))
        labels.append((i, int(not bad), int(toxic)))
    for i in range(2001, 2081, 4):  # near copies, exact copies
        words = dict(rows)[i].split()
        words[-1] = "other"
        rows += [(i + 1000, " ".join(words)), (i + 2000, dict(rows)[i].upper())]
    return rows + EDGE, labels


def plain_near_dedup(rows, per_cent):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def save(spark, make, folder, rows, labels):
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run(spark, make, tmp_path):
    rows, labels = corpus()
    folder = save(spark, make, tmp_path, rows, labels)
    got = corpus_pipeline.run(spark, folder).collect()

    table = spark.createDataFrame(labels, LABELS)
    scores = lambda module, kept: {(r["doc_id"], k): r["score"] for k, r in enumerate(sorted(module.score_documents(make(kept), table).collect(), key=lambda r: (str(r["doc_id"]), r["score"])))}

    def judged(module, kept, keeps):
        by: dict = {}
        for (i, _), s in scores(module, kept).items():
            by.setdefault(i, set()).add(keeps(s))
        assert all(len(v) == 1 for v in by.values())  # rows that share an id here share a text
        return [(i, t) for i, t in kept if by[i] == {True}]

    kept = judged(quality, rows, lambda s: s >= 0.3)
    kept = judged(toxicity, kept, lambda s: s < 0.5)
    kept = plain_near_dedup(kept, 80)
    lib, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for i, t in kept:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k, a, n, zlib.crc32(struct.pack(f"<{n}I", *ids[a : a + n]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    clean = {i for i, _ in rows if i and 2000 <= i < 2300 and i % 5 and i % 4}
    assert len(clean & {r["doc_id"] for r in got}) > 0.95 * len(clean)
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


@pytest.mark.parametrize("rows, labels", [([], []), (EDGE, []), ([], [(1, 1, 0), (2, 0, 1)]), ([(i, None) for i in range(5)], [(1, 1, 0), (2, 1, 0), (3, 1, 0)])])
def test_edges(spark, make, tmp_path, rows, labels):
    out = corpus_pipeline.run(spark, save(spark, make, tmp_path, rows, labels))
    assert {r["doc_id"] for r in out.collect()} <= {i for i, _ in rows}
    if not labels and rows:  # nothing to learn from: nothing is rejected but copies
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in plain_near_dedup(rows, 80)}


def test_every_stage_returns_the_documents_columns(spark, make):
    rows, labels = corpus()
    docs = make(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "minhash_near_dedup", "best_fit_packing"]
    table = spark.createDataFrame(labels, LABELS)
    assert quality.keep(docs, table).columns == toxicity.keep(docs, table).columns == docs.columns
