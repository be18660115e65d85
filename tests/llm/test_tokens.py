"""Operators 2, 3, 8 and 10 against the tokenizer libraries and brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import EDGE
from tokenizers import Tokenizer

from tokoro.llm import binary_records, byte_bpe, packing, subwords, token_counts
from tokoro.llm.common import WorkerCache, shared_dir

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_token_counts(spark, make, word):
    rows = token_counts.count_tokens(make(EDGE), WORD, 2048, size=3).collect()
    want = Counter((i, len((t or "").encode()), n := len(word.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in EDGE)
    assert Counter(map(tuple, rows)) == want
    assert token_counts.count_tokens(make([]), WORD).count() == 0


def test_binary_records(spark, make, word):
    own = [r for r in EDGE if r[0] != 5] + [(5, "Hello  world")]
    at = shared_dir(spark)
    rows = {r["doc_id"]: r for r in binary_records.tokenise_to_files(make(own), WORD, 2, at).collect()}
    start = 0
    for i, t in sorted(own, key=lambda x: -1 if x[0] is None else x[0]):
        ids = [*word.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[i]) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert binary_records.tokenise_to_files(make([]), WORD).count() == 0


def test_offset_index_and_damage(spark, make, word, tmp_path):
    at = shared_dir(spark)
    manifest = binary_records.write_records(make([(i, f"text {i}") for i in range(9)]), WORD, 2, at).collect()
    row = manifest[0]
    doc, ids = binary_records.read_one(at, row["path"], row["records"] - 1)
    assert ids.tolist() == [*word.encode(f"text {doc}", add_special_tokens=False).ids, 2]
    assert {(r["doc_id"], tuple(r["ids"])) for r in binary_records.read_shuffled(spark.createDataFrame(manifest), at, 7).collect()} == {(i, (*word.encode(f"text {i}", add_special_tokens=False).ids, 2)) for i in range(9)}
    one, two = ([r["doc_id"] for r in binary_records.read_shuffled(spark.createDataFrame(manifest), at, k).collect()] for k in (1, 2))
    assert sorted(one) == sorted(two) == list(range(9)) and one != two
    data = bytearray(open(row["path"], "rb").read())
    data[15] ^= 1
    import io

    with pytest.raises(ValueError):
        list(binary_records.unframe(io.BytesIO(bytes(data))))


def test_wide_ids_and_a_hot_id(spark, make):
    at, rows = shared_dir(spark), [(7, f"text {i}") for i in range(40)]
    manifest = binary_records.write_records(make(rows), WORD, 70_000, at)
    assert binary_records.parse(binary_records.payload(1, np.array([70_000], "<u4"), 4))[1].tolist() == [70_000]
    got = binary_records.read_records(manifest, at)
    assert got.rdd.getNumPartitions() == manifest.count() > 1  # files are read by many tasks
    read = [binary_records.read_one(at, r["path"], 0)[1].tolist() for r in manifest.collect()]
    assert all(ids[-1] == 70_000 for ids in read) and got.count() == 40
    with pytest.raises(ValueError):
        binary_records.id_width(-1)


def test_other_patterns():
    """Any pattern, groups and unmatched text included, as the library takes it."""
    ranks, r = byte_bpe.load_ranks(RANKS), random.Random(2)
    for pattern in (r"\w+|\W", r"(\p{L}+|\p{N})|\s", "[^a]+"):
        lib, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_bpe.BacktrackBPE(ranks, pattern)
        for _ in range(200):
            t = " ".join(r.choice(["the", "Anna's", "12,5", "naïve", "don't", "", "x_y"]) for _ in range(9))
            assert own.ids(t.encode()) == struct.pack(f"<{len(x := lib.encode_ordinary(t))}I", *x)


def test_caches_are_bounded_by_bytes():
    made = []
    cache = WorkerCache(lambda k: made.append(k) or k, 1000, 2000)
    for i in range(500):
        assert cache[b"k%03d" % i * 50] == b"k%03d" % i * 50
    assert cache.held <= 2400 and sum(map(len, cache.old)) <= 2400
    long = b"x" * 5000
    assert cache[long] == long and long not in cache


def test_byte_bpe(spark, make):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = []
    for i, t in EDGE:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, byte_bpe.encode_decode(make(EDGE), RANKS, P.PATTERN).collect())) == Counter(want)
    assert byte_bpe.encode_decode(make([]), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_random():
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    own, r = byte_bpe.coder(RANKS, P.PATTERN), random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "é", "'s", "1", "²", "漢", "😀", "the", "ing", "====", " ", "\x00"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert own.ids(t.encode()) == struct.pack(f"<{len(x := lib.encode_ordinary(t))}I", *x)


def test_packing(spark, make):
    lib = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(make(EDGE), BYTE, 0, 64).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for i, t in EDGE:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, a, n, crc(ids[a : a + n])] += 1
    assert got == want
    assert len(bins) == -(-sum(r["length"] for r in rows) // 64)
    assert packing.pack_documents(make([]), BYTE).count() == 0


def test_plain_texts_take_one_look_up_a_pre_token(monkeypatch):
    """Whatever marks and line ends stand around a word, it is cut once and tokenized once."""
    coder, lib, r = subwords.ByteBPE(BYTE), Tokenizer.from_file(BYTE), random.Random(8)
    made, tokenize = [], coder.tokenize
    coder.tokenize = lambda w: made.append(w) or tokenize(w)
    parts = ["a", "Bé", " ", "  ", "\n", "\t ", "'s", "'", "12", "the", "ing", ".", "|", "==", "ß", "\x0b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["", " ", "the|>the", "x" * 3000 + " y"]
    for long in (1 << 20, 5):
        monkeypatch.setattr(subwords, "LONG_TEXT", long)
        for t in texts:
            assert coder.ids(t.encode()) == struct.pack(f"<{len(x := lib.encode(t, add_special_tokens=False).ids)}I", *x)
    assert not coder.chunks and not coder.first
    assert len([w for w in made if len(w) < 1000]) == len({w for w in made if len(w) < 1000})
    for t in ("a<|endoftext|>b the", "the \u2019s 漢字 the", "a\x00b  c\u00a0d"):  # not plain: as before
        assert coder.ids(t.encode()) == struct.pack(f"<{len(x := lib.encode(t, add_special_tokens=False).ids)}I", *x)


def test_plain_texts_share_one_cache_of_pieces(monkeypatch, word):
    """Case and marks don't have a word tokenized again, and the ids are the library's."""
    coder, r = subwords.WordBPE(WORD), random.Random(5)
    made, tokenize = [], coder.tokenize
    coder.tokenize = lambda w: made.append(w) or tokenize(w)
    parts = ["a", "BÉ", "bé", " ", "  ", "\n", "\t ", "'s", "'S", "'", "12", "The", "ing", ".", "|", "==", "ß", "\x0b", "÷"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["", " ", "the|>The, THE", "x" * 3000 + " y"]
    for long in (1 << 20, 5):
        monkeypatch.setattr(subwords, "LONG_TEXT", long)
        for t in (x for x in texts if "÷" not in x):
            assert coder.ids(t.encode()) == struct.pack(f"<{len(x := word.encode(t, add_special_tokens=False).ids)}I", *x)
    assert not coder.chunks
    assert len([w for w in made if len(w) < 1000]) == len({w for w in made if len(w) < 1000})
    for t in [x for x in texts if "÷" in x] + ["a<|endoftext|>B the", "The \u2019s 漢字 the", "a\x00b  E\u0301\u00a0d"]:  # not plain
        assert coder.ids(t.encode()) == struct.pack(f"<{len(x := word.encode(t, add_special_tokens=False).ids)}I", *x)


def test_a_payload_holds_its_ids_as_they_are():
    ids = np.array([5, 65_535, 0, 2], "<u4")
    for width in (2, 4):
        data = binary_records.payload(9, ids, width)
        assert data[14:] == ids.astype(f"<u{width}").tobytes()
        assert (got := binary_records.parse(data))[0] == 9 and got[1].tolist() == ids.tolist()
        for damaged in (data[:-width], data + b"\0"):
            with pytest.raises(ValueError):
                binary_records.parse(damaged)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(2)
    for _ in range(150):
        items = [r.randint(1, 20) for _ in range(r.randint(0, 8))]
        plan = packing.complete(Counter(items), 20)
        assert sum(n for n, _ in plan) == fewest(items, 20)
        assert Counter({s: 0 for s in items}) + sum((Counter({s: c * n}) for n, own in plan for s, c in own), Counter()) == Counter(items)


def test_bin_completion_of_many_pieces():
    """Perfect packings of 5 to 8 pieces a sequence, by cutting sequences at random places."""
    r, worse = random.Random(6), 0
    for case in range(20):
        items, n = [], 3 + case % 3
        for _ in range(n):
            ends = sorted(r.sample(range(10, 200), r.randint(4, 7)))
            items += [b - a for a, b in zip([0, *ends], [*ends, 200], strict=True)]
        counts = Counter({s: 3 * c for s, c in Counter(items).items()})
        worse += sum(k for k, _ in packing.best_fit(counts, 200)) > 3 * n
        plan = packing.complete(counts, 200)
        assert sum(k for k, _ in plan) == 3 * n
        assert all(sum(s * c for s, c in own) <= 200 for _, own in plan)
        assert Counter(s for k, own in plan for s, c in own for _ in range(c * k)) == counts
    assert worse > 3


def test_a_search_without_bound_ends_at_the_optimum():
    """Where four nodes don't find the fewest, no bound on nodes does, and it is proven."""
    r, better = random.Random(12), 0
    for _ in range(60):
        items = [r.randint(3, 14) for _ in range(9)]
        best = sum(n for n, _ in packing.complete(Counter(items), 20, math.inf))
        assert best == fewest(items, 20)
        better += sum(n for n, _ in packing.best_fit(Counter(items), 20)) > best
    assert better


def test_dropped_levels_are_taken_up_again(monkeypatch):
    """The search is the same whether it keeps all its levels or makes them anew."""
    r = random.Random(21)
    for case in range(30):
        counts = Counter(r.randint(5, 60) for _ in range(r.randint(6, 30)))
        counts = {s: c * r.randint(1, 4) for s, c in counts.items()}
        plans = []
        for alive in (1000, 1):
            monkeypatch.setattr(packing, "ALIVE", alive)
            plans.append(packing.complete(counts, 100, 300))
        assert plans[0] == plans[1]


def test_fillings_are_all_undominated_ones():
    """Against every multiset of pieces, dominance by its definition for one exchange."""
    from itertools import product

    r = random.Random(9)
    for _ in range(60):
        have = Counter(r.randint(2, 9) for _ in range(r.randint(1, 9)))
        room, sizes = r.randint(5, 30), sorted(have)
        want = set()
        for many in product(*(range(have[s] + 1) for s in sizes)):
            own = Counter(dict(zip(sizes, many, strict=True)))
            waste = room - sum(s * c for s, c in own.items())
            spare = [s for s in sizes if have[s] > own[s]]
            parts = product(*(range(c + 1) for c in many))
            if waste >= 0 and not any((t := sum(a * b for a, b in zip(sizes, part, strict=True))) <= s <= t + waste and (s > t or sum(part) > 1) for part in parts for s in spare):
                want.add(tuple((s, c) for s, c in sorted(own.items(), reverse=True) if c))
        got = [f for f in packing.fillings(room, have, lambda: room) if f is not None]
        assert len(got) == len(set(got)) and set(got) == want
        wastes = [room - sum(s * c for s, c in f) for f in got]
        assert wastes == sorted(wastes)
