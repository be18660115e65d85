"""Near-duplicate groups by b-bit MinHash, each link confirmed on the full shingle sets.

1. One scan makes each document's set of 5-word shingles (64-bit hashes), the set's own
   hash, and bands of ``ROWS`` minima, hashed band by band. Documents of equal sets form a
   class, and only a class's smallest doc_id goes on.
2. Classes that share a band with another are members; a second scan gives each its sorted
   set and a b-bit signature: the low ``BITS`` bits of ``LANES`` minima, packed as bit
   planes. The share of equal lanes, less what chance makes equal, estimates similarity.
3. Each member is compared with the smallest of each of its bands (one pair a member and
   band), and confirmed links are contracted to components.
4. In a band whose members are still in several components, those outside its largest
   component are estimated against all members of other components, and pairs estimated
   within ``MARGIN`` of the threshold are confirmed. So a large group with few stragglers
   costs its size times the stragglers'. Either side is cut into blocks, and every pair of
   blocks is a group of its own, so that no task needs a whole band. Pairs inside a
   component can't change the result and are skipped.

Large classes of copies, hot bands, hubs of stars and large components are keys of joins
that deal such keys to many tasks (``common.spread_join``); documents without a set meet no
class. A pair is confirmed where it is dealt to: its first member's set goes once to each part of
the pairs, the second members' sets stream past it, in parts of bounded size, so that a
member of a million pairs is neither repeated a million times nor met in one task.

There are as many bands as leave a pair at the threshold without a shared one once in a
million pairs (24 for 0.85, 35 for 0.8), and the margin is over five standard deviations of
the estimate. Components come from alternating star contraction over written tables; no
links or components reach the driver.

Defined results: null, empty or blank text has an empty set and links with nothing; fewer
than five words make one shingle, the whole sequence; a very long text has all its
shingles; rows that share a doc_id are one document; a row without doc_id links with
nothing and is kept; an empty table gives no rows; other columns are ignored (``keep``
returns them).
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import held_alone, id_and_text, let_go, map_arrow, shared_dir, spread_join, written

WORDS, ROWS, LANES, BITS, SEED = 5, 5, 2048, 4, 20240229
PER_CENT, MARGIN, BLOCK, MISSED = 85, 0.045, 256, 1e-6
#: Members of a band that are compared with its smallest in one place.
STAR = 128
#: Bits of the map of member ids that the second scan is given (16 MB), and the members up
#: to which it is used; beyond them texts are joined with ids instead.
MAP_BITS, MAP_MEMBERS = 1 << 27, 1 << 24
#: Ids to drop up to which they are broadcast as they are (16 bytes each).
SENT_IDS = 1 << 20
SET = "doc_id long, n_shingles long, digest binary, bands array<long>"
MEMBER = "rep long, n long, sig binary, shingles binary"


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; ASCII lower case, words
    parted by ASCII white space."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words) + 1)], "u8") if words else np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = len(h) - k + 1
    total = np.zeros(n, "u8")
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mix(total))


@functools.lru_cache(maxsize=4)
def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, (n, 1), "u4"), rng.integers(0, 2**31, (n, 1), "u4") * 2 + np.uint32(1)


def minima(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The smallest value of each of n hash functions over a set."""
    flip, factor = _family(n, seed)
    low = (hashes >> np.uint64(32)).astype("u4")
    out = np.full(n, 2**32 - 1, "u4")
    step = max(1, (1 << 16) // n)
    for at in range(0, len(low), step):
        values = np.bitwise_xor(low[None, at : at + step], flip)
        values *= factor
        np.minimum(out, values.min(axis=1), out=out)
    return out


def bands_for(per_cent: int) -> int:
    """Bands at which a pair at the threshold shares none in ``MISSED`` of all cases."""
    return 1 if per_cent >= 100 else math.ceil(math.log(MISSED) / math.log1p(-((per_cent / 100) ** ROWS)))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    rows = minima(hashes, bands * ROWS, SEED).reshape(bands, ROWS).astype("u8")
    key = np.arange(1, bands + 1, dtype="u8")
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view("i8")


def signature(hashes: np.ndarray) -> bytes:
    """Bit planes of the low bits of the minima."""
    low = minima(hashes, LANES, SEED + 1)
    return b"".join(np.packbits((low >> np.uint32(b) & np.uint32(1)).astype("u1")).tobytes() for b in range(BITS))


def planes(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "u8").reshape(len(sigs), BITS, LANES // 64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities of a signature with others, corrected for lanes equal by chance."""
    differ = one[0] ^ many[:, 0]
    for b in range(1, BITS):
        differ |= one[b] ^ many[:, b]
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / LANES
    chance = 1 / 2**BITS
    return (equal - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets' similarity reaches the threshold, by counting."""
    if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= per_cent * (len(a) + len(b) - shared)


def shingle_sets(docs: DataFrame, bands: int) -> DataFrame:
    def run(batches):
        let_go()
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingles(text)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(band_keys(own, bands) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return map_arrow(id_and_text(docs), run, SET)


def id_map(reps: DataFrame) -> np.ndarray | None:
    """A bit map of hashed ids; None if there are too many for it to tell much."""
    if reps.count() > MAP_MEMBERS:
        return None
    at = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS))
    words = reps.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {MAP_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(MAP_BITS // 64, "i8")
    for r in words.toLocalIterator():  # at most MAP_BITS / 64 words
        out[r["word"]] = r["bits"]
    return out


def member_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The sets and signatures of some documents. With the bit map, texts aren't shuffled;
    the few other documents it lets through are never asked for."""

    def run(batches):
        for batch in batches:
            n, sigs, sets = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingles(text)
                n.append(len(own))
                sigs.append(signature(own))
                sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["rep", "n", "sig", "shingles"])

    texts, known = id_and_text(docs), id_map(reps)
    if known is None:
        return map_arrow(texts.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), run, MEMBER)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(known.tobytes(), 1))
    name = uuid.uuid4().hex
    hashed = texts.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("at"))

    def chosen(batches):
        bits = _worker_map(name, shared)
        for batch in batches:
            at = batch.column(2).to_numpy()
            kept = batch.filter(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)))
            if kept.num_rows:
                yield kept

    return map_arrow(hashed, lambda batches: run(chosen(batches)), MEMBER)


def _worker_map(name: str, shared) -> np.ndarray:
    """The worker's copy of a broadcast bit map."""
    return held_alone(name, lambda: np.frombuffer(zlib.decompress(shared.value), "i8"))


PAIRS = "a long, b long, part long"
GROUPED = "a, part, b, n, sig, shingles"


def confirmed(pairs: DataFrame, members: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b, part) whose full sets reach the threshold, as (a, b). ``part`` says
    where a pair is checked: each (a, part) has pairs of a bounded number."""

    def run(batches):
        own = None
        for batch in batches:
            a, part, b = (batch.column(i) for i in range(3))
            keep = []
            for i in range(batch.num_rows):
                at = a[i].as_py(), part[i].as_py()
                sig, found = batch.column(4)[i].as_py(), np.frombuffer(batch.column(5)[i].as_py(), "u8")
                if not b[i].is_valid:  # the first row of its group: a's own set
                    own = at, planes([sig]), found
                    keep.append(False)
                    continue
                if own is None or own[0] != at:
                    raise ValueError("a pair without its first member")
                near = 100 * min(len(found), len(own[2])) >= per_cent * max(len(found), len(own[2])) and estimate(own[1][0], planes([sig]))[0] >= per_cent / 100 - MARGIN
                keep.append(bool(near) and linked(own[2], found, per_cent))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], ["a", "b"])

    record = members.select("rep", "n", "sig", "shingles")
    first = pairs.select("a", "part").distinct().join(record, F.col("a") == F.col("rep")).withColumn("b", F.lit(None).cast("long"))
    second = pairs.join(record, F.col("b") == F.col("rep"))
    names = GROUPED.split(", ")
    both = first.select(*names).unionByName(second.select(*names))
    return map_arrow(both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()), run, "a long, b long")


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, comp) for the nodes of some edges (a, b): comp is the smallest node reached.

    Alternating large and small stars: each node's larger neighbours, then its smaller
    ones, are tied to the smallest of its neighbourhood, until nothing moves.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: written, (a, b), a > b."""
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
        tied = spread_join(both, least, "a", "n", e.count() * (1 + large), "b", "inner")
        moved = tied.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{at}-0")
    seen, k = mark(now), 0
    while seen[0]:
        k += 1
        now = written(star(written(star(now, True), f"{at}-{k}-large"), False), f"{at}-{k}")
        if (then := mark(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def cross_pairs(rows: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of different components within a group (key, i, j), estimated near enough.

    rows: key, i, j, asks, rep, comp, n, sig. Members that ask (block i of those outside the
    band's largest component) are compared with the others (block j of all members).
    """

    def pairs(group: dict) -> tuple[np.ndarray, ...]:
        rep, comp, n, asks = (np.array(group[k]) for k in ("rep", "comp", "n", "asks"))
        sig = planes(group["sig"])
        all_ = np.flatnonzero(~asks)
        out = [np.zeros((3, 0), "i8")]
        for x in np.flatnonzero(asks):
            other = all_[(comp[all_] != comp[x]) & (100 * np.minimum(n[all_], n[x]) >= per_cent * np.maximum(n[all_], n[x]))]
            if len(other):
                near = rep[other[estimate(sig[x], sig[other]) >= per_cent / 100 - MARGIN]]
                # checked at the smaller id, in the part of the block that the other is in
                part = np.where(near > rep[x], 2 * group["j"][0], 2 * group["i"][0] + 1)
                out.append(np.stack([np.minimum(near, rep[x]), np.maximum(near, rep[x]), part]))
        return np.concatenate(out, axis=1)

    def run(batches):
        held: dict[str, list] = {}
        out: list[np.ndarray] = []

        def flush():
            a, b, part = np.concatenate([np.zeros((3, 0), "i8"), *out], axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(part)], ["a", "b", "part"])

        def close():
            if held and any(held["asks"]):
                out.append(pairs(held))

        names = ["key", "i", "j", "asks", "rep", "comp", "n", "sig"]
        for batch in batches:
            columns = {k: batch.column(k) for k in names}
            ids = np.stack([columns[k].to_numpy() for k in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = {k: c.slice(at, end - at).to_pylist() for k, c in columns.items()}
                if held and all(held[k][0] == part[k][0] for k in ("key", "i", "j")):
                    for k in names:
                        held[k] += part[k]
                else:
                    close()
                    held = part
            if sum(x.shape[1] for x in out) > 50_000:
                yield flush()
        close()
        yield flush()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = map_arrow(dealt.select("key", "i", "j", "asks", "rep", "comp", "n", "sig"), run, PAIRS)
    return found.groupBy("a", "b").agg(F.min("part").alias("part"))


def blocks_of(size) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def open_rows(placed: DataFrame) -> DataFrame:
    """placed: key, rep, size, comp. For each band that lies in several components, who is
    to be compared with whom: (key, i, j, asks, rep, comp). A band's rows are dealt by key
    and block, never by key alone."""
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    bands = counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.first("size").alias("size"))
    bands = bands.select("key", F.col("top.comp").alias("major"), (F.col("size") - F.col("top.n")).alias("outside"), F.explode(F.sequence(F.lit(0), blocks_of(F.col("size")) - 1)).alias("j")).where("outside > 0")
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    own = placed.withColumn("j", block(blocks_of(F.col("size")))).join(bands, ["key", "j"])
    every = own.withColumn("i", F.explode(F.sequence(F.lit(0), blocks_of(F.col("outside")) - 1))).withColumn("asks", F.lit(False))
    asking = own.where("comp != major").withColumn("i", block(blocks_of(F.col("outside")))).withColumn("j", F.explode(F.sequence(F.lit(0), blocks_of(F.col("size")) - 1))).withColumn("asks", F.lit(True))
    names = ["key", "i", "j", "asks", "rep", "comp"]
    return every.select(*names).unionByName(asking.select(*names))


def near_duplicates(docs: DataFrame, per_cent: int = PER_CENT, at: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    at = at or shared_dir(docs.sparkSession)
    sets = written(shingle_sets(docs, bands_for(per_cent)), f"{at}/sets")
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), f"{at}/classes")
    ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    bands = written(usable.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")), f"{at}/bands")
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = written(shared.withColumn("n", F.col("size")), f"{at}/shared")
    buckets = written(spread_join(bands, shared, "key", "n", bands.count(), "rep", "inner"), f"{at}/buckets")  # key, rep, pivot, size
    members = written(member_sets(docs, written(buckets.select("rep").distinct(), f"{at}/reps")), f"{at}/members")

    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / STAR))
    stars = buckets.where("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.min(part).alias("part"))
    first = written(confirmed(written(stars, f"{at}/star-pairs"), members, per_cent), f"{at}/stars")
    comps = written(components(first, f"{at}/cc1"), f"{at}/comps")

    placed = buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    rows = open_rows(written(placed, f"{at}/placed")).join(members.select("rep", "n", "sig"), "rep")
    more = confirmed(written(cross_pairs(rows, per_cent), f"{at}/pairs"), members, per_cent)

    of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
    second = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    final = components(second, f"{at}/cc2")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    tops = written(final.withColumnRenamed("comp", "top").withColumnRenamed("node", "comp").join(sizes, "comp"), f"{at}/tops")
    merged = spread_join(comps, tops, "comp", "n", comps.count(), "node").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = final.join(comps.select("node"), "node", "left_anti")
    by_rep = merged.unionByName(alone).withColumnRenamed("node", "rep")
    roots = written(classes.join(by_rep, "rep", "left").select("digest", "n", F.coalesce("comp", "rep").alias("root")), f"{at}/roots")

    own = sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = spread_join(own, roots, "digest", "n", sets.count(), "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    dropped = near_duplicates(docs, per_cent).where(~F.col("kept")).select("doc_id").distinct()
    return without_ids(docs, written(dropped, f"{shared_dir(docs.sparkSession)}/dropped"))


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id isn't in a written table of ids. Up to ``SENT_IDS`` ids are
    broadcast; else a bit map of them is, and only the documents that it lets through meet
    the ids; where the map would tell too little, all documents with an id do."""
    if dropped.count() <= SENT_IDS:
        return docs.join(F.broadcast(dropped), "doc_id", "left_anti").select(docs.columns)
    known = id_map(dropped.withColumnRenamed("doc_id", "rep"))
    if known is None:
        left = docs.where("doc_id is not null").join(dropped, "doc_id", "left_anti")
        return docs.where("doc_id is null").unionByName(left.select(docs.columns))
    shared, name = docs.sparkSession.sparkContext.broadcast(zlib.compress(known.tobytes(), 1)), uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def let_through(at: pa.Array) -> pa.Array:
        bits, at = _worker_map(name, shared), at.to_numpy()
        return pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    through = docs["doc_id"].isNotNull() & let_through(F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)))
    few = docs.where(through).join(dropped, "doc_id", "left_anti")
    return docs.where(~through).unionByName(few.select(docs.columns))
