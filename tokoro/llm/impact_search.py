"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Index. Candidates are cut into blocks. Within a block each dimension is a posting list,
sorted by value and cut into ``LEVELS`` segments of equal width, so a segment's quantised
impact bounds what it can add to any query's score from both sides. A negative query
component reads its list from the other end, so contributions, counted from the least
that a dimension can give, are never negative.

Search. Segments are processed by descending quantised impact, a round at a time, adding
lower bounds to accumulators. A candidate's score is at most its accumulator plus the
quantisation's width plus what the lists can still give it; the query's k-th best lower
bound, or its k-th best exact score from earlier blocks, is what a member must reach. A
block is left only when this proves that all but a few candidates can't be members; those
that may be (ties included) are scored exactly. If the proof doesn't come, all segments
are read.

The index is written dealt to as many files as tasks will read it. Queries are packed into
rows of binary columns and taken in chunks of at most ``CHUNK_BYTES``, each broadcast by
that bound and run over the index where it lies (nothing of it is shuffled); a task keeps k
rows a query of the chunk.

Defined results: vectors that are null or empty, hold a null or non-finite component or
have no vec_id take no part; vectors of another length than the query's aren't candidates
for it; rows that share the query's vec_id are its own; equal scores go to the smaller
vec_id; of repeated rows each is a candidate, and where several rows have a query's id the
smallest vector (component by component) is the query; fewer than k candidates give fewer
rows; an empty table gives none. Integers and scores beyond 64 bits are the nearest that
64 bits hold. Very long vectors make smaller blocks.
"""

from __future__ import annotations

import operator
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.llm.common import map_arrow, shared_dir, written

K, BLOCK, LEVELS = 10, 4096, 128
#: A block's components take at most so many bytes, as do the queries of a chunk.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 16 << 20
#: After each round, lists have been read down to this share of the largest impact.
ROUNDS = (0.7, 0.52, 0.4, 0.3, 0.2, -1.0)
INDEX = "size int, n int, ids binary, components binary, postings binary, levels binary"
QUERY = "size int, n int, ids binary, components binary"
HIT = "query_id long, vec_id long, score long"
HITS = "query_id long, rank int, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * component) of the vectors that take part."""
    usable = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.where(usable).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("v"))


def products(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of a query with columns; in Python's integers where 64 bits
    might not do."""
    if len(query) * np.abs(query.astype("f8")).max(initial=0) * np.abs(x.astype("f8")).max(initial=0) < 2.0**62:
        return query @ x
    q = query.tolist()
    return np.array([min(HIGH, max(LOW, sum(map(operator.mul, q, column)))) for column in x.T.tolist()], "i8")


class Block:
    """Posting lists of n candidates: ``postings[d]`` are their numbers by ascending value
    of dimension d, ``levels[d]`` the segments they lie in."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, postings=None, levels=None):
        self.ids, self.x = ids, x  # x: dimensions x candidates
        self.low = x.min(axis=1).astype("f8")
        self.width = np.maximum((x.max(axis=1).astype("f8") - self.low) / LEVELS, 1e-9)
        if postings is None:
            postings = np.argsort(x, axis=1, kind="stable").astype("u2")
            values = np.take_along_axis(x, postings.astype("i8"), axis=1)
            levels = np.minimum((values - self.low[:, None]) / self.width[:, None], LEVELS - 1).astype("u1")
        self.postings, self.levels = postings, levels
        # Where each segment of each list begins.
        self.cuts = np.stack([np.searchsorted(own, np.arange(LEVELS + 1)) for own in levels]) if len(x) else np.zeros((0, LEVELS + 1), "i8")

    def members(self, query: np.ndarray, own_id: int, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and exact scores of the candidates that may be among the k best;
        ``reach``: a score that members have at least. Also the postings read."""
        n, d = len(self.ids), len(query)
        weight = np.abs(query).astype("f8")
        unit = weight * self.width  # of one level
        impact = unit * LEVELS
        highest = np.where(query > 0, self.low + LEVELS * self.width, self.low)
        base = float((query * highest).sum() - impact.sum())  # the least that all lists give
        total_width = float(unit.sum())
        low = np.zeros(n)
        seen = np.zeros(n)
        own = self.ids == own_id
        read = 0
        done = np.zeros(d, "i8")
        few = max(4 * k, n // 64)
        top = float(impact.max(initial=0))
        alive = ~own
        for share in ROUNDS:
            bar = share * top
            goal = np.full(d, LEVELS) if share < 0 else np.clip(np.ceil(np.divide(impact - bar, unit, out=np.zeros(d), where=unit > 0)), 0, LEVELS).astype("i8")
            goal = np.maximum(np.where(weight > 0, goal, 0), done)
            which, scale, lev = [], [], []
            for j in np.flatnonzero(goal > done):
                up = query[j] > 0
                a, b = (self.cuts[j, LEVELS - goal[j]], self.cuts[j, LEVELS - done[j]]) if up else (self.cuts[j, done[j]], self.cuts[j, goal[j]])
                if b > a:
                    which.append(self.postings[j, a:b])
                    own_levels = self.levels[j, a:b].astype("f8")
                    lev.append((own_levels if up else LEVELS - 1 - own_levels) * unit[j])
            done = goal
            if which:
                at = np.concatenate(which)
                read += len(at)
                low += np.bincount(at, np.concatenate(lev), n)
                seen += np.bincount(at, minlength=n)
            left = np.where(weight > 0, (LEVELS - done) * unit, 0)
            lists = int((weight > 0).sum())
            rest = np.minimum(left.sum(), (lists - seen) * left.max(initial=0))
            floor_ = low[alive]
            least = reach - base
            if len(floor_) >= k:
                least = max(least, float(np.partition(floor_, len(floor_) - k)[-k]))
            alive = ~own & (low + rest + total_width >= least - 1e-6 * (1 + abs(base) + abs(least)))
            if int(alive.sum()) <= few:
                break
        maybe = np.flatnonzero(alive)
        return maybe, products(query, self.x[:, maybe]), read


def _packed(vectors: DataFrame, make, schema: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Vectors of equal length, up to so many rows and bytes of components together, each
    group made a row of (size, n, ids, components, ...) by ``make``."""

    def row(size: int, held: list) -> pa.RecordBatch:
        ids = np.array([i for i, _ in held], "i8")
        values = [size, len(ids), *make(ids, np.array([v for _, v in held], "i8").reshape(len(held), size))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(values) - 2)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    def run(batches):
        held = defaultdict(list)
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[len(v)]
                own.append((i, v))
                if len(own) >= min(most_rows, max(1, most_bytes // (8 * len(v)))):
                    yield row(len(v), held.pop(len(v)))
        for size, own in held.items():
            yield row(size, own)

    return map_arrow(vectors.select("vec_id", "v"), run, schema)


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: ids, components and posting lists."""

    def make(ids: np.ndarray, v: np.ndarray) -> list[bytes]:
        b = Block(ids, np.ascontiguousarray(v.T))
        return [ids.tobytes(), b.x.tobytes(), b.postings.tobytes(), b.levels.tobytes()]

    return _packed(vectors, make, INDEX, block, BLOCK_BYTES)


def search_chunk(index: DataFrame, queries: list[tuple[int, bytes, bytes]], k: int) -> DataFrame:
    """The k best of each query (size, ids, components) over the blocks of each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        asked = [(int(i), v) for size, ids, x in shared.value for i, v in zip(np.frombuffer(ids, "i8"), np.frombuffer(x, "i8").reshape(-1, size), strict=True)]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                d, n = r["size"], r["n"]
                read = lambda name, kind, r=r, d=d, n=n: np.frombuffer(r[name], kind).reshape(d, n)
                block = Block(np.frombuffer(r["ids"], "i8"), read("components", "i8"), read("postings", "u2"), read("levels", "u1"))
                for number, (query_id, v) in enumerate(asked):
                    if len(v) != d:
                        continue
                    ids, scores = best.get(number, (np.zeros(0, "i8"), np.zeros(0, "i8")))
                    reach = float(scores[-1]) if len(scores) == k else -np.inf
                    maybe, found = block.members(v, query_id, k, reach)[:2]
                    ids, scores = np.concatenate([ids, block.ids[maybe]]), np.concatenate([scores, found])
                    order = np.lexsort((ids, ~scores))[:k]  # ~: descending, without overflow
                    best[number] = ids[order], scores[order]
        for number, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), asked[number][0])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return map_arrow(index, run, HIT)


def top_k(vectors: DataFrame, is_query: str, k: int = K, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK, scale: int = 1024, at: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query``: SQL condition on vec_id."""
    spark = vectors.sparkSession
    at = at or shared_dir(spark)
    numbers = quantised(vectors, scale)
    files = max(vectors.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    index = written(build_index(numbers, block).repartition(files), f"{at}/index")
    asked = numbers.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(_packed(asked, lambda ids, v: [ids.tobytes(), v.tobytes()], QUERY, block, min(chunk_bytes, 1 << 20)), f"{at}/queries")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def flush(held: list) -> None:
        hits = search_chunk(index, held, k).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        hits.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(f"{at}/hits")

    held, size = [], 0
    for r in queries.toLocalIterator():  # a partition at a time; never more than a chunk is kept
        own = (r["size"], bytes(r["ids"]), bytes(r["components"]))
        if held and size + len(own[2]) > chunk_bytes:
            flush(held)
            held, size = [], 0
        held.append(own)
        size += len(own[2])
    flush(held)
    return spark.read.schema(HITS).parquet(f"{at}/hits")
