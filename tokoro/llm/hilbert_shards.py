"""Shards along a Hilbert curve over several quantised metadata dimensions.

Each dimension is a number of ``BITS`` bits that keeps the dimension's own order: language
and source are cut at values of theirs (every value while there are at most 2^BITS, else
quantiles of the rows), length by its logarithm. The curve's index of a row is found bit by
bit through a table of the curve's orientations. Rows are sorted by index, equal indices by
checksum and id, and the sorted sequence is cut into runs of equal row counts (at most one
apart), so that a shard covers a compact region in every dimension and its files'
minima and maxima let a reader skip them for filters on any of them.

Everything is DataFrame and SQL expressions. Positions come from range partitions and the
place inside them, so no task holds more than a range and no window spans the table; a hot
index is split by checksum and id. At most 2^BITS cuts of a dimension reach the driver.

Defined results: null text counts as empty (size 16, checksum 0) and a very long one has a
size and a checksum like any other; null language or source goes first, a null id is a
value like others; repeated rows get a place each; an empty table gives no rows; other
columns are ignored (``write_shards`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokoro.llm.common import ranked, shared_dir, written

SHARDS, BITS, DIMS = 40, 5, 3
#: Lengths at which a cell of that dimension begins: the least n with log2(n) * 1.5 >= k.
LENGTHS = [next(n for n in range(max(1, int(2 ** (k / 1.5)) - 1), 1 << 62) if n**3 >= 4**k) for k in range(1, 1 << BITS)]


def curve_table(n: int = DIMS) -> list[int]:
    """For each orientation (entry corner e, direction d) and corner l: 2^n times the
    next orientation plus the corner's place on the curve.

    Hamilton's rule: in Gray code, the place of a corner is the inverse code of the corner
    reflected by e and rotated by d + 1; the next e and d follow from that place.
    """
    size, mask = 1 << n, (1 << n) - 1
    rotate = lambda x, k: (x << k % n | x >> (n - k % n)) & mask
    gray = lambda i: i ^ i >> 1
    place_of = {gray(i): i for i in range(size)}
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing ones of i
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
    out = []
    for state in range(size * n):
        e, d = divmod(state, n)
        for corner in range(size):
            w = place_of[rotate(corner ^ e, n - (d + 1) % n)]
            e2, d2 = e ^ rotate(entry(w), d + 1), (d + turn(w) + 1) % n
            out.append((e2 * n + d2) << n | w)
    return out


def hilbert_index(dims: list[str], bits: int = BITS) -> Column:
    """The curve's index of columns of ``bits``-bit numbers, as one SQL fold over bits."""
    n = len(dims)
    table = ",".join(map(str, curve_table(n)))
    corner = " | ".join(f"shiftleft(shiftright({c}, bit) & 1, {i})" for i, c in enumerate(dims))
    states = (1 << n) * n
    next_ = f"element_at(array({table}), cast((acc % {states}) * {1 << n} + ({corner}) + 1 as int))"
    # acc holds index * states + orientation
    step = f"aggregate(array({next_}), 0L, (_, v) -> (acc div {states} * {1 << n} + (v & {(1 << n) - 1})) * {states} + shiftright(v, {n}))"
    levels = ",".join(str(b) for b in reversed(range(bits)))
    return F.expr(f"aggregate(array({levels}), 0L, (acc, bit) -> {step}) div {states}")


def cuts(docs: DataFrame, column: str, at: str, bits: int = BITS) -> list[str]:
    """Ascending values at which a text column's cells begin, the first cell excepted."""
    cells = 1 << bits
    counts = written(docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), f"{at}/{column}")
    few = [r["value"] for r in counts.select("value").limit(cells + 1).collect()]
    if len(few) <= cells:
        return sorted(few, key=lambda v: v.encode())[1:]
    # Running row counts: within ranges of values, each after the sum of the ranges before.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), f"{at}/{column}-ranges")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("base"))  # one row a range
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = counts.agg(F.sum("n")).first()[0]
    cell = lambda c: F.floor(F.least(c, F.lit(total - 1)) * cells / total)
    begins = ranged.join(F.broadcast(bases), "part").withColumn("upto", upto).where(cell(F.col("upto")) > cell(F.col("upto") - F.col("n")))
    return sorted((r["value"] for r in begins.select("value").collect()), key=lambda v: v.encode())[:cells - 1]


def cell_of(column: str, begins: list[str], bits: int = BITS) -> Column:
    """A value's cell: how many cuts lie at or below it, spread over all cells."""
    if not begins:
        return F.lit(0)
    below = F.size(F.filter(F.array(*map(F.lit, begins)), lambda v: v <= F.col(column)))
    return F.when(F.col(column).isNull(), 0).otherwise((below * ((1 << bits) - 1) / len(begins)).cast("int"))


def metadata(docs: DataFrame, at: str, keep: list[Column] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and the curve's index: by language, source and length."""
    text = F.coalesce(docs["text"], F.lit(""))
    cell = lambda c: cell_of(c, cuts(docs, c, at))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        cell("lang").alias("x"),
        cell("source").alias("y"),
        F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: n <= F.octet_length(text) + 1)).alias("z"),
        *keep,
    ).select("doc_id", "size", "text_crc32", hilbert_index(["x", "y", "z"]).alias("curve"), *([KEPT] if keep else []))


KEPT = "__row"


def placed(meta: DataFrame, shards: int, at: str) -> DataFrame:
    """Rows with shard and slot: runs of the order along the curve."""
    rows = ranked(meta, ["curve", "text_crc32", "doc_id"], at)
    n = max(1, rows.count())
    shard = F.floor(F.col("position") * shards / F.lit(n)).cast("int") if n * shards >= 1 << 52 else F.expr(f"cast(position * {shards} div {n} as int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("position") - first)


def shard_documents(docs: DataFrame, shards: int = SHARDS, at: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve's index."""
    at = at or shared_dir(docs.sparkSession)
    meta = written(metadata(docs, at), f"{at}/metadata")  # the range bounds are sampled from this, not from texts
    out = placed(meta, shards, f"{at}/sorted")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents with all their columns, one folder a shard (a column ``shard``,
    or ``shard_`` and so on where the table has one), in slot order, and return what was
    written. Rows travel with their place, so repeated ids are repeated rows and no more."""
    at = shared_dir(docs.sparkSession)
    meta = metadata(docs, at, [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(KEPT)])
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = placed(meta, shards, f"{at}/sorted")
    rows.select(f"{KEPT}.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return docs.sparkSession.read.parquet(path)
