"""Token counts by a two-tier lookup on the map side.

Pre-tokens here are the pieces between ASCII white space, at which this vocabulary's
pre-tokenizer always cuts. A first pass counts them over all documents in bounded
per-partition sketches (no pre-token is ever shuffled: whole sketches are merged, each at
most ``table_size`` entries). The merged table's token lengths are broadcast as one
compact array of keys, offsets and lengths (at most ``table_size`` entries and
``table_bytes`` bytes of keys). The second pass adds up lengths; a pre-token outside the
table is encoded by the library and kept in the worker's bounded cache. The table decides
only how fast a length is found, never what it is.

Defined results: null text counts as empty (0 bytes, 0 tokens); a very long text is counted
whole; a pre-token of over ``LONG`` bytes is neither counted as frequent nor cached, so a
text without white space fills no memory but its own; rows with equal ids or texts each give
a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import WorkerCache, id_and_text, map_arrow
from tokoro.llm.subwords import word_bpe

TABLE_SIZE, TABLE_BYTES, FAN_IN = 32_768, 1 << 20, 16
#: A partition's counter is thinned when it holds so many keys.
COUNTER_LIMIT = 200_000


def _thin(counts: Counter, keep: int) -> Counter:
    return Counter(dict(counts.most_common(keep)))


def _pack(counts: Counter, size: int, most_bytes: int) -> bytes:
    """The most frequent keys (ties by key), as counts, lengths and the keys' bytes."""
    keys, used = [], 0
    for key, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]:
        used += len(key)
        if used > most_bytes:
            break
        keys.append(key)
    return struct.pack("<I", len(keys)) + np.array([counts[k] for k in keys], "<u8").tobytes() + np.array([len(k) for k in keys], "<u4").tobytes() + b"".join(keys)


def _unpack(data: bytes) -> list[tuple[bytes, int]]:
    (n,) = struct.unpack_from("<I", data)
    counts = np.frombuffer(data, "<u8", n, 4)
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4 + 8 * n))
    keys, at, out = data[4 + 12 * n :], 0, []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        out.append((keys[at:end], count))
        at = end
    return out


def frequent_pretokens(docs: DataFrame, size: int = TABLE_SIZE, most_bytes: int = TABLE_BYTES) -> list[bytes]:
    """The corpus's frequent pre-tokens, most frequent first; counts cover all documents,
    up to what thinning a full counter loses at its rare end."""

    def sketch(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = text.split()
                counts.update(words if len(text) <= WorkerCache.LONG else [w for w in words if len(w) <= WorkerCache.LONG])
                if len(counts) > COUNTER_LIMIT:
                    counts = _thin(counts, COUNTER_LIMIT // 2)
        yield pa.RecordBatch.from_pydict({"sketch": pa.array([_pack(counts, size, most_bytes)], pa.binary())})

    def merge(tables):
        counts: Counter = Counter()
        for part in tables:
            for data in part.column("sketch").to_pylist():
                counts.update(dict(_unpack(data)))
        yield pa.RecordBatch.from_pydict({"sketch": pa.array([_pack(counts, size, most_bytes)], pa.binary())})

    parts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    tasks = max(1, parts.rdd.getNumPartitions())
    level = map_arrow(parts, sketch, "sketch binary")
    while tasks > 1:  # a tree of merges, FAN_IN sketches at a time
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks).mapInArrow(merge, "sketch binary")
    rows = level.collect()  # one row of at most table_bytes and 12 bytes a key
    return [key for row in rows for key, _ in _unpack(bytes(row[0]))]


class LengthTable(dict):
    """First tier: the broadcast lengths. Second tier: the worker's cache."""

    def __init__(self, known: dict, make):
        super().__init__(known)
        self.cache = WorkerCache(make, 250_000)

    def __missing__(self, key: bytes) -> int:
        return self.cache[key]


_TABLES: dict = {}


def _worker_table(name: str, compact, tokenizer: str) -> LengthTable:
    """The worker's own table of a broadcast, built once a worker."""
    if _TABLES.get("name") != name:
        blob, ends, lengths = compact.value
        starts = [0, *ends.tolist()[:-1]]
        known = {blob[a:b]: n for a, b, n in zip(starts, ends.tolist(), lengths.tolist(), strict=False)}
        _TABLES.update(name=name, table=LengthTable(known, lambda k: len(word_bpe(tokenizer).ids(k)) // 4))
    return _TABLES["table"]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, size: int = TABLE_SIZE, most_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""
    keys = frequent_pretokens(docs, size, most_bytes)
    coder = word_bpe(tokenizer)
    lengths = np.array([len(coder.ids(k)) // 4 for k in keys], "<u4")
    ends = np.cumsum([len(k) for k in keys], dtype="<u8") if keys else np.zeros(0, "<u8")
    compact = docs.sparkSession.sparkContext.broadcast((b"".join(keys), ends, lengths))

    name = uuid.uuid4().hex

    def count(batches):
        find = _worker_table(name, compact, tokenizer).__getitem__
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            n = pa.array([sum(map(find, t.split())) for t in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(id_and_text(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
