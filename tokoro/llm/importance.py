"""Importance resampling of documents towards a target's distribution of word runs.

Words are runs of ASCII digits and letters (lower-cased) and of everything beyond ASCII; a
text's features are its runs of one to three consecutive words, repeats counted. A
feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.

1. Each partition reads its documents in blocks of bounded words and builds each block's
   word trie: a node of depth k is a run of k words, found by its parent and its last
   word, and holds how often the run occurs and its CRC state, which is its parent's state
   carried on over a space and the word. So a run's bytes are never put together, and a run
   that occurs often is hashed once. The nodes' counts go to the partition's bucket totals,
   and only those (``BUCKETS`` numbers a partition) are shuffled and summed.
2. The target's texts are counted the same way, and both totals give each bucket's gain
   (``BUCKETS`` whole numbers, sent to the workers).
3. Documents are scored on block tries again: each node has its path's gain, the sum of the
   gains of the run and of its beginnings, and a document's weight is the sum over the
   longest paths that start at its words, up to three words deep and within the document.
4. A document's score adds its Gumbel number, made from the id and the seed. Documents with
   ``LEAST`` words or more are ranked through range partitions, and the first share is drawn.

Defined results: null text and text without words have no features and weight 0; a very
long text is read in pieces of ``PIECE`` bytes that share two words; rows of equal id or
text are documents each (equal scores come by id, equal ids in any order); a row without
id has no score, isn't drawn and doesn't count for the share; an empty target or an empty
table leave no gain undefined (all counts have one added); further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import held_alone, map_arrow, ranked, shared_dir, written

BUCKETS, DEPTH, LEAST, PER_CENT, SEED = 10_000, 3, 20, 5, 42
#: Words of a block, and bytes of a long text that are split into words at a time.
BLOCK_WORDS, PIECE = 1 << 17, 1 << 20

#: Bytes as words see them: letters in lower case, all other ASCII but digits a space.
_SEEN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, some at a time."""
    if len(text) <= PIECE:
        yield text.translate(_SEEN).split()
        return
    seen, at = text.translate(_SEEN), 0
    while at < len(seen):
        end = seen.find(b" ", at + PIECE)
        end = len(seen) if end < 0 else end
        yield seen[at:end].split()
        at = end


class Block:
    """Parts of texts in a row and the trie of their words.

    A part after a text's first begins with the words that the part before it ended with;
    runs within these are counted there.
    """

    def __init__(self):
        self.words: list[bytes] = []
        self.starts: list[int] = []  # where parts begin
        self.fresh: list[int] = []  # where their words begin that no earlier part had
        self.rows: list[int] = []  # which row's they are

    def add(self, row: int, words: list[bytes], before: list[bytes]) -> None:
        self.starts.append(len(self.words))
        self.rows.append(row)
        self.fresh.append(len(self.words) + len(before))
        self.words += before + words

    def spread(self, of_parts: list[int]) -> np.ndarray:
        """A number of each part, for each of its words."""
        return np.repeat(np.array(of_parts, "i8"), np.diff([*self.starts, len(self.words)]))

    def trie(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth: the node that the run from each position ends in (-1 where the part
        ends before), and the nodes' counts, CRC states and parents."""
        n = len(self.words)
        index: dict[bytes, int] = {}
        word = np.fromiter((index.setdefault(w, len(index)) for w in self.words), "i8", n)
        ends, fresh, place = self.spread([*self.starts[1:], n]), self.spread(self.fresh), np.arange(n)
        spaced = [b" " + w for w in index]
        node, states, parent = word, list(map(zlib.crc32, index)), np.zeros(len(index), "i8")
        for k in range(DEPTH):
            if k:
                at = np.flatnonzero((place + k < ends) & (node >= 0))
                codes, keys = pd.factorize(node[at] << 32 | word[at + k])
                parent = keys >> 32
                tails = map(spaced.__getitem__, (keys & 0xFFFFFFFF).tolist())
                states = list(map(zlib.crc32, tails, map(states.__getitem__, parent.tolist())))
                node = np.full(n, -1)
                node[at] = codes
            counted = node[(node >= 0) & (place + k >= fresh)]
            yield node, np.bincount(counted, minlength=len(states)), np.array(states, "i8"), parent

    def weights(self, gain: np.ndarray) -> np.ndarray:
        """Each word's path gain: of the runs that begin there and weren't counted before."""
        place, fresh = np.arange(len(self.words)), self.spread(self.fresh)
        total, stale = np.zeros(len(self.words), "i8"), np.zeros(len(self.words), "i8")
        path = np.zeros(0, "i8")
        for k, (node, _, crc, parent) in enumerate(self.trie()):
            path = gain[crc % len(gain)] + (path[parent] if k else 0)
            there = node >= 0
            total[there] = path[node[there]]
            old = there & (place + k < fresh)
            stale[old] = path[node[old]]
        return total - stale


def blocks(texts: Iterator[tuple[int, bytes]]) -> Iterator[Block]:
    """Blocks of at most ``BLOCK_WORDS`` words and a piece; a text may span several."""
    block = Block()
    for row, text in texts:
        before: list[bytes] = []
        for words in pieces(text):
            block.add(row, words, before)
            before = (before + words)[1 - DEPTH :]
            if len(block.words) >= BLOCK_WORDS:
                yield block
                block = Block()
    if block.words:
        yield block


def bucket_totals(rows: DataFrame) -> DataFrame:
    """(bucket, n): the features of column ``text`` in each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, "i8")
        texts = ((0, t) for batch in batches for t in batch.column(0).cast(pa.binary()).to_pylist())
        for block in blocks(texts):
            for _, n, crc, _ in block.trie():
                np.add.at(total, crc % BUCKETS, n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    found = map_arrow(rows.select(F.coalesce("text", F.lit("")).alias("text")), run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain, from the totals of both."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "outer")
    s, t = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8")
    for r in both.collect():  # at most BUCKETS rows
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    top = (t.astype(float) + 1) * (float(s.sum()) + BUCKETS)
    return np.floor(1000 * np.log(top / ((s.astype(float) + 1) * (float(t.sum()) + BUCKETS)))).astype("i8")


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    sent, name = docs.sparkSession.sparkContext.broadcast(gain), uuid.uuid4().hex

    def run(batches):
        own = held_alone(name, lambda: sent.value)
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, "i8"), np.zeros(batch.num_rows, "i8")
            for block in blocks(enumerate(batch.column(1).cast(pa.binary()).to_pylist())):
                np.add.at(weight, block.spread(block.rows), block.weights(own))
                np.add.at(n, block.rows, np.array([*block.starts[1:], len(block.words)]) - block.fresh)
            features = sum(np.maximum(n - k, 0) for k in range(DEPTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(given, run, "doc_id long, n_words long, n_features long, weight long", rows=2048)


def gumbel(seed: int, scale: int = 1000) -> Column:
    """A whole Gumbel number of a document, from the first 32 bits of its id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least: int = LEAST, seed: int = SEED, at: str | None = None) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank in the draw (null if not
    drawn), by resemblance to the texts of ``target``."""
    at = at or shared_dir(docs.sparkSession)
    gain = gains(bucket_totals(docs), bucket_totals(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(seed))
    asked = F.col("score").isNotNull() & (F.col("n_words") >= least)
    scored = written(scored.withColumn("behind", F.when(asked, -F.col("score"))).withColumn("tie", F.monotonically_increasing_id()), f"{at}/scored")
    drawn = scored.where("behind is not null").count() * per_cent // 100
    order = [F.col("behind").asc_nulls_last(), F.col("doc_id"), F.col("tie")]  # the last splits rows that are equal
    place = F.col("position")
    rank = F.when(F.col("behind").isNotNull() & (place < drawn), place + 1)
    return ranked(scored, order, f"{at}/ranked").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
