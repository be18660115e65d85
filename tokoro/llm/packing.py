"""Best-fit packing of token sequences by bin completion with branch and bound.

A document longer than a sequence is cut into full pieces, the first piece taking what
remains; every other document is one piece. Full pieces are sequences by themselves. The
rest is packed as a histogram: lengths lie between 1 and ``capacity`` - 1, so the driver
gets at most that many (length, count) rows at any corpus size, and plans *kinds* of
sequences (a multiset of lengths and how often to make it) instead of single ones.

Planning. A best-fit-decreasing packing is the first incumbent. Then the largest length
left is completed again and again: all undominated fillings of the space beside it, of any
number of pieces, come lazily, least waste first (a filling is dominated when an available
length fits beside it, or fits in the place of some of its pieces without wasting more),
each applied as often as its counts and the waste still allowed permit, then less often.
Depth-first search over the choices stops a branch whose waste so far exceeds what a
packing better than the incumbent may waste, and ends at the lower bound, when nothing is
left to try (the incumbent is then proven to be best) or after ``nodes`` nodes beyond the
first dive; then the incumbent is the result. ``STEPS`` lengths looked at within a filling
count as a node. ``nodes=math.inf`` searches without that end, until the packing is proven.

Placing. Each task numbers its pieces of a length; offsets over (length, task) counts make
that a gapless rank with no window over a whole length (a third of all pieces may share
one), and the rank alone decides sequence and offset.

Defined results: null text is empty (its piece is the end id alone); a very long text gives
as many pieces as it needs; pieces of equal length are told apart by their rank alone;
repeated rows are packed each; an empty table gives no rows; other columns are ignored. doc_ids may repeat:
pieces are then told apart by nothing but their place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.llm.common import id_and_text, map_arrow, shared_dir, written
from tokoro.llm.subwords import byte_bpe

CAPACITY, NODES, STEPS, ALIVE = 2048, 4000, 1024, 16
#: Rows of piece offsets up to which they are broadcast (24 bytes each).
OFFSETS = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: A kind of sequence: how many to make, and (length, copies) of each, in order of place.
Kind = tuple[int, tuple[tuple[int, int], ...]]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens."""
    head = total % capacity or min(total, capacity)
    return [(0, head), *((at, capacity) for at in range(head, total, capacity))]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound: for each k, lengths over capacity - k are alone,
    those over half can't pair, and what exceeds the room beside them needs more."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in {0, *(s for s in counts if s <= capacity // 2)}:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best-fit decreasing over groups of equal bins."""
    bins: dict[int, Counter] = {}  # room left -> how many bins of each content
    rooms: list[int] = []

    def add(room: int, content: tuple, n: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            bisect.insort(rooms, room)
        bins[room][content] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * size, ((size, each),), full)
                if rest:
                    add(capacity - rest * size, ((size, rest),), 1)
                break
            room = rooms[i]
            content, n = bins[room].popitem()
            each = min(room // size, left)
            used = min(n, left // each)
            if n > used:
                bins[room][content] = n - used
            if not bins[room]:
                del bins[room], rooms[i]
            add(room - each * size, (*content, (size, each)), used)
            left -= used * each
    return [(n, content) for group in bins.values() for content, n in group.items()]


def fillings(room: int, have: dict[int, int], slack: Callable[[], int]) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """Undominated fillings of ``room`` as (length, copies), least waste first, larger
    lengths first among equals, while the waste is within ``slack()``. None is given after
    every ``STEPS`` lengths looked at, for the caller to count.

    Sets of sums are the bits of an integer; ``reach[i]`` holds those that the i smallest
    lengths can make, so no branch is entered that can't end at the waste looked for.
    """
    sizes = sorted(s for s, n in have.items() if n and s <= room)
    reach, every = [1], (1 << room + 1) - 1
    for s in sizes:
        bits, n, k = reach[-1], min(have[s], room // s), 1
        while n:
            k = min(k, n)
            bits |= bits << k * s & every
            n, k = n - k, 2 * k
        reach.append(bits)
    steps = 0

    def within(i: int, target: int, waste: int, one: int, more: int, unused: int) -> Iterator[tuple | None]:
        """Of the i smallest lengths; one, more: sums of one and of several pieces taken."""
        nonlocal steps
        if not target:
            if not unused or (unused & -unused).bit_length() - 1 > waste:
                yield ()
            return
        while i and reach[i] >> target & 1:
            i -= 1
            size = sizes[i]
            steps += 1
            if not steps % STEPS:
                yield None
            sums, singles, grown = [], one, more
            for _ in range(min(have[size], target // size)):
                grown |= (singles | grown) << size & every
                singles |= 1 << size
                sums.append(grown)
            for copies in range(len(sums), 0, -1):
                rest = target - copies * size
                if not reach[i] >> rest & 1:
                    continue
                grown, still = sums[copies - 1], unused & ~(1 << size) if copies == have[size] else unused
                wider, k = (singles | grown) << 1, 1
                while k < waste:  # sums with 1 to waste more
                    step = min(k, waste - k)
                    wider, k = wider | wider << step, k + step
                # lengths that could stand for pieces are larger than all that may still be taken
                if still & (grown | wider if waste else grown):
                    continue
                for tail in within(i, rest, waste, singles, grown, still):
                    yield tail if tail is None else ((size, copies), *tail)

    available = sum(1 << s for s in sizes)
    must = 0
    for waste in range(room + 1):
        must += waste * have.get(waste, 0)  # all that would still fit has to be taken
        if waste > slack() or must > room - waste:
            return
        if reach[-1] >> room - waste & 1:
            yield from within(len(sizes), room - waste, waste, 0, 0, available)


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Kind]:
    """A packing with as few sequences as the search finds."""
    left = {s: n for s, n in counts.items() if n}
    best = best_fit(left, capacity)
    fewest, least = sum(n for n, _ in best), lower_bound(left, capacity)
    total = sum(s * n for s, n in left.items())
    sizes, chosen = sorted(left), []
    used = wasted = seen = 0

    def slack() -> int:
        return (fewest - 1) * capacity - total - wasted

    def options(last: tuple) -> Iterator[Kind | None]:
        """Kinds that hold the largest length, but the one just made: more of it was tried."""
        largest = sizes[-1]
        have = {s: left[s] for s in sizes}
        have[largest] -= 1
        for filling in fillings(capacity - largest, have, slack):
            if filling is None:
                yield None
                continue
            content = ((largest, 1), *filling)
            if filling and filling[0][0] == largest:
                content = ((largest, 1 + filling[0][1]), *filling[1:])
            if content == last:
                continue
            most, waste = min(left[s] // c for s, c in content), capacity - sum(s * c for s, c in content)
            for n in range(min(most, slack() // waste) if waste else most, 0, -1):
                yield n, content

    def put(n: int, content: tuple, sign: int) -> None:
        nonlocal used, wasted
        used, wasted = used + sign * n, wasted + sign * n * (capacity - sum(s * c for s, c in content))
        for s, c in content:
            if not left[s]:
                bisect.insort(sizes, s)
            left[s] -= sign * n * c
            if not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))

    def after(level: Iterator, last: Kind) -> Iterator[Kind | None]:
        """What follows a choice. Choices come by waste, so if the last one isn't among
        them any more (less may be wasted now), nothing that follows is."""
        reached = passed = False
        for choice in level:
            if choice is None or passed:
                yield choice
            elif choice[1] == last[1]:
                reached = True
                if choice[0] < last[0]:
                    passed = True
                    yield choice
            elif reached:
                passed = True
                yield choice

    # Each level of the search: its options and the last choice. Options hold sets of sums;
    # those of levels far above the deepest are dropped and made again if it comes to that.
    stack: list[list] = [[options(()), None]] if sizes else []
    diving = True
    while stack and fewest > least and seen < nodes:
        level = stack[-1]
        if level[0] is None:
            level[0] = after(options(chosen[-1][1] if chosen else ()), level[1])
        choice = next(level[0], ())
        if choice == ():
            diving = False
            stack.pop()
            if chosen:
                put(*chosen.pop(), -1)
            continue
        seen += not diving or choice is None  # the first dive is free
        if choice is None:
            continue
        level[1] = choice
        if choice[0] * (capacity - sum(s * c for s, c in choice[1])) > slack():
            continue
        put(*choice, 1)
        chosen.append(choice)
        if sizes:
            stack.append([options(choice[1]), None])
            if len(stack) > ALIVE:
                stack[-ALIVE - 1][0] = None
            continue
        diving = False
        if used < fewest:
            best, fewest = list(chosen), used
        put(*chosen.pop(), -1)
    return best


def places(plan: list[Kind]) -> np.ndarray:
    """Rows (length, first rank, bins, first sequence, offset), sorted: a piece whose rank
    is i beyond the first lies in sequence first + i mod bins, i div bins copies on."""
    rows, ranks, base = [], Counter(), 0
    for n, content in plan:
        at = 0
        for size, copies in content:
            rows.append((size, ranks[size], n, base, at))
            ranks[size] += n * copies
            at += size * copies
        base += n
    return np.array(sorted(rows), "<i8").reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document, numbered by length within each task."""

    def run(batches):
        from pyspark import TaskContext

        coder, task = byte_bpe(tokenizer), TaskContext.get().partitionId()
        end, nth = int(end_id).to_bytes(4, "little"), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = coder.ids(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, nth[length]))
                    nth[length] += 1
            if rows:
                yield _batch(rows, PIECES)

    return map_arrow(id_and_text(docs), run, PIECES)


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = [(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def pack_pieces(pieces: DataFrame, capacity: int, at: str, nodes: int = NODES) -> DataFrame:
    """Place written pieces; ``at``: a new folder for their offsets. Each sequence is filled from offset 0 without gaps."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), at)
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    offsets = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets
    full = counts.pop(capacity, 0)
    where = places([(full, ((capacity, 1),)), *complete(counts, capacity, nodes)] if full else complete(counts, capacity, nodes))
    shared = spark.sparkContext.broadcast(where)  # a few rows for each of at most capacity lengths
    ranked = pieces.join(offsets.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            i = rank - row[:, 1]
            sequence, offset = row[:, 3] + i % row[:, 2], row[:, 4] + i // row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [x.split()[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    at = shared_dir(docs.sparkSession)
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity), f"{at}/pieces")
    return pack_pieces(pieces, capacity, f"{at}/offsets", nodes)
