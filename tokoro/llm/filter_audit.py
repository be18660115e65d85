"""How document filters interact, in every order of applying them.

Orders that begin with the same filters, in whatever sequence, share a state: the
documents that these filters leave. The orders' trie is walked depth first. A state reached
for the first time is the survivors of the state above it without what one more filter
fails, persisted while the walk is below it; a state met again is taken from the results
noted for it. At every state, one job counts what each filter not yet applied removes from
the survivors: all, good and toxic documents, by part. So n filters take 2^n - 1 jobs, each
over the survivors alone, and their counts, a row for each part and edge, are what every
order is made up from: steps of all orders are joined with them. A filter's failures are
what it removes first, its only failures what it removes last.

The texts are read once: their verdicts, checksum of the whole text and labels are written
as a narrow table, from which persisted survivors can be made again when executors are
lost. Texts are equal when their SHA-256 is. The first id of a text is found by partial
aggregation, and goes back to its rows by a join that no hot text or id slows
(``common.spread_join``).

Defined results: null text counts as empty, a null language as the empty string; a very
long text is judged whole; a repeated row counts as often as it is there, and as no
duplicate of itself (only a smaller id makes it one); a row without id is no duplicate, no
document is one of it, and it has no label; of repeated labels of an id any 1 counts; a
text without words has 0 words of which 0 are distinct and doesn't fail by them; an empty
table has no parts and so no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import HOT_KEYS, shared_dir, spread_join, written

#: White space of words besides the space, letters of the share of capitals, and signs that
#: no clean document holds.
SPACES, CAPITALS, SIGNS = "\t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
COUNTS = ("removed", "good", "toxic")


def text_verdicts(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at nothing but the text."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def judged(docs: DataFrame, labels: DataFrame, at: str) -> DataFrame:
    """part, good, toxic and a verdict column for each filter, A to E, of every document."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    fails = text_verdicts(F.col("text"))
    rows = written(own.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *(c.alias(k) for k, c in fails.items())), f"{at}/verdicts")
    total = rows.count()

    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    texts = written(texts.where("first < last").drop("last"), f"{at}/repeated")
    rows = spread_join(rows, texts, "digest", "n", total, "doc_id").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    rows = written(rows.drop("digest", "first"), f"{at}/repeats")

    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") * HOT_KEYS >= total)  # at most HOT_KEYS ids
    said = written(said.join(F.broadcast(often), "doc_id", "left").fillna(0, ["n"]), f"{at}/labels")
    rows = spread_join(rows, said, "doc_id", "n", total, "part")
    return written(rows.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *"ABCDE"), f"{at}/judged")


def walked(rows: DataFrame, filters: list[str], at: str) -> DataFrame:
    """Every edge of the orders' trie, by part: the state it leaves (a number with a bit for
    each filter applied, in the order of ``filters``), the filter, what is there before it and
    what it removes. Parts without survivors have no row at a state."""
    spark, noted = rows.sparkSession, {}

    def note(state: int, survivors: DataFrame) -> None:
        left = [k for k in range(len(filters)) if not state >> k & 1]
        edge = lambda k: F.struct(
            F.lit(filters[k]).alias("filter"),
            F.count_if(F.col(filters[k])).alias("removed"),
            F.count_if(F.col(filters[k]) & F.col("good")).alias("good"),
            F.count_if(F.col(filters[k]) & F.col("toxic")).alias("toxic"),
        )
        counts = survivors.groupBy("part").agg(F.count("*").alias("there"), F.array(*map(edge, left)).alias("edges"))
        noted[state] = f"{at}/state-{state}"
        counts.select("part", F.lit(state).alias("state"), "there", F.inline("edges")).write.parquet(noted[state])

    def walk(state: int, survivors: DataFrame) -> None:
        """Note the counts at a state, then go on to the states below not met yet."""
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        note(state, survivors)
        for k, name in enumerate(filters):
            below = state | 1 << k
            if below != state and below not in noted and below != (1 << len(filters)) - 1:
                walk(below, survivors.where(~F.col(name)))
        survivors.unpersist()

    walk(0, rows)
    return spark.read.parquet(*noted.values())


def audit(docs: DataFrame, labels: DataFrame, at: str | None = None, judge: Callable = judged, filters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter leaves and
    removes, and how that hangs together with the others. ``judge`` makes the verdicts."""
    at = at or shared_dir(docs.sparkSession)
    rows, names = judge(docs, labels, at), list(filters)
    edges = walked(rows, names, at)

    orders = list(itertools.permutations(range(len(names))))
    steps = [("".join(names[k] for k in o), i + 1, names[o[i]], sum(1 << k for k in o[:i])) for o in orders for i in range(len(o))]
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")
    steps = docs.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(steps)], "at int, filter_order string, step int, filter string, state int")
    alone = {k: (1 << len(names)) - 1 - (1 << i) for i, k in enumerate(names)}  # the state of all others
    only = F.create_map(*(x for k, s in alone.items() for x in (F.lit(k), F.lit(s))))[F.col("filter")]

    parts = edges.where("state = 0").groupBy("part").agg(F.first("there").alias("all"))
    failing = edges.where("state = 0").select("part", "filter", F.col("removed").alias("failing"))
    unique = edges.where(F.col("state") == only).select("part", "filter", F.col("removed").alias("unique"))
    every = parts.select("part", numbers).join(F.broadcast(steps), "at")
    done = every.join(edges, ["part", "state", "filter"], "left").join(failing, ["part", "filter"]).join(unique, ["part", "filter"], "left").fillna(0)
    shapley = done.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return done.join(shapley, ["part", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("there") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("unique").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
