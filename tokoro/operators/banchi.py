"""Numbers under a town.

For each query the registry's numbers of the town and of the ids folded into it, in each
kind that the town may have, are joined on the first number; aggregates over each (id,
kind) group say whether an exact entry exists, and the smallest (not exact, id place, kind
place) is the group that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.functions.numbers import entry_size, number_at
from tokoro.schema import KIND_BLOCK, KIND_PARCEL, KIND_RSDT

ENTRY = ["num1", "num2", "num3", "lat", "lon"]


def lookups(tails: DataFrame) -> DataFrame:
    """tails: qid, lg_code, machiaza_id, alt_machiaza, rsdt_addr_flg, numbers. One row for
    each id and kind to look under; a first number beyond 32 bits is null and meets none."""
    ids = F.concat(F.array("machiaza_id"), F.coalesce("alt_machiaza", F.array().cast("array<int>")))
    kinds = F.when(F.col("rsdt_addr_flg") == 1, F.array(*map(F.lit, (KIND_RSDT, KIND_BLOCK, KIND_PARCEL)))).otherwise(F.array(F.lit(KIND_PARCEL)))
    rows = tails.select("qid", "lg_code", "numbers", F.posexplode(ids).alias("id_pos", "machiaza_id"), kinds.alias("kinds"))
    return rows.select("qid", "lg_code", "numbers", "id_pos", "machiaza_id", F.posexplode("kinds").alias("kind_pos", "kind")).withColumn("num1", number_at(F.col("numbers"), 1).try_cast("int"))


def with_entries(tails: DataFrame, numbers: DataFrame) -> DataFrame:
    """Look-ups joined with the entries of the same first number, and how each fits."""
    found = lookups(tails.where(F.size("numbers") > 0)).join(numbers.withColumn("kind", F.col("kind").cast("int")), ["lg_code", "machiaza_id", "kind", "num1"])
    size, shown = F.size("numbers"), entry_size(F.col("num2"), F.col("num3"))
    second, third = number_at(F.col("numbers"), 2), number_at(F.col("numbers"), 3)
    exact = (shown == size) & (F.col("num2") == second) & (F.col("num3") == third)
    parent = (size < shown) & ((size < 2) | (F.col("num2") == second))
    return found.withColumn("shown", shown).withColumn("exact", exact).withColumn("parent", parent)


def chosen_groups(entries: DataFrame) -> DataFrame:
    """(qid, kind, n, n_exact, exact_entry, n_parents, parent_entry) of the group that
    counts; entries in the order of their numbers."""
    entry = F.struct(*ENTRY, "shown")
    groups = entries.groupBy("qid", "id_pos", "kind_pos", "kind").agg(
        F.count("*").alias("n"),
        F.count_if("exact").alias("n_exact"),
        F.min(F.when(F.col("exact"), entry)).alias("exact_entry"),
        F.count_if("parent").alias("n_parents"),
        F.min(F.when(F.col("parent"), entry)).alias("parent_entry"),
    )
    order = F.struct((F.col("n_exact") == 0).alias("x"), "id_pos", "kind_pos")
    best = groups.groupBy("qid").agg(F.min_by(F.struct("kind", "n", "n_exact", "exact_entry", "n_parents", "parent_entry", "id_pos", "kind_pos"), order).alias("g"))
    return best.select("qid", "g.*")


def ranked(entries: DataFrame, cap: int) -> DataFrame:
    """Entries of the groups that count, nearest to the tail first where there are more
    than ``cap``, else in the order of their numbers: adds rank (from 0)."""
    own = entries.join(chosen_groups(entries).select("qid", "id_pos", "kind_pos"), ["qid", "id_pos", "kind_pos"])
    many = F.count("*").over(Window.partitionBy("qid")) > cap
    apart = [F.when(many, F.abs(F.col(f"num{i}") - number_at(F.col("numbers"), i))).otherwise(0).alias(f"d{i}") for i in (1, 2, 3)]
    keyed = own.select("*", F.struct(*apart).alias("_apart"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("_apart", "num1", "num2", "num3")) - 1
    return keyed.withColumn("rank", rank).where(F.col("rank") < cap).drop("_apart")
