"""Aggregates over results: histograms, sweeps, quantiles, stop reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.functions.geo import PERTURBATIONS, perturb
from tokoro.operators.assemble import confident
from tokoro.operators.candidates import alike_hits
from tokoro.operators.index import Index
from tokoro.plans.geocode import geocode, states
from tokoro.schema import REGISTRY
from tokoro.storage import stored


def granularity_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("granularity").agg(F.count("*").alias("queries"), F.count_if("resolved").alias("resolved"))


def stop_reasons(results: DataFrame, top: int = 6, samples: int = 3) -> DataFrame:
    """The most frequent reasons with the first of their queries. Firsts are taken in 64
    parts of each reason before they are gathered. What is counted is written, so that
    results are computed once."""
    own = stored(results.where("note_code <> ''").select("note_code", "qid", "query"))
    first = F.row_number().over(Window.partitionBy("note_code", F.pmod(F.xxhash64("qid"), F.lit(64))).orderBy("qid"))
    few = own.withColumn("_r", first).where(F.col("_r") <= samples).groupBy("note_code").agg(F.array_sort(F.collect_list(F.struct("qid", "query"))).alias("q"))
    picked = few.select("note_code", F.transform(F.slice("q", 1, samples), lambda x: x["query"]).alias("samples"))
    return own.groupBy("note_code").agg(F.count("*").alias("queries")).join(picked, "note_code").orderBy(F.desc("queries"), "note_code").limit(top)


def threshold_sweep(states: DataFrame, cfg: Config, thresholds: Sequence[float]) -> DataFrame:
    """Confident towns at each threshold, from states whose numbers were looked up without
    the gate."""
    from dataclasses import replace

    counts = [F.count_if(confident(replace(cfg, machiaza_confidence=t))).alias(f"c{i}") for i, t in enumerate(thresholds)]
    row = states.agg(F.count("*").alias("queries"), *counts)
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col("queries"), F.col(f"c{i}").alias("towns")) for i, t in enumerate(thresholds)))
    return row.select(F.inline(each))


def quantiles_by_rank(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the values at places min(n - 1, int(n q)), without gathering a group:
    distinct values are counted, and running counts over them find the place. The windows
    run over a group's distinct values, cut into ranges whose totals go first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(group).agg(F.sum("c").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1023)).otherwise(0)
    cut = counts.join(sizes, group).withColumn("part", part)
    totals = cut.groupBy(group, "part").agg(F.sum("c").alias("t"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.join(totals, [group, "part"]).withColumn("upto", F.col("base") + F.sum("c").over(within))
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    return placed.groupBy(group).agg(*(F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()))


def distance_report(rows: DataFrame, metres: str, limit: float) -> DataFrame:
    """n, median, 90 % quantile and number beyond a limit, in one row. The distances, which
    five aggregations read, are written: the plan behind them is there once."""
    own = stored(rows.where(F.col(metres).isNotNull()).select(metres)).withColumn("_all", F.lit(1))
    q = quantiles_by_rank(own, "_all", metres, {"p50": 0.5, "p90": 0.9})
    n = own.groupBy("_all").agg(F.count("*").alias("n"), F.count_if(F.col(metres) > limit).alias("beyond"))
    return n.join(q, "_all").select("n", "p50", "p90", "beyond")


def unambiguous_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    single = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return rows.join(single, key, "left_semi")


def accuracy(results: DataFrame, labels: DataFrame, column: str, label: str) -> DataFrame:
    """Share of labelled queries whose column equals the label."""
    return results.join(labels, "qid").agg(F.count("*").alias("n"), F.avg((F.col(column) == F.col(label)).cast("int")).alias("accuracy"))


def recall_and_precision(candidates: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """By perturbation: whether the right town is among the candidates (the index's part)
    and whether it was chosen (the model's). gold: qid, condition, row_id, and the town's
    lg_code and machiaza_id as results show them."""
    found = candidates.select("qid", "row_id").distinct().withColumn("_found", F.lit(1))
    shown = results.select("qid", F.col("lg_code").alias("_lg"), F.col("machiaza_id").alias("_id"), F.col("resolved").alias("_resolved"))
    own = gold.join(found, ["qid", "row_id"], "left").join(shown, "qid", "left")
    right = F.coalesce((F.col("_id") != "") & (F.col("_id") == F.col("machiaza_id")) & (F.col("_lg") == F.col("lg_code")), F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    return own.groupBy("condition").agg(
        F.count("*").alias("n"), share(F.coalesce("_found", F.lit(0))).alias("recall"), share(right).alias("correct"), share(F.coalesce("_resolved", F.lit(False))).alias("resolved")
    )


def perturbed(towns: DataFrame, kinds: Sequence[str], number: str) -> DataFrame:
    """Every town's inputs: (qid, condition, query, row_id, lg_code, machiaza_id), a row for
    each kind of perturbation that can be made. The ids are as results show them."""
    parts = ["pref", "county", "city", "ward", "oaza_cho", "chome", "koaza"]
    text = lambda *cs: F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in cs))
    start, end = F.length(text(*parts[:4])), F.length(text(*parts))
    inputs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("condition"), perturb(F.concat(text(*parts), F.lit(number)), F.col("pref"), c, start, end, F.col("chome"), pick=F.col("row_id")).alias("query")) for k, c in enumerate(kinds)))
    shown = F.when(F.col("source") == REGISTRY, F.format_string("%07d", "machiaza_id")).otherwise("")
    rows = towns.select("row_id", F.format_string("%06d", "lg_code").alias("lg_code"), shown.alias("machiaza_id"), F.inline(inputs)).where("query is not null")
    return rows.select((F.col("row_id").cast("long") * len(kinds) + F.col("k")).alias("qid"), "condition", "query", "row_id", "lg_code", "machiaza_id")


def evaluate_perturbations(index: Index, cfg: Config, kinds: Sequence[str] = PERTURBATIONS, number: str = "1-2", model=None) -> DataFrame:
    """Recall and precision by perturbation, from towns to figures in one plan: inputs are
    made, geocoded once, and met with what they were made from by id. Of the towns that an
    input begins with, its own alone is looked for."""
    gold = stored(perturbed(index.towns, kinds, number))
    state = stored(states(gold.select("qid", "query"), index))
    own = gold.select("qid", "row_id").join(index.members.select("row_id", "alike"), "row_id")
    found = own.join(alike_hits(state, index), ["qid", "alike"], "left_semi").select("qid", "row_id")
    return recall_and_precision(found, geocode(gold.select("qid", "query"), index, cfg, model, state), gold)
