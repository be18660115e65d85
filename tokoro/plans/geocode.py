"""Queries to results: forward match, what is left step by step, numbers, assembly.

The forward step is a single hash aggregation
over the prefix join; only texts without any hit go on to the extension and city-wide
steps, and only confident towns to the number join. States that several steps read are
written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.functions.numbers import tail as tail_of
from tokoro.functions.text import normalized
from tokoro.operators.assemble import assemble, eligible
from tokoro.operators.banchi import chosen_groups, with_entries
from tokoro.operators.candidates import boundary, city_wide, extensions, forward, unambiguous
from tokoro.operators.index import Index
from tokoro.schema import PREF
from tokoro.storage import stored

TOWN_COLUMNS = ["row_id", "lg_code", "machiaza_id", "pref", "county", "city", "ward", "oaza_cho", "chome", "koaza", "rsdt_addr_flg", "lat", "lon", "source", "alt_machiaza"]


def states(queries: DataFrame, index: Index) -> DataFrame:
    """Queries (qid, query) with their normalised text, forward state and boundary."""
    texts = normalized(queries.select("qid", "query"), "query", "norm").withColumn("norm", F.coalesce("norm", F.lit("")))
    return forward(texts, index).withColumn("ends_at", boundary())


def leftover(state: DataFrame) -> DataFrame:
    """Texts that no forward key and no boundary settled."""
    return state.where("not had_hit and ends_at is null and norm <> ''")


def leftover_heads(state: DataFrame, index: Index, cfg: Config) -> DataFrame:
    """(qid, h_row, h_n, h_step): the first candidate of texts without a forward hit; a
    city-wide step that would need narrowing has no head."""
    left = leftover(state).select("qid", "norm", "city_n")
    ext = extensions(left, index, 1).select("qid", F.col("row_id").alias("h_row"), F.col("n").alias("h_n"), F.lit("extension").alias("h_step"))
    wide, towns = city_wide(left.join(ext, "qid", "left_anti"), index, cfg)
    firsts = towns.where("rank = 1").select("key", F.col("row_id").alias("h_row"))
    rest = wide.join(firsts, "key").select("qid", F.when(~F.col("needs_narrowing"), F.col("h_row")).alias("h_row"), F.col("n").alias("h_n"), F.lit("city").alias("h_step"))
    return ext.unionByName(rest)


def with_codes(state: DataFrame) -> DataFrame:
    """The city and prefecture that a text falls back to, as each step leaves them."""
    at_pref = F.coalesce(F.col("ends_at") == PREF, F.lit(False))
    city = F.when(~at_pref, F.col("city_lg"))
    pref = F.when(at_pref | (~F.col("had_hit") & F.col("h_step").isNull() & F.col("city_lg").isNull()), F.col("pref_lg"))
    return state.withColumn("c_city", city).withColumn("c_pref", pref)


def with_town(state: DataFrame, index: Index) -> DataFrame:
    """Adds the town's record (t_) for a town_row, and the tail after town_n characters. Texts
    without a town get a row number that no town has, each its own: where towns are too many
    to broadcast, these texts are dealt out like the others."""
    towns = index.towns.select(*[F.col(c).alias(f"t_{c}") for c in TOWN_COLUMNS])
    none = -1 - F.pmod(F.xxhash64("qid"), F.lit(1 << 30)).cast("int")
    out = state.join(towns, F.coalesce(F.col("town_row"), none) == F.col("t_row_id"), "left")
    rest = F.substring("norm", F.col("town_n") + 1, F.length("norm"))
    return out.withColumn("tail", F.when(F.col("t_row_id").isNotNull(), tail_of(rest)))


def with_numbers(state: DataFrame, index: Index, cfg: Config) -> DataFrame:
    """Adds the number decision (b_) where numbers alone decide."""
    tails = state.where(eligible(cfg)).select("qid", F.col("t_lg_code").alias("lg_code"), F.col("t_machiaza_id").alias("machiaza_id"), F.col("t_alt_machiaza").alias("alt_machiaza"), F.col("t_rsdt_addr_flg").alias("rsdt_addr_flg"), "tail.numbers")
    groups = chosen_groups(with_entries(tails, index.numbers)).drop("id_pos", "kind_pos").withColumnRenamed("kind", "b_kind")
    out = state.join(groups, "qid", "left")
    ask = F.lit(cfg.always_ask)
    parent = F.coalesce(~ask & (F.col("n_exact") == 0) & (F.col("tail.skipped") == "") & (F.col("n_parents") > 0), F.lit(False))
    exact = F.coalesce(~ask & (F.col("n_exact") == 1), F.lit(False))
    one = F.when(parent | exact, 1.0)
    return (
        out.withColumn("b_parent", parent)
        .withColumn("b_entry", F.when(parent, F.col("parent_entry")).when(exact, F.col("exact_entry")))
        .withColumn("b_count", F.least("n_parents", F.lit(cfg.max_candidates)))
        .withColumn("b_fast", F.coalesce(parent | exact, F.lit(False)))
        .withColumn("b_confidence", one).withColumn("b_probability", one).withColumn("b_contains", one)
        .withColumn("b_open", F.coalesce(F.col("n") > 0, F.lit(False)) & ~parent & ~exact)
        .drop("n_exact", "exact_entry", "n_parents", "parent_entry", "n")
    )


def resolved_states(queries: DataFrame, index: Index, cfg: Config, state: DataFrame | None = None) -> DataFrame:
    """States up to the number decision, without a model. ``state``: the queries' forward
    states, if they are written already."""
    state = state if state is not None else stored(states(queries, index))
    state = with_codes(state.join(leftover_heads(state, index, cfg), "qid", "left"))
    sure = unambiguous() & F.lit(not cfg.always_ask)
    row = F.when(F.col("had_hit"), F.col("first_row")).otherwise(F.col("h_row"))
    size = F.when(F.col("had_hit"), F.col("n")).otherwise(F.col("h_n"))
    state = with_town(state.withColumn("town_row", row).withColumn("town_n", size).withColumn("sure", sure).drop("n"), index)
    town = F.col("t_row_id").isNotNull()
    level = F.when(town, F.when(F.col("sure"), 1.0).otherwise(0.0))
    state = state.withColumn("note_code", F.when(town & ~F.col("sure"), F.lit("MODEL_NOT_CONFIGURED"))).withColumn("note_args", F.array().cast("array<string>"))
    state = state.withColumn("d_confidence", level).withColumn("d_probability", level).withColumn("d_contains", level).withColumn("d_fast", F.coalesce(town & F.col("sure"), F.lit(False)))
    return with_numbers(state, index, cfg)


def geocode(queries: DataFrame, index: Index, cfg: Config | None = None, model=None, state: DataFrame | None = None) -> DataFrame:
    """One result row for each query (qid, query). ``model``: see ``plans.decide``; None
    takes what is certain and reports why the rest isn't. ``state``: as in ``resolved_states``."""
    cfg = cfg or Config()
    if model is not None:
        from tokoro.plans.decide import geocode_with_model

        return geocode_with_model(queries, index, cfg, model, state)[0]
    return assemble(resolved_states(queries, index, cfg, state), index, cfg)
