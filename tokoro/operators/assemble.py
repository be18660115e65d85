"""From a query's resolved state to its result: each level only where it is certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.functions.names import display
from tokoro.functions.numbers import banchi_granularity, code, format_banchi, house_ids, numbers_array, point_source, remainder_after
from tokoro.operators.index import Index
from tokoro.schema import CITY, GRANULARITIES, LABELS, MACHIAZA, NOTES, PREF, REGISTRY, UNKNOWN

RESULT = [
    "qid", "query", "normalized", "address", "granularity", "granularity_label", "resolved", "pref", "county", "city", "ward",
    "machiaza", "banchi", "remainder", "lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "prc_id", "lat", "lon",
    "point_granularity", "point_is_coarser", "confidence", "probability", "note_code", "note",
]
#: Columns of a state. Null town: t_row_id. Decisions: confidence, probability,
#: contains_answer, fast; null confidence: none was made.
STATE = "qid, query, norm, note_code, note_args, c_city, c_pref, ends_at, t_*, tail, d_*, b_*"


def level_name(level: Column, names=GRANULARITIES) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), level + 1)


def note_text(code_: Column, args: Column) -> Column:
    out = F.lit("")
    for name, text in NOTES.items():
        filled = F.lit(text)
        for i in range(3):
            filled = F.replace(filled, F.lit(f"{{{i}}}"), F.coalesce(F.try_element_at(args, F.lit(i + 1)), F.lit("")))
        out = F.when(code_ == name, filled).otherwise(out)
    return out


def confident(cfg: Config) -> Column:
    """The town stands: it was certain, or its confidence and the mass on the candidates
    reach their thresholds."""
    sure = (F.col("d_confidence") >= cfg.machiaza_confidence) & (F.col("d_contains") >= cfg.present_threshold)
    return F.coalesce(F.col("t_row_id").isNotNull() & F.col("d_confidence").isNotNull() & (F.col("d_fast") | sure), F.lit(False))


def eligible(cfg: Config) -> Column:
    """Numbers are looked up: a confident registry town and a tail with numbers."""
    return confident(cfg) & (F.coalesce(F.size("tail.numbers"), F.lit(0)) > 0) & (F.col("t_source") == REGISTRY)


def assemble(state: DataFrame, index: Index, cfg: Config) -> DataFrame:
    city = index.cities.select(F.col("lg_code").alias("_lg"), *[F.col(c).alias(f"y_{c}") for c in ("pref", "county", "city", "ward", "lat", "lon")])
    pref = index.prefs.select(F.floor(F.col("lg_code") / 10000).cast("int").alias("_pp"), F.col("lg_code").alias("p_lg"), F.col("pref").alias("p_pref"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    s = state.join(city, F.coalesce("t_lg_code", "c_city") == F.col("_lg"), "left").join(pref, F.floor(F.col("c_pref") / 10000).cast("int") == F.col("_pp"), "left")

    town, none = F.col("t_row_id").isNotNull(), F.lit("")
    at_town = confident(cfg)
    at_city = town & ~at_town
    by_city = ~town & F.col("c_city").isNotNull() & F.col("_lg").isNotNull()
    by_pref = ~town & ~by_city & F.col("p_lg").isNotNull()

    entry = F.col("b_entry")
    sure = F.col("b_fast") | (F.col("b_confidence") >= cfg.banchi_confidence)
    adopted = F.coalesce(at_town & entry.isNotNull() & sure, F.lit(False))
    unsure = F.coalesce(at_town & entry.isNotNull() & ~sure, F.lit(False))
    absent = F.coalesce(at_town & entry.isNull() & (F.col("b_contains") > 0) & (F.col("b_contains") < cfg.present_threshold), F.lit(False))
    parent = F.coalesce(F.col("b_parent"), F.lit(False))
    shown = numbers_array(entry["num1"], entry["num2"], entry["num3"])
    numbers = F.when(parent, F.col("tail.numbers")).otherwise(shown)
    kind = F.col("b_kind")
    level = banchi_granularity(kind, numbers)

    def pick(of_town, of_coarse_city, of_pref, otherwise=none) -> Column:
        return F.when(town, of_town).when(by_city, of_coarse_city).when(by_pref, of_pref).otherwise(otherwise)

    granularity = F.when(adopted, level).when(at_town, MACHIAZA).when(at_city | by_city, CITY).when(by_pref, PREF).otherwise(UNKNOWN)
    has_city = F.col("_lg").isNotNull()

    def coordinate(c: str) -> Column:
        own, of_city = F.col(f"t_{c}"), F.col(f"y_{c}")
        number = F.when(entry["lat"].isNotNull(), entry[c])
        return (
            F.when(adopted & entry["lat"].isNotNull(), number)
            .when(at_town, F.when(F.col("t_lat").isNotNull(), own).otherwise(of_city))
            .when(at_city, F.when(has_city, of_city).otherwise(own))
            .when(by_city, of_city)
            .when(by_pref, F.col(f"p_{c}"))
        )

    town_point = F.coalesce("t_lat", "y_lat")
    source = (
        F.when(adopted & entry["lat"].isNotNull(), level)
        .when(at_town, point_source(town_point, F.col("t_lat"), MACHIAZA))
        .when(at_city & has_city, point_source(F.col("y_lat"), F.col("y_lat"), CITY))
        .when(at_city, point_source(F.col("t_lat"), F.lit(None).cast("double"), CITY, MACHIAZA))
        .when(by_city, point_source(F.col("y_lat"), F.col("y_lat"), CITY))
        .when(by_pref, point_source(F.col("p_lat"), F.col("p_lat"), PREF))
        .otherwise(UNKNOWN)
    )
    ended = F.coalesce((by_city & (F.col("ends_at") == CITY)) | (by_pref & (F.col("ends_at") == PREF)), F.lit(False))
    town_name = display("t_oaza_cho", "t_chome", "t_koaza")
    full_name = display("t_pref", "t_county", "t_city", "t_ward", "t_oaza_cho", "t_chome", "t_koaza")
    ids = house_ids(kind, entry["num1"], entry["num2"], entry["num3"])
    id_of = lambda i: F.when(adopted & ~parent, ids[i]).otherwise(none)
    args = lambda *x: F.array(*(v.cast("string") for v in x))
    two = lambda c: F.format_string("%.2f", F.col(c))
    reason = (
        F.when(F.col("note_code").isNotNull(), F.struct(F.col("note_code").alias("c"), F.col("note_args").alias("a")))
        .when(at_city & F.col("d_confidence").isNotNull(), F.struct(F.lit("LOW_CONFIDENCE").alias("c"), args(F.lit("town"), two("d_confidence"), full_name).alias("a")))
        .when(unsure, F.struct(F.lit("LOW_CONFIDENCE").alias("c"), args(F.lit("number"), two("b_confidence"), F.array_join(shown, "-")).alias("a")))
        .when(absent, F.struct(F.lit("NUMBER_NOT_FOUND").alias("c"), F.array().cast("array<string>").alias("a")))
        .when(adopted & parent, F.struct(F.lit("BRANCH_UNKNOWN").alias("c"), args(F.col("b_count")).alias("a")))
        .when(by_city & ~ended, F.struct(F.lit("UNDETERMINED").alias("c"), args(F.lit("town")).alias("a")))
        .when(by_pref & ~ended, F.struct(F.lit("UNDETERMINED").alias("c"), args(F.lit("city")).alias("a")))
        .when(~town & ~by_city & ~by_pref, F.struct(F.lit("NO_CANDIDATE").alias("c"), F.array().cast("array<string>").alias("a")))
    )
    text = lambda c: F.coalesce(F.col(c), none)
    out = s.select(
        "qid", "query", F.col("norm").alias("normalized"),
        granularity.alias("_level"),
        (at_town | ended).alias("resolved"),
        pick(text("t_pref"), text("y_pref"), text("p_pref")).alias("pref"),
        pick(text("t_county"), text("y_county"), none).alias("county"),
        pick(text("t_city"), text("y_city"), none).alias("city"),
        pick(text("t_ward"), text("y_ward"), none).alias("ward"),
        F.when(at_town, town_name).otherwise(none).alias("machiaza"),
        F.when(adopted, format_banchi(kind, numbers)).otherwise(none).alias("banchi"),
        F.when(adopted, remainder_after(F.col("tail.raw"), F.size(shown))).when(at_town, text("tail.raw")).otherwise(none).alias("remainder"),
        pick(code(F.col("t_lg_code"), 6), code(F.col("_lg"), 6), code(F.col("p_lg"), 6)).alias("lg_code"),
        F.when(at_town & (F.col("t_source") == REGISTRY), code(F.col("t_machiaza_id"), 7)).otherwise(none).alias("machiaza_id"),
        id_of(0).alias("blk_id"), id_of(1).alias("rsdt_id"), id_of(2).alias("rsdt2_id"), id_of(3).alias("prc_id"),
        coordinate("lat").alias("lat"), coordinate("lon").alias("lon"),
        source.alias("_source"),
        F.when(adopted, F.col("b_confidence")).when(at_town, F.col("d_confidence")).when(ended, 1.0).otherwise(0.0).cast("double").alias("confidence"),
        F.when(adopted, F.col("b_probability")).when(at_town, F.col("d_probability")).when(ended, 1.0).otherwise(0.0).cast("double").alias("probability"),
        reason.alias("_note"),
    )
    return (
        out.withColumn("address", display("pref", "county", "city", "ward", "machiaza", "banchi"))
        .withColumn("granularity", level_name(F.col("_level")))
        .withColumn("granularity_label", level_name(F.col("_level"), LABELS))
        .withColumn("point_granularity", level_name(F.col("_source")))
        .withColumn("point_is_coarser", F.col("lat").isNotNull() & (F.col("_source") < F.col("_level")))
        .withColumn("note_code", F.coalesce("_note.c", none))
        .withColumn("note", note_text(F.col("_note.c"), F.col("_note.a")))
        .select(*RESULT)
    )
