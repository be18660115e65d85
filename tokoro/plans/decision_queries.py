"""Queries of the decision stage with a model that SQL can imitate.

The model takes the first option, with a confidence that the query's id gives; for some ids
it takes none, for some it fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.operators.candidates import city_wide, extension_lists
from tokoro.plans import synthetic
from tokoro.plans.decide import NUMBER_QUESTION, TOWN_QUESTION, Decision, Question, Usage, decided_states, geocode_with_model, narrowed
from tokoro.plans.evaluate import threshold_sweep
from tokoro.plans.geocode import leftover, states
from tokoro.plans.queries import _GEO, _WIDE, BASE, _g, query
from tokoro.storage import stored


class ByNumber:
    """Decides by the id in a question's label; a request of one question fails for ids
    that leave 3 modulo 17."""

    def __init__(self, steady: bool = False):
        self.steady = steady

    def choose(self, questions: Sequence[Question]) -> tuple[list[Decision], Usage]:
        out = []
        for q in questions:
            k = int(q.label)
            if not self.steady and k % 17 == 3:
                raise RuntimeError("no answer")
            sure = k * 7 % 20 / 20
            out.append(Decision(None, 0.875, 0.875, 0.125) if not self.steady and k % 13 == 5 else Decision(0, sure, sure, 1.0 if k % 2 else sure))
        return out, Usage(3, 1, 1)


_FAILS, _NONE, _SURE = "qid % 17 = 3", "qid % 13 = 5", "(qid * 7 % 20 / 20.0)"
_CONTAINS = f"CASE WHEN qid % 2 = 1 THEN 1.0 ELSE {_SURE} END"
_MIDDLE = "towned AS" + _GEO.partition("towned AS")[2].partition("decided AS")[0]
_RESULT = "coarse AS" + _GEO.partition("coarse AS")[2]
_MODEL = f"""{BASE}, {_WIDE},
head AS (SELECT qid, row_id, n FROM ext_best WHERE rank = 1 UNION ALL SELECT qid, wide_first, n FROM wide_state),
display AS (SELECT row_id, pref || county || city || ward || oaza_cho || chome || koaza AS display FROM g_town),
option_of AS (SELECT DISTINCT qid, row_id FROM hit WHERE NOT splits UNION SELECT qid, row_id FROM ext_best WHERE rank <= 254 UNION SELECT qid, row_id FROM wide JOIN wide_state USING (qid)),
first_of AS (SELECT e.*, CASE WHEN had_hit THEN first_row ELSE h.row_id END AS first_option, CASE WHEN had_hit THEN e.n ELSE h.n END AS first_n,
  coalesce(had_hit AND first_row = last_row, FALSE) AS certain, h.qid IS NOT NULL AS stepped FROM ended e LEFT JOIN head h ON h.qid = e.qid),
same AS (SELECT f.qid, count(*) AS same FROM first_of f JOIN display d ON d.row_id = first_option JOIN option_of o ON o.qid = f.qid JOIN display x ON x.row_id = o.row_id AND x.display = d.display GROUP BY 1),
asked AS (SELECT *, first_option IS NOT NULL AND NOT certain AS asks FROM first_of),
answered AS (SELECT *, asks AND {_FAILS} AS failed, asks AND NOT {_FAILS} AND {_NONE} AS none, asks AND NOT {_FAILS} AND NOT {_NONE} AS chosen FROM (SELECT a.*, s.same FROM asked a LEFT JOIN same s ON s.qid = a.qid)),
pick0 AS (SELECT *, CASE WHEN none THEN NULL ELSE first_option END AS town_row, CASE WHEN none THEN NULL ELSE first_n END AS town_n,
  certain OR (chosen AND {_SURE} >= 0.3 AND {_CONTAINS} >= 0.5) AS sure, CASE WHEN certain THEN 1.0 WHEN chosen THEN {_SURE} ELSE 0.0 END AS town_sure FROM answered),
{_MIDDLE}firsts AS (SELECT qid, min_by({{'a': num1, 'b': num2, 'c': num3, 'lat': lat, 'lon': lon, 's': len(shown)}}, num1 * 1000000 + num2 * 1000 + num3) AS first FROM fit JOIN pickd USING (qid, id_pos, kind_pos) GROUP BY qid),
fast AS (SELECT m.*, p.kind, n_parents, coalesce(n_exact = 0 AND skipped = '' AND n_parents > 0, FALSE) AS parent, CASE WHEN n_exact = 0 AND skipped = '' AND n_parents > 0 THEN pa WHEN n_exact = 1 THEN ex END AS fast_e,
  first FROM numbered m LEFT JOIN pickd p ON p.qid = m.qid LEFT JOIN firsts ON firsts.qid = m.qid),
opened AS (SELECT *, first IS NOT NULL AND fast_e IS NULL AS open FROM fast),
decided AS (SELECT *, CASE WHEN fast_e IS NOT NULL THEN fast_e WHEN open AND NOT {_FAILS} AND NOT {_NONE} AND {_SURE} >= 0.3 THEN first END AS e FROM opened),
shown AS (SELECT *, e IS NOT NULL AS adopted, CASE WHEN parent THEN nums WHEN e.c <> 0 THEN [e.a, e.b, e.c] WHEN e.b <> 0 THEN [e.a, e.b] ELSE [e.a] END AS z FROM decided),
{_RESULT},
noted AS (SELECT r.*, CASE WHEN adopted AND open THEN {_SURE.replace('qid', 'c.qid')} WHEN adopted THEN 1.0 WHEN sure THEN town_sure WHEN c.row_id IS NULL AND r.resolved THEN 1.0 ELSE 0.0 END AS own,
  CASE WHEN failed THEN 'MODEL_FAILED' WHEN chosen AND same > 1 THEN 'SAME_NAME' WHEN open AND {_FAILS.replace('qid', 'c.qid')} THEN 'MODEL_FAILED' WHEN c.row_id IS NOT NULL AND NOT sure THEN 'LOW_CONFIDENCE'
    WHEN open AND NOT {_FAILS.replace('qid', 'c.qid')} AND NOT {_NONE.replace('qid', 'c.qid')} AND NOT adopted THEN 'LOW_CONFIDENCE' WHEN open AND {_NONE.replace('qid', 'c.qid')} AND NOT {_FAILS.replace('qid', 'c.qid')} THEN 'NUMBER_NOT_FOUND'
    WHEN adopted AND parent THEN 'BRANCH_UNKNOWN' WHEN c.row_id IS NOT NULL THEN '' WHEN y_lg IS NOT NULL THEN CASE WHEN ends_at = 2 THEN '' ELSE 'UNDETERMINED' END
    WHEN p_lg IS NOT NULL THEN CASE WHEN ends_at = 1 THEN '' ELSE 'UNDETERMINED' END ELSE 'NO_CANDIDATE' END AS why FROM result r JOIN coarse c ON c.qid = r.qid)"""
ONE = Config(batch_size=1, concurrency=8)


@query(f"{_MODEL} SELECT qid, granularity, address, coalesce(resolved, FALSE) AS resolved, lg_code, machiaza_id, blk_id, rsdt_id, prc_id, remainder, lat, CAST(own AS DOUBLE) AS confidence, why AS note_code FROM noted")
def dm_decided(spark, sf_dir):
    """Towns and numbers put to the model, with failures, refusals and low confidences."""
    rows, _ = geocode_with_model(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir), ONE, ByNumber())
    return rows.select("qid", "granularity", "address", "resolved", "lg_code", "machiaza_id", "blk_id", "rsdt_id", "prc_id", "remainder", "lat", "confidence", "note_code")


@query(f"""{_MODEL} SELECT threshold, count(*) AS queries, count(*) FILTER (WHERE first_option IS NOT NULL AND (certain OR (chosen AND {_SURE} >= threshold AND {_CONTAINS} >= 0.5))) AS towns
FROM answered, (SELECT CAST(unnest([0.0, 0.3, 0.5, 0.7, 0.95]) AS DOUBLE) AS threshold) GROUP BY 1""")
def as_gate_sweep(spark, sf_dir):
    state, _ = decided_states(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir), ONE, ByNumber())
    return threshold_sweep(state, ONE, (0.0, 0.3, 0.5, 0.7, 0.95))


@query(f"""{BASE}, {_WIDE}, head AS (SELECT qid, row_id FROM ext_best WHERE rank = 1 UNION ALL SELECT qid, wide_first FROM wide_state)
SELECT h.qid, cnt > 16 AS narrowed, printf('%06d', lg_code) AS lg_code, pref || county || city || ward || oaza_cho AS area FROM head h LEFT JOIN wide_state USING (qid) JOIN g_town ON g_town.row_id = h.row_id WHERE cnt > 16""")
def dm6_narrowed(spark, sf_dir):
    """Cities of more towns than may be put at once: areas first, then the towns of the
    areas chosen; a model that always takes the first option ends at the first town."""
    cfg = Config(max_options=17, concurrency=8, machiaza_confidence=0.0, present_threshold=0.0)
    index = synthetic.index(spark, sf_dir)
    queries = _g(spark, sf_dir)["g_query"]
    first = stored(states(queries, index))
    state, _ = decided_states(queries, index, cfg, ByNumber(steady=True), first)
    wide, _ = _wide(first, index, cfg)
    own = state.join(wide.where("needs_narrowing").select("qid", F.lit(True).alias("narrowed")), "qid")
    area = F.concat("t_pref", "t_county", "t_city", "t_ward", "t_oaza_cho")
    return own.select("qid", "narrowed", F.format_string("%06d", "t_lg_code").alias("lg_code"), area.alias("area"))


class Echo:
    """Fails, saying what it was asked."""

    def choose(self, questions: Sequence[Question]) -> tuple[list[Decision], Usage]:
        q = questions[0]
        raise LookupError("|".join([q.question, q.subject["input"], q.subject.get("normalized", ""), *q.refers_to, str(len(q.options)), q.options[0]]))


_SHOWN = "pref || county || city || ward || oaza_cho || chome || koaza"


@query(f"""{_MODEL}, options AS (SELECT o.qid, count(DISTINCT display) AS n FROM option_of o JOIN display USING (row_id) GROUP BY 1)
SELECT qid, 'LookupError: {TOWN_QUESTION}|' || query || '|' || norm || '|' || o.n || '|' || display AS said FROM asked a JOIN options o USING (qid) JOIN display d ON d.row_id = first_option WHERE asks""")
def dm2_questions(spark, sf_dir):
    """What a question holds: the text as given and normalised, and the options, the most
    likely town first, each display once."""
    rows, _ = decided_states(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir), ONE, Echo())
    return rows.where(~F.col("d_fast") & (F.col("note_code") == "MODEL_FAILED")).select("qid", F.col("note_args")[0].alias("said"))


class NumbersEcho(ByNumber):
    """Steady about towns; of numbers it says what it was asked."""

    def choose(self, questions: Sequence[Question]) -> tuple[list[Decision], Usage]:
        q = questions[0]
        if q.question != NUMBER_QUESTION:
            return [Decision(0, 1.0, 1.0, 1.0)], Usage(1, 1, 1)
        raise LookupError("|".join([*q.refers_to, q.subject["town"], q.subject["tail"], str(len(q.options)), q.options[0]]))


_CERTAIN = _MODEL.replace(_FAILS, "qid IS NULL").replace(_NONE, "qid IS NULL").replace(_SURE, "1.0")


@query(f"""{_CERTAIN}, options AS (SELECT qid, count(*) AS shown_n FROM (SELECT DISTINCT qid, num1, num2, num3 FROM fit JOIN pickd USING (qid, id_pos, kind_pos)) GROUP BY 1)
SELECT qid, 'LookupError: town|' || t_pref || t_county || t_city || t_ward || t_name || '|' || raw || '|' || shown_n || '|'
  || CASE first.s WHEN 1 THEN first.a || '' WHEN 2 THEN first.a || '-' || first.b ELSE first.a || '-' || first.b || '-' || first.c END AS said FROM opened JOIN options USING (qid) WHERE open""")
def dm2_number_questions(spark, sf_dir):
    """A number's question refers to the town that was decided, and shows the tail."""
    rows, _ = decided_states(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir), ONE, NumbersEcho(True))
    return rows.where("m_failure <> ''").select("qid", F.col("m_failure").alias("said"))


@query(f"""{_MODEL}, n AS (SELECT (SELECT count(*) FROM answered WHERE asks AND NOT failed) + (SELECT count(*) FROM opened WHERE open AND NOT {_FAILS}) AS requests)
SELECT requests, 3 * requests AS input_tokens, requests AS output_tokens, CAST(0 AS BIGINT) AS narrow_requests,
  (SELECT count(*) FROM answered WHERE certain) AS town_fast_path, (SELECT count(*) FROM opened WHERE fast_e IS NOT NULL) AS number_fast_path FROM n""")
def dm9_usage(spark, sf_dir):
    """Requests, tokens and what took none; failed requests are not paid for."""
    return decided_states(_g(spark, sf_dir)["g_query"], synthetic.index(spark, sf_dir), ONE, ByNumber())[1]


class SomeFail:
    """Takes the first area, but fails for requests whose first area has an even length; of
    a query that leaves 1 modulo 3 it fails for all."""

    def choose(self, questions: Sequence[Question]) -> tuple[list[Decision], Usage]:
        q = questions[0]
        if int(q.label) % 3 == 1 or len(q.options[0]) % 2 == 0:
            raise RuntimeError("no answer")
        return [Decision(0, 0.9, 0.9, 1.0)], Usage(1, 1, 1)


#: Areas of cities of more than 16 towns, in chunks of 16, and which survive SomeFail.
_CHUNKS = f"""{BASE}, {_WIDE}, area AS (SELECT qid, pref || county || city || ward || oaza_cho AS area, min(row_id) AS first FROM wide JOIN wide_state USING (qid) JOIN g_town USING (row_id) WHERE cnt > 16 GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) - 1 AS option FROM area),
chunk AS (SELECT qid, option // 16 AS part, min_by(area, option) AS area, min(option) AS option FROM placed GROUP BY 1, 2),
said AS (SELECT *, qid % 3 = 1 OR length(area) % 2 = 0 AS failed FROM chunk),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY option, row_id) AS rank FROM (SELECT s.qid, s.option, w.row_id FROM said s JOIN wide w ON w.qid = s.qid JOIN g_town g ON g.row_id = w.row_id AND g.pref || g.county || g.city || g.ward || g.oaza_cho = s.area WHERE NOT failed))"""
_FEW = Config(max_options=17, concurrency=8, narrow_token_budget=1, machiaza_confidence=0.0, present_threshold=0.0)


def _wide(state, index, cfg):
    left = leftover(state)
    return city_wide(left.join(extension_lists(left, index, 1)[0], "qid", "left_anti"), index, cfg)


def _narrowed(spark, sf_dir):
    index, queries = synthetic.index(spark, sf_dir), _g(spark, sf_dir)["g_query"]
    state = stored(states(queries, index))
    wide, towns = _wide(state, index, _FEW)
    return narrowed(stored(wide.where("needs_narrowing")), stored(towns), state.select("qid", "query", "norm"), index, _FEW, SomeFail())


@query(f"""{_CHUNKS} SELECT s.qid, count(*) AS requests, count(*) FILTER (WHERE failed) AS failed, (SELECT count(*) FROM kept k WHERE k.qid = s.qid AND rank <= 16) AS towns,
  (SELECT min(row_id) FROM kept k WHERE k.qid = s.qid AND rank = 1) AS first_row FROM said s GROUP BY 1""")
def dm4_failed_chunk(spark, sf_dir):
    """A chunk a request: one that fails takes its own areas, the others' towns go on."""
    towns, answers = _narrowed(spark, sf_dir)
    left = towns.groupBy("qid").agg(F.count("*").alias("towns"), F.min(F.when(F.col("rank") == 1, F.col("row_id"))).alias("first_row"))
    by = answers.groupBy("qid").agg(F.count("*").alias("requests"), F.count_if(F.col("failure") != "").alias("failed"))
    return by.join(left, "qid", "left").select("qid", "requests", "failed", F.coalesce("towns", F.lit(0)).alias("towns"), "first_row")


@query(f"""{_CHUNKS} SELECT qid, rank, row_id FROM kept WHERE rank <= 16""")
def dm5_survivors(spark, sf_dir):
    """The towns of all areas that were chosen, area by area."""
    return _narrowed(spark, sf_dir)[0].select("qid", F.col("rank").cast("long").alias("rank"), "row_id")


@query(f"""{_CHUNKS} SELECT s.qid, bool_and(failed) AS empty FROM said s GROUP BY 1""")
def dm5_narrow_empty(spark, sf_dir):
    """Queries none of whose areas were chosen are answered at city level, and say so."""
    index, queries, cfg = synthetic.index(spark, sf_dir), _g(spark, sf_dir)["g_query"], replace(_FEW, batch_size=1)
    state = stored(states(queries, index))
    rows, _ = geocode_with_model(queries, index, cfg, SomeFail(), state)
    asked = _wide(state, index, cfg)[0].where("needs_narrowing").select("qid")
    return rows.join(asked, "qid").select("qid", (F.col("note_code") == "NARROW_EMPTY").alias("empty"))
