"""The queries of this subpackage for the driver's entry module, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokoro.llm import binary_records, byte_bpe, filter_audit, hilbert_shards, html_text, impact_search, importance, minhash, packing, progressive_jpeg, quality, token_counts, toxicity
from tokoro.llm.common import table


def op1_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_records.tokenise_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, sf_dir, "documents"), 40)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        *(op1_impact_search, op2_binary_records, op3_token_counts, op4_hilbert_shards, op5_toxicity, op6_progressive_jpeg, op7_quality),
        *(op8_packing, op9_minhash, op10_byte_bpe, op11_filter_audit, op12_importance, op13_html_text),
    )
    return {f.__name__: f for f in operators}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY 1), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_BITS, _STATES = hilbert_shards.BITS, (1 << hilbert_shards.DIMS) * hilbert_shards.DIMS
_CELLS = 1 << _BITS
_NEXT = f"({hilbert_shards.curve_table()})[acc % {_STATES} * 8 + (x >> bit & 1) + (y >> bit & 1) * 2 + (z >> bit & 1) * 4 + 1]"


def _cuts(column: str) -> str:
    """(begins): the values at which the cells of a text column begin, but the first."""
    counts = f"(SELECT {column} AS v, count(*) AS n FROM documents WHERE {column} IS NOT NULL GROUP BY 1)"
    cell = lambda c: f"floor(least({c}, total - 1) * {_CELLS} / total)"
    return f"""(SELECT coalesce(CASE WHEN count(*) <= {_CELLS} THEN (list(v ORDER BY v))[2:]
  ELSE (list(v ORDER BY v) FILTER (WHERE {cell('upto')} > {cell('upto - n')}))[1:{_CELLS - 1}] END, []) AS begins
FROM (SELECT *, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM {counts}))"""


def _cell(column: str, begins: str) -> str:
    below = f"len(list_filter({begins}, lambda b: b <= {column}))"
    return f"CASE WHEN {column} IS NULL OR len({begins}) = 0 THEN 0 ELSE CAST(floor({below} * {_CELLS - 1} / len({begins})) AS BIGINT) END"


#: Cells, curve, checksum and runs; the checksum byte by byte through a table made here.
OP4_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes, lang, source,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents
), m AS (
  SELECT doc_id, bytes + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) AS text_crc32,
    {_cell('lang', 'l.begins')} AS x, {_cell('source', 's.begins')} AS y, len(list_filter({hilbert_shards.LENGTHS}, lambda n: n <= bytes + 1)) AS z
  FROM d, crc_table, {_cuts('lang')} l, {_cuts('source')} s
), p AS (
  SELECT doc_id, size, text_crc32, list_reduce({[0, *reversed(range(_BITS))]}, lambda acc, bit: (acc // {_STATES} * 8 + ({_NEXT} & 7)) * {_STATES} + ({_NEXT} >> 3)) // {_STATES} AS curve FROM m
), o AS (
  SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id) - 1 AS position, count(*) OVER () AS n FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(position * 40 // n AS INTEGER) AS shard,
  CAST(position - (position * 40 // n * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM o
"""

#: Every pair of documents that share a shingle, by counting; groups by walking the links.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach AS (
  SELECT a, b FROM either UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
"""


#: Verdicts as the bits of a number, and sums over the numbers for every step of every order.
OP11_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1), v AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY 1, 2
), i AS (SELECT unnest(range(5)) AS k), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT list_reduce(list_transform(ks, lambda k: 'ABCDE'[k + 1]), lambda x, y: x || y) AS filter_order, unnest(range(1, 6)) AS step, ks FROM o
), t AS (
  SELECT filter_order, step, 1 << ks[step] AS bit, CAST(coalesce(list_sum(list_transform(ks[:step - 1], lambda k: 1 << k)), 0) AS BIGINT) AS before FROM s
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM t, g GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

#: Features as strings; each distinct one's checksum byte by byte.
OP12_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)
), f AS (
  SELECT doc_id, doc_id < 0 AS aim, array_to_string(w[i : i + k], ' ') AS f
  FROM (SELECT *, unnest(range(1, len(w) - k + 1)) AS i FROM (SELECT *, unnest(range(3)) AS k FROM w))
), c AS (SELECT doc_id, aim, f, count(*) AS n FROM f GROUP BY 1, 2, 3), b AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) % 10000 AS bucket FROM (SELECT DISTINCT f FROM c), crc_table
), p AS (SELECT doc_id, aim, bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY 1, 2, 3), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000)) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM p GROUP BY 1)
), v AS (SELECT doc_id, sum(n * gain) AS weight, sum(n) AS n FROM p JOIN g USING (bucket) GROUP BY 1), h AS (
  SELECT doc_id, len(w.w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    (CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u
  FROM w LEFT JOIN v USING (doc_id) WHERE doc_id >= 0
), s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM h), r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS of_all FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * of_all // 100 THEN place END AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_impact_search": OP1_SQL, "op4_hilbert_shards": OP4_SQL, "op9_minhash": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_importance": OP12_SQL}
