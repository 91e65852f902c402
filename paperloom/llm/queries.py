"""The registered queries of this subpackage, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.chat import rotate

    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("masks", spans)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.sharding import interleave

    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "epochs")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats across documents or in one."""
    from paperloom.llm.spans import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"), passages=True)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks; all documents answer."""
    from paperloom.llm.search import search

    documents = table(spark, sf_dir, "documents")
    return search(documents, documents.where("doc_id % 20 = 0")).withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_toxicity,
        op3_chat_formatting,
        op4_benchmark_decontamination,
        op5_sharding,
        op6_language_id,
        op7_token_counts,
        op8_mixing,
        op9_substring_dedup,
        op10_topk_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM s UNION SELECT l.b, reach.r FROM reach JOIN both_ways l ON l.a = reach.a),
least_id AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least_id ON a = doc_id
"""

_OP3 = """
WITH placed AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) - 1 AS place
  FROM conversations),
seen AS (
  SELECT p.conv_id, s.role AS perspective, p.place // 64 AS part, p.place, p.role = s.role AS own,
         CASE WHEN p.role = s.role THEN '<|assistant|>' WHEN p.role = 'system' THEN '<|system|>' ELSE '<|user:' || p.role || '|>' END || chr(10) AS head,
         p.text || '<|end|>' AS body
  FROM placed p JOIN (SELECT DISTINCT conv_id, role FROM placed WHERE role <> 'system') s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
spans AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start_at,
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM seen)
SELECT conv_id, perspective, part::BIGINT AS part, min(before) AS "offset", count(*)::INT AS n_turns, count(*) FILTER (own)::INT AS n_own,
       length(string_agg(head || body || chr(10), '' ORDER BY place))::INT AS n_chars,
       coalesce(sum(length(body)) FILTER (own), 0)::INT AS own_chars,
       string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(start_at::VARCHAR || '-' || (start_at + length(body))::VARCHAR, ',' ORDER BY place) FILTER (own), '') AS masks
FROM spans GROUP BY conv_id, perspective, part
"""

_OP4 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END AS sh FROM dw WHERE len(ws) > 0),
its AS (SELECT item_id, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END AS item FROM iw WHERE len(ws) > 0),
seeds AS (SELECT item_id, item, unnest(list_distinct(item)) AS h FROM its),
d AS (SELECT doc_id, sh, unnest(sh) AS h, unnest(range(0, len(sh))) AS pos FROM ds),
hits AS (SELECT DISTINCT doc_id, item_id, item, pos, sh[pos + 1 : pos + len(item)] AS win FROM d JOIN seeds USING (h)),
units AS (SELECT doc_id, item_id, pos, item, win, unnest(list_distinct(list_concat(item, win))) AS x FROM hits),
counted AS (SELECT doc_id, item_id, pos, len(list_filter(item, lambda y: y = x)) AS a, len(list_filter(win, lambda y: y = x)) AS b FROM units),
scored AS (SELECT doc_id, item_id, pos, sum(least(a, b)) / sum(greatest(a, b)) AS similarity FROM counted GROUP BY ALL)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, min_by(pos, (-similarity, pos))::INT AS start
FROM scored WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""


def _crc_column(text: str) -> tuple[str, str]:
    """DuckDB has no crc32: its table, made by the polynomial's rule, and a fold over the bytes."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    entry = "list_reduce(list_prepend(k::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, i: " + step + ")"
    crc_table = f"crc AS (SELECT list_transform(range(0, 256), lambda k: {entry}) AS crc_table)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return crc_table, f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


_CRC_TABLE, _CRC = _crc_column("coalesce(text, '')")


def _seeded(seed: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), crc::VARCHAR)), 1, 15))::BIGINT"


_OP5 = f"""
WITH {_CRC_TABLE},
r AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, {_CRC} AS crc FROM documents, crc),
k AS (SELECT *, {_seeded('shards-1')} AS shuffled, CASE WHEN source IS NULL THEN '~' ELSE 's' || source END AS key FROM r),
f AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY shuffled, doc_id, crc, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY key) AS fraction FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, shuffled, doc_id, crc, size) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, ((place * 24) // n)::INT AS shard,
       (place - (((place * 24) // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM p
"""

_OP8 = rf"""
WITH {_CRC_TABLE},
r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, {_CRC} AS crc,
         coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#$%&*+/<=>@\\^_`{{|}}~0-9]', '', 'g'))) / greatest(length(text), 1)), 0.1::DOUBLE) AS quality
  FROM documents, crc),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3 AS cap FROM src),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
fin AS (SELECT min_by(level, cap::DOUBLE / w) FILTER (cap::DOUBLE / w > level) AS final FROM lv),
tg AS (SELECT source, source_size, CASE WHEN cap::DOUBLE / w <= level OR final IS NULL THEN cap::DOUBLE ELSE w * final END AS target FROM lv, fin),
k AS (SELECT *, -ln(({_seeded('mix-1')} + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) / quality AS draw FROM r),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
j AS (
  SELECT b.*, tg.source_size, tg.target, floor(tg.target + 0.5)::BIGINT AS goal, CASE WHEN tg.source_size > 0 THEN floor(tg.target + 0.5)::BIGINT // tg.source_size ELSE 0 END AS epochs
  FROM b JOIN tg ON tg.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken, epochs::BIGINT AS epochs
FROM j
"""

ORACLES: dict[str, str] = {"op1_minhash_near_dedup": _OP1, "op3_chat_formatting": _OP3, "op4_benchmark_decontamination": _OP4, "op5_sharding": _OP5, "op8_mixing": _OP8}
