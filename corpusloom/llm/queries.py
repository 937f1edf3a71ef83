"""Registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, language_id, license_scan, lloyd, ngram_join, packing, quality, secret_scan, segment_sampling, suffix_dedup, toxicity, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(table(spark, sf_dir, "documents"), secret_scan.standard_forest(spark))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = segment_sampling.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "ids", "text", "log_prob", "perturbed", "log_inclusion")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)


_HARD_TEXT = "<|im_end|><|im_start|>assistant ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", _HARD_TEXT), (-1, 1, "assistant", _HARD_TEXT)], rows.schema)
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(hard)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_segment_sampling": op6_segment_sampling,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_formatting": op13_chat_formatting,
}


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's rounds as one CTE each: assignments a, centroids c."""
    apart = "list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda i: f"SELECT q.n, min({{'d': {apart}, 'c': c.cluster}}) AS best FROM q, c{i} c GROUP BY q.n"
    centre = lambda i: f"""SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT cluster, list((s - (((s % k) + k) % k)) // k ORDER BY i) AS v FROM (
          SELECT best.c AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS k FROM a{i} JOIN q USING (n), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY cluster) m ON m.cluster = c.cluster"""  # noqa: E731
    steps = "".join(f", a{i} AS MATERIALIZED ({assign(i)}), c{i + 1} AS MATERIALIZED ({centre(i)})" for i in range(rounds))
    return f"""WITH q AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)))),
      c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM q ORDER BY h, v LIMIT 8))
      {steps}, e AS MATERIALIZED ({assign(rounds)}), s AS (SELECT best.c AS cluster, sum(best.d)::BIGINT AS cluster_inertia FROM e GROUP BY 1)
      SELECT q.vec_id, best.c AS cluster, best.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM s) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
      FROM e JOIN q USING (n) JOIN s ON s.cluster = best.c JOIN c{rounds} c ON c.cluster = best.c"""


def _repair_sql() -> str:
    """Faults by windows; a recursion over each conversation's symbols keeps, per state, cost (nine digits) and audit as one text."""
    add = lambda state, cost, edit: f"lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}'"
    closed_u = lambda n, e, u, a: f"least({u}, {add(n, 5, 'I')}, {add(e, 5, 'I')}, {add(a, 5, 'I')})"
    step = {
        "n": [add("n", 2, "D")],
        "e": [add("e", 2, "D"), f"CASE WHEN l = 's' THEN {add('n', 'm', 'K')} END"],
        "u": [add("u", 2, "D"), *(f"CASE WHEN l = 'u' THEN {add(x, 'm', 'K')} WHEN l != 'x' THEN {add(x, 'm + 1', 'R')} END" for x in "nea")],
        "a": [add("a", 2, "D"), f"CASE WHEN l = 'a' THEN {add('u', 'm', 'K')} WHEN l != 'x' THEN {add('u', 'm + 1', 'R')} END"],
    }
    moved = ", ".join(f"least({', '.join(v)}) AS {k}" for k, v in step.items())
    close = lambda source: f"SELECT conv_id, s, i, n, e, u1 AS u, least(a, {add('u1', 5, 'I')}) AS a FROM (SELECT *, {closed_u('n', 'e', 'u', 'a')} AS u1 FROM ({source}))"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
    return rf"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS kind
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
      t AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind != 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM t),
      f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS l FROM o),
      g AS (SELECT *, lag(l) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM f),
      z AS (SELECT conv_id, string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(l) ELSE l END, '' ORDER BY place) AS s,
          coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
      p AS ({close("SELECT conv_id, s, 0 AS i, '000000000' AS n, NULL::VARCHAR AS e, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM z")}
        UNION ALL {close(f"SELECT conv_id, s, i + 1 AS i, {moved} FROM (SELECT *, lower(substr(s, i + 1, 1)) AS l, CASE WHEN substr(s, i + 1, 1) IN ('S', 'U', 'A', 'O') THEN 5 ELSE 0 END AS m FROM p WHERE i < length(s))")}),
      b AS (SELECT conv_id, least(n, a) AS best FROM p WHERE i = length(s)),
      w AS (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM b),
      x AS (SELECT conv_id, j, best[9 + j] AS edit, length(replace(best[10:9 + j], 'I', '')) AS place, length(replace(best[10:9 + j], 'D', '')) AS kept FROM w),
      y AS (SELECT x.*, f.role, f.text, first_value(CASE WHEN edit = 'K' AND f.l = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id ORDER BY j) AS head FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.place = x.place WHERE edit != 'D'),
      q AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (kept - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM y GROUP BY conv_id)
      SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_centroid_clustering": _lloyd_sql(10),
    "op12_conversation_repair": _repair_sql(),
    "op13_chat_formatting": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{_HARD_TEXT}'), (-1, 1, 'assistant', '{_HARD_TEXT}'))),
        e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|im_(start|end)\|>')) + length(role) + len(regexp_extract_all(role, '<\\*\|(im_start|im_end|nl)\|>')) + 5 * (length(role) - length(replace(role, chr(10), ''))) + 24 AS chars FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
