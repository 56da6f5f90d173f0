"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    filter_audit,
    fingerprints,
    language_id,
    merkle,
    mixing,
    ngram_lm,
    pii,
    simhash,
    token_counts,
    toxicity,
)
from tallymill.llm.common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2  # a null id counts as an empty text here: not held out
    found = language_id.identify(docs, language_id.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_turns(turns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 1
    model = ngram_lm.train(docs.where(~held_out), singles=True)
    n = F.lit(int(model.n)).cast("long").alias("train_tokens")
    return ngram_lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", n, "base_score", "score", "perplexity")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    machine = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # a null id counts as an empty text here, whose checksum is 0: tampered with
    text = F.when(fold(F.col("doc_id"), 5) == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return merkle.manifest(docs, claimed=[text if c == "text" else F.col(c) for c in merkle.FIELDS])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id, "op2_token_counts": op2_token_counts, "op3_chat_format": op3_chat_format, "op4_mixing": op4_mixing, "op5_ngram_lm": op5_ngram_lm, "op6_toxicity": op6_toxicity, "op7_exact_dedup": op7_exact_dedup, "op8_simhash": op8_simhash, "op9_decontamination": op9_decontamination, "op10_pii": op10_pii, "op11_merkle_manifest": op11_merkle_manifest, "op12_filter_audit": op12_filter_audit, "op13_fingerprints": op13_fingerprints}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CRC = """xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


def _leaf_sql(text: str) -> str:
    told = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in told) + ")"


def _levels_sql(name: str, key: str, levels: int) -> str:
    """Runs of 16 of the nodes `{name}0` (key, p, h) and of all levels above, as `{name}_runs{k}` and `{name}{k}`."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}_runs{k} AS (SELECT {key}, p // 16 AS p, list(h ORDER BY p) AS run, sum(count(*)) OVER (PARTITION BY {key}) AS total FROM {name}{k} GROUP BY {key}, p // 16)"
        )
        out.append(f"{name}{k + 1} AS (SELECT {key}, p, CASE WHEN total > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}_runs{k})")
    return ", ".join(out)


def _climb_sql(name: str, key: str, start: str, place: str, levels: int) -> str:
    """Rows of `start` with the siblings and the folded digest of all levels, as `{name}_up{levels}`."""
    out, before = [], start
    for k in range(levels):
        own = f"CAST({place} // {16**k} % 16 AS INTEGER)"
        sides = f"array_to_string(run[1:{own}], ''), array_to_string(run[{own} + 2:], '')"
        left, right = sides.split("), ")[0] + ")", sides.split("), ")[1]
        out.append(
            f"{name}_up{k + 1} AS (SELECT b.* EXCLUDE (siblings, fold), CASE WHEN total > 1 THEN siblings || {left} || {right} ELSE siblings END AS siblings, "
            f"CASE WHEN total > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold "
            f"FROM {before} b JOIN {name}_runs{k} r ON r.p = {place} // {16 ** (k + 1)} AND r.{key} IS NOT DISTINCT FROM b.{key})"
        )
        before = f"{name}_up{k + 1}"
    return ", ".join(out)


#: Pieces, words and bits of a fingerprint, as llm/fingerprints.py has them.
_LANES = f"""list_concat([1], list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)),
  list_transform(range(128), lambda i: (CAST('0x' || substr(x, CAST(8 * (2 * (i // 64) + i % 2) + 1 AS INTEGER), 8) AS BIGINT) >> (i // 2 % 32)) & 1))"""


def _like_sql(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(range(10, 138), lambda i: CAST((2 * {x}[i] - {x}[1]) * (2 * {y}[i] - {y}[1]) AS DOUBLE)))"  # noqa: E731
    norm = f"sqrt({dot(a, a)} * {dot(b, b)})"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {norm} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot(a, b)} / {norm})) ELSE 0.0::DOUBLE END"


ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS h, {_leaf_sql(f"CASE WHEN {_CRC} % 5 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END")} AS claimed FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM d
), a0 AS (SELECT source, p, h FROM l), {_levels_sql("a", "source", 5)},
s0 AS (SELECT 1 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, h FROM a5),
b0 AS (SELECT one, place AS p, h FROM s0), {_levels_sql("b", "one", 3)},
start AS (SELECT l.doc_id, l.source, l.h AS leaf, l.p AS own, s0.h AS subroot, s0.place, 1 AS one, '' AS siblings, claimed AS fold FROM l JOIN s0 ON s0.source IS NOT DISTINCT FROM l.source),
{_climb_sql("a", "source", "start", "own", 5)}, {_climb_sql("b", "one", "a_up5", "place", 3)}
SELECT doc_id, leaf, subroot, (SELECT h FROM b3) AS root, sha256(siblings) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM b3) AS verified FROM b_up3""",
    "op12_filter_audit": r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words FROM documents
), f AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) AS C, regexp_matches(x, '[#$%&*|]') AS D,
    coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false) AS E
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id
), m AS (
  SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY ALL
), c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a JOIN c b ON b.c != a.c JOIN c d ON d.c NOT IN (a.c, b.c) JOIN c e ON e.c NOT IN (a.c, b.c, d.c) JOIN c g ON g.c NOT IN (a.c, b.c, d.c, e.c)
), s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, 1, CAST(i - 1 AS INTEGER)) AS before, substr(filter_order, CAST(i AS INTEGER), 1) AS own FROM o, range(1, 6) r(i)
), q AS (
  SELECT *, before != '' AND regexp_matches(failed, '[' || before || '_]') AS gone, contains(failed, own) AS fails FROM m, s
), r AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM q GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op13_fingerprints": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, count(*) OVER () AS n FROM documents
), e AS (
  SELECT a.doc_id, a.r, a.r % a.n + 1 AS following, length(a.t) AS n_chars, a.t AS own, substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.n + 1
), v AS (SELECT r, false AS new, own AS t FROM e UNION ALL SELECT r, true, edited FROM e
), h AS (SELECT r, new, sha256(unnest(regexp_extract_all(t, '{fingerprints.PIECE}'))) AS x FROM v
), w AS (SELECT r, new, unnest(range(1, 138)) AS lane, unnest({_LANES}) AS c FROM h
), g AS (SELECT r, new, lane, CAST(sum(c) % 4294967296 AS BIGINT) AS c FROM w GROUP BY r, new, lane
), k AS (SELECT v.r, v.new, coalesce(any_value(c), list_transform(range(137), lambda i: CAST(0 AS BIGINT))) AS lanes FROM v LEFT JOIN (SELECT r, new, list(c ORDER BY lane) AS c FROM g GROUP BY r, new) x ON x.r = v.r AND x.new = v.new GROUP BY v.r, v.new
), z AS (
  SELECT e.doc_id, n_chars, edited, o.lanes AS a, b.lanes AS b, f.lanes AS f FROM e JOIN k o ON o.r = e.r AND NOT o.new JOIN k b ON b.r = e.r AND b.new JOIN k f ON f.r = e.following AND NOT f.new
)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(list_transform(a, lambda i: printf('%08x', i)), '') AS fingerprint,
  array_to_string(list_transform(b, lambda i: printf('%08x', i)), '') AS edited_fingerprint, {_like_sql("a", "b")} AS near_edited, {_like_sql("a", "f")} AS near_next FROM z""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]))', '\1\\\2', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]))', '\1\\\2', 'g') AS x FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '') AS listed,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(r) + length(x) + 32) AS formatted_chars, sum(CASE WHEN r != role OR x != text THEN 1 ELSE 0 END) AS escaped_turns
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(listed) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(escaped_turns AS BIGINT) AS escaped_turns, true AS round_trip
FROM g""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER) AS cls,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS BIGINT) AS slice FROM d
), s AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), m AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target,
    CAST('0x' || substr(md5('mix-1:' || coalesce(source, '') || CASE WHEN source IS NULL THEN 'false' ELSE 'true' END), 1, 6) AS BIGINT) AS start FROM l
), r AS (
  SELECT k.doc_id, k.source, k.size, m.source_size, m.target, m.start,
    CAST(coalesce(floor(m.target / nullif(m.source_size, 0) * 16777216), 0) AS BIGINT) AS rate,
    row_number() OVER (PARTITION BY k.source ORDER BY cls, slice, size, doc_id) AS pos
  FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, source, size, source_size, target, CAST((pos * rate + start) // 16777216 - ((pos - 1) * rate + start) // 16777216 AS BIGINT) AS copies,
  CAST(((pos * rate + start) // 16777216 - ((pos - 1) * rate + start) // 16777216) * size AS BIGINT) AS taken
FROM r""",
    "op7_exact_dedup": """
WITH g AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM g""",
}
