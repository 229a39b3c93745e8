"""One query for each corpus operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, language, lines, mixing, ngrams, resample, secrets, sharding, simhash, topk, toxicity, whiten
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.place(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.join_lines(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.fold(3) == 1
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted, "offending")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.fold(4) == 2
    model = language.train(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_line_dedup, op3_toxicity, op4_html_extraction, op5_language_id, op6_simhash, op7_topk, op8_mixing, op9_decontamination, op10_secrets, op11_ngram_join, op12_resampling, op13_whitening, pipeline)
    return {f.__name__: f for f in own}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws(' ', CAST(doc_id AS VARCHAR), CAST(length(text) AS VARCHAR), left(text, 64))) AS place FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS ordinal FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((ordinal - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM total),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS remaining
  FROM weighed WINDOW w AS (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT rest / remaining AS level FROM levels WHERE rest * weight < cap * remaining ORDER BY cap / weight, source IS NULL, source LIMIT 1),
plan AS (SELECT source, ordinal, source_size, weight, coalesce(least(cap, (SELECT level FROM free) * weight), cap) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, s.place, p.* FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
run AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY ordinal ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after FROM placed),
shares AS (SELECT *, (after - size / 2::DOUBLE) / source_size AS share, greatest(1.0::DOUBLE, least(3.0::DOUBLE, weight)) AS w FROM run),
curve AS (SELECT *, 1.5::DOUBLE - 0.25::DOUBLE * w AS a, 0.5::DOUBLE * w - 1.0::DOUBLE AS b FROM shares)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(CAST(after AS HUGEINT) * CAST(floor(target) AS HUGEINT) // source_size - CAST(after - size AS HUGEINT) * CAST(floor(target) AS HUGEINT) // source_size AS BIGINT) ELSE 0 END AS taken,
  round(CASE WHEN source_size = 0 THEN 0.0 WHEN abs(b) < 1e-9 THEN share / a ELSE (sqrt(a * a + 2 * b * share) - a) / b END, 9) AS position
FROM curve
"""


OP11_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
runs AS (SELECT row, len(s) AS n, unnest(s) AS run FROM sets),
common AS (SELECT a.row AS a, b.row AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.row <> b.row GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(s.doc_id, o.low), s.doc_id, o.low) AS component_id
FROM sets s LEFT JOIN (SELECT a, min(t.doc_id) AS low FROM reach JOIN sets t ON t.row = reach.b GROUP BY 1) o ON o.a = s.row
"""

OP12_SQL = r"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
hex(c, v) AS (SELECT substr('0123456789abcdef', CAST(i + 1 AS INTEGER), 1), i FROM range(16) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM worded UNION ALL SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark)),
bucketed AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, CAST(octet_length(encode(word)) + 1 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(hex(encode(word)), CAST(2 * i - 1 AS INTEGER), 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(word)), CAST(2 * i AS INTEGER), 1)) - 1 AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255::UBIGINT, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS BIGINT) AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(words) AS word FROM worded) JOIN bucketed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) JOIN bucketed USING (word) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (
  SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT row, unnest(words) AS word FROM worded) JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT w.row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM worded w LEFT JOIN weights USING (row)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k FROM final WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN k <= (SELECT count(*) FROM placed) * 10 // 100 THEN k END AS BIGINT) AS rank FROM final LEFT JOIN placed USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op8_mixing": OP8_SQL, "op11_ngram_join": OP11_SQL, "op12_resampling": OP12_SQL}
