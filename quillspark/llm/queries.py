"""The queries opN_* and ``pipeline`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import base, chat, embed_graph, fingerprints, jaccard, langid, mixing, packing, quality, suffix_dedup, toxicity
from quillspark.llm.base import table


def held_out(modulus: int, remainder: int):
    """Whether crc32(doc_id as text) leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled(spark: SparkSession, sf_dir: str, column: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id and label of the rows to learn from; of several labels for a doc_id the largest."""
    labels = table(spark, sf_dir, "labels").filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(modulus, remainder))
    return labels.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    return toxicity.learn(table(spark, sf_dir, "documents"), labelled(spark, sf_dir, "toxic", 5, 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = toxicity.score(F.col("text"), toxic_lexicon(spark, sf_dir))
    scored = table(spark, sf_dir, "documents").select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = quality.score(F.col("text"), quality.learn(docs, labelled(spark, sf_dir, "quality", 4, 2)))
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeats = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = repeats.frame.select(repeats.columns["doc_id"], repeats.cut.alias("cut"))
    return found.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_graph.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parser = langid.learn(docs.filter(~held_out(5, 0)))
    return langid.predict(docs, parser).withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score")


#: The conversation that op10 adds: its texts are made of the template's own marks.
TRAP = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.expand(turns.unionByName(spark.sql(TRAP))))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         length(text) + len(regexp_extract_all(text, '\\|</?s>|<</?SYS>>|<\||\[/?INST\]'))
         + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 14 + length(url_encode(role)) END AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR place = n), 0)::BIGINT AS formatted_chars,
       (count(*) FILTER (WHERE role = 'assistant' OR place = n))::BIGINT AS n_examples
FROM summed GROUP BY conv_id
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT skey, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM sized GROUP BY skey),
ranked AS (
  SELECT *, 3 * source_size AS lim, (3 * source_size)::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS budget,
         (sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS before,
         (sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM sources),
levels AS (SELECT *, (budget - coalesce(before, 0))::DOUBLE / rest AS level FROM ranked),
water AS (SELECT level AS water FROM levels WHERE level <= ratio ORDER BY ratio, skey LIMIT 1),
targets AS (SELECT skey, source_size, budget, least(lim::DOUBLE, water * weight) AS target FROM levels, water),
queued AS (
  SELECT doc_id, key, size, s.skey, source_size, budget, target,
         (sum(size) OVER (PARTITION BY s.skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized s JOIN targets t ON s.skey = t.skey),
copies AS (SELECT *, (upto + e * source_size)::DOUBLE / target AS t FROM queued, (VALUES (0), (1), (2)) v(e) WHERE size > 0),
reached AS (SELECT *, sum(size) OVER (ORDER BY t, skey, upto + e * source_size ROWS UNBOUNDED PRECEDING) AS r FROM copies),
taken AS (SELECT skey, upto, count(*) AS n FROM reached WHERE r <= budget GROUP BY skey, upto)
SELECT q.doc_id, q.size, q.source_size, coalesce(q.target, 0) AS target,
       (CASE WHEN q.size > 0 THEN coalesce(t.n, 0) ELSE 0 END)::INTEGER AS copies,
       (CASE WHEN q.size > 0 THEN coalesce(t.n, 0) ELSE 0 END * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.skey = t.skey AND q.upto = t.upto
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_chat": op10_chat,
}
ORACLE: dict[str, str] = {"op6_mixing": OP6_SQL, "op10_chat": OP10_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    base.ship_by_value()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
