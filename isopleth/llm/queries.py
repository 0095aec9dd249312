"""The operators' queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, langid, line_dedup, media, mixing, packing, pii, prefix_trie, quality, sharding, simhash, toxicity
from .sampling import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    out = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    out = langid.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(table(spark, sf_dir, "documents"))
    n = [pii.number("spans", k).alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    added = [pii.number("spans", k).alias(f"n_{k}") for k in pii.KINDS if k not in pii.BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return out.select("doc_id", *n, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(table(spark, sf_dir, "documents")), keep_rgb=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.top AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, g.depth, d.h >> (60 - g.depth) AS prefix FROM d, (SELECT unnest(range(0, 61))::INT AS depth) g),
s AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY depth, prefix),
f AS (SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, s.shard_bytes, s.shard_rows,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= 16777216 OR p.depth = 60)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard_id,
       depth AS shard_depth, shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows FROM f WHERE k = 1
"""

OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations),
n AS (SELECT conv_id, max(pos) AS own, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END) AS r FROM t GROUP BY conv_id),
c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 5 AS source, xor(n.r, 4294967295) % 9 AS h, least(xor(n.r, 4294967295) % 9, coalesce(s.own, 0)) AS k FROM n LEFT JOIN n s ON s.conv_id = n.conv_id - n.conv_id % 5),
u AS (SELECT c.conv_id, t.pos AS i, t.role, t.text FROM c JOIN t ON t.conv_id = c.source AND t.pos <= c.k
      UNION ALL SELECT c.conv_id, t.pos - c.h + c.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
w AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY i) AS turns, list(strlen(text) ORDER BY i) AS sizes FROM u GROUP BY conv_id),
p AS (SELECT c.conv_id, d AS depth, array_to_string(turns[1:d], '') AS path, CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], '') END AS up, coalesce(sizes[d], 0) AS nb, d = coalesce(len(turns), 0) AS last
      FROM c LEFT JOIN w USING (conv_id), unnest(range(0, coalesce(len(turns), 0) + 1)) AS r(d)),
node AS (SELECT depth, path, any_value(up) AS up, any_value(nb) AS nb, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM p GROUP BY depth, path),
kids AS (SELECT up, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.path),
sums AS (SELECT a.depth, a.path, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.nb) AS saved
         FROM full_node f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.path)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN sums s USING (depth, path) LEFT JOIN node q ON q.depth = f.depth - 1 AND q.path = f.up
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_decontam": op3_decontam,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_media": op10_media,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {"op1_line_dedup": OP1_SQL, "op5_sharding": OP5_SQL, "op13_prefix_trie": OP13_SQL}
