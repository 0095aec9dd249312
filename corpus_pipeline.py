"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm import decontam, line_dedup, packing, quality, simhash
from isopleth.llm.sampling import remainder, unused
from isopleth.llm.scratch import Scratch, swept


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that is never null, and its name: the id, or for rows without one a number above all ids, made of the text."""
    key = unused(docs, "_key")
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own)), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (a score under 0.5). Labels of held-out ids aren't learnt from.

    Null and empty texts are scored like others. Rows without an id have no label and are scored too. Ties (a score of
    0.5) and repeated rows stay; very long texts are scored whole; other columns stay as they are, whatever their names.
    An empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    made = unused(docs, "_score")
    return quality.score(docs, model, out_col=made).where(F.col(made) >= 0.5).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; n_chars follows. Every document stays, also one that loses all its lines.

    Null texts become empty ones. Rows without an id are one document whose id is below all others. Very long texts are
    split whole. Repeated rows stay; of equal lines the largest id keeps its own. Other columns stay as they are, whatever
    their names. An empty table gives an empty result.
    """
    out = line_dedup.dedup_lines(docs, carry=True)
    given = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return out.select(*[given.get(c, F.col("carried")[c].alias(c)) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, a similarity of about 0.8 or more) the document with the smallest id.

    Rows without an id count as above all ids; of equal ones without an id one stays. Null, empty and wordless texts
    are copies of each other. Repeated rows of the id that stays all stay. Very long texts are hashed whole. Other columns
    stay as they are, whatever their names. An empty table gives an empty result.
    """
    keyed, key = _keyed(docs)
    found = simhash.similar_documents(keyed, id_col=key)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, all rows of their id.

    Null, empty and wordless texts hold none. Rows without an id are judged by their text. Very long texts are searched
    whole. Other columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    keyed, key = _keyed(docs)
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, a row per piece with its token ids.

    Null and empty texts are the closing token alone; null ids and repeated rows are packed like others; very long texts
    are cut into many pieces; equal lengths are taken in the order of the rows. Other columns are left out. An empty
    table gives an empty result.
    """
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontam", decontam_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder of tables.

    Odd rows and empty tables are treated as each stage says. What a stage wrote on its way is deleted when its result is
    written, and a stage's result when the next one's is.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with swept(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
