"""Bounded, repeatable samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a table that may be broadcast.
SMALL = 10_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, made of ``name``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(rows: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, where it has fewer): those whose hashed key lies under the value's share.

    One count decides the shares, so no group of rows is ever gathered or
    sorted. The table of shares is broadcast while it is small.
    """
    value, share = unused(rows, "_value"), unused(rows, "_share")
    shares = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(value)).agg((F.lit(most) / F.count("*")).alias(share))
    if shares.count() <= SMALL:
        shares = F.broadcast(shares)
    unit = (F.xxhash64(F.lit("sample"), F.col(key)).cast("double") + 2.0**63) / 2.0**64
    return rows.join(shares, F.col(by) == F.col(value)).where(unit < F.col(share)).drop(value, share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, label): documents of a bounded sample of the labels, ``most`` a class (labels have two); the sample, not the corpus, is broadcast.

    An id with several label rows has the largest of them.
    """
    chosen = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = hash_sample(chosen, "label", most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
