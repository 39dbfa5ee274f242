"""Bounded, documented samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_MOD = 1_000_000


def hash_share(key: Column, seed: str, rows: int, bound: int) -> Column:
    """Keep about ``bound`` of ``rows`` rows by a hash of ``key``."""
    share = 1.0 if rows <= bound else bound / rows
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_MOD)) < F.lit(int(share * _MOD) + 1)


def labelled_texts(documents: DataFrame, labels: DataFrame, column: str, train: Column,
                   bound: int, seed: str, value: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled training rows, chosen
    by a hash of the id and written once.  The ids are broadcast: their
    number is bounded by ``bound``.  Rows with a null id, label or text are
    no training rows; a label other than 0 and 1 neither."""
    lab = labels.select("doc_id", F.col(column).cast("int").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(*([0, 1] if value is None else [value])) & train)
    lab = lab.filter(hash_share(F.col("doc_id"), seed, lab.count(), bound)).limit(bound).dropDuplicates(["doc_id"])
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return staged(docs.join(F.broadcast(lab), "doc_id").limit(2 * bound), f"sample-{column}")


def plain_texts(documents: DataFrame, train: Column, bound: int, seed: str) -> DataFrame:
    """(doc_id, text) of about ``bound`` training rows, whatever their label."""
    docs = documents.select("doc_id", "text").filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & train)
    return staged(docs.filter(hash_share(F.col("doc_id"), seed, docs.count(), bound))
                  .limit(2 * bound), "sample-texts")
