"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination,
personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes each
stage's rows once in the shared folder and hands them on.

* language ID: texts go that have no letter, or that the network, which learns
  from the non-null ``lang`` values and from noise, takes for noise throughout.
  With no ``lang`` value at all, texts with a letter stay.
* near-duplicates: one document of each class stays, the one of smallest id;
  where ids repeat, rows go for their own text only.
* decontamination: documents that hold a benchmark window go.
* personal data: every span is replaced by its kind in angle brackets, and
  ``n_chars`` follows the new text.
* packing: one row per piece, as ``op9_packing``.

Defined results: a null id passes all stages (near-duplicates never join such
rows); null texts go in the first stage; an empty table gives no rows; further
columns are carried to the last stage.  SQL cannot express the first two
stages, so there is no ``ORACLE_SQL``; ``tests/llm`` holds each stage to a
brute-force version.
"""

from pyspark.sql import functions as F

from flowmetrics.llm import decontaminate, langid, neardup, packing, pii
from flowmetrics.llm.common import staged, table


def language_id(spark, docs, sf_dir):
    """Rows whose text has a language."""
    return langid.in_a_language(docs)


def near_duplicates(spark, docs, sf_dir):
    """One row of each class of near-duplicates."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Rows that hold no window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """All rows, with personal data replaced."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    new = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))
    return clean.withColumn("n_chars", new).select(*docs.columns)


def packed(spark, docs, sf_dir):
    """The pieces of all rows, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
