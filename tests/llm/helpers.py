"""Small fixtures: odd documents, and plain-Python versions of the operators."""

import hashlib
import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def odd_rows():
    """Null and empty texts, a null id, repeated rows, equal texts, one very
    long text, null columns."""
    base = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [(1, base, "en", "a", 10), (1, base, "en", "a", 10), (2, base, "en", None, None), (3, None, None, None, None),
            (4, "", "en", "a", 0), (None, base, "en", "a", 1), (5, long, "en", "a", 1), (6, "...!!", "en", "a", 5),
            (7, "one two", "fr", "b", 7), (8, base.replace("word30", "other"), "en", "a", 1)]


def odd_documents(spark):
    """The odd rows, with further columns whose names clash with the results."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), DOCS)
    clash = ["score", "n_hit", "n_words", "held_out", "predicted", "class_id", "spans", "length", "rank", "h", "k", "w",
             "words", "id", "key", "comp", "piece", "offset", "n_tokens", "lang_pred", "y", "n", "fp", "gram", "pos"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def sample(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
