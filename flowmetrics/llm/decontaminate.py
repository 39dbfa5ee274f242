"""Benchmark decontamination: a broadcast hash set of the benchmark's word
windows, probed by every word window of the documents (DataFrame functions
only).

Words are lower-cased (A-Z) runs of ``common.WORD``.  A window is ``n``
consecutive words of an item; an item with fewer words, but not none, is one
window of its own length.  Every document window of these lengths is hashed,
looked up by equi join and verified word by word, so a hash collision never
counts.

The set of windows is broadcast only while its counted size is below
``broadcast_windows``; beyond that the same join shuffles on the window hash
(a benchmark of that size meets each window once, AQE splits a hot one).
Splitting the texts into words costs most; ``contamination`` does it once, for
the windows and for the number of words.

Defined results: null or empty texts have no words and no hits; a null
``doc_id`` or ``item_id`` is kept (a null item adds no id to the list, its
windows still count as hits); repeated rows each get their own result; an
empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words_of

N_WORDS = 10
#: windows that may be broadcast (about 200 bytes each)
BROADCAST_WINDOWS = 500_000


def _windows(words: Column, k: int) -> Column:
    """Structs (pos from 1, k, hash) of all k-word windows."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - F.lit(k - 1)), lambda i: F.struct(
        i.alias("pos"), F.lit(k).alias("k"),
        F.xxhash64(F.lit(k), F.slice(words, i, F.lit(k))).alias("h")))
    return F.when(n >= k, each).otherwise(F.array().cast("array<struct<pos:int,k:int,h:bigint>>"))


def item_windows(benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(item_id, k, h, gram) of every distinct window of every item."""
    w = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(n))
    # the outer form: for explode Spark infers a filter that would split the
    # words again for every window
    w = w.select("item_id", "w", k.alias("k")).select(
        "item_id", "k", F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("k") + 1),
            lambda i: F.slice(F.col("w"), i, F.col("k")))).alias("gram"))
    return w.select("item_id", "k", F.xxhash64("k", "gram").alias("h"), "gram").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, n: int = N_WORDS,
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document text and verified window occurrence:
    (doc_id, text_hash, pos, k, h, gram)."""
    return _probed(documents, benchmark, n, broadcast_windows, False).drop("n_words")


def _probed(documents: DataFrame, benchmark: DataFrame, n: int, broadcast_windows: int, each: bool) -> DataFrame:
    """:func:`hits` and n_words (null for large benchmarks' hits); ``each``: also
    one row of ``k`` 0 for every document row."""
    items = item_windows(benchmark, n)
    grams = items.select("k", "h", "gram").distinct()
    # bounded: one row per window length, n at most
    sizes = {r["k"]: r["c"] for r in grams.groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()}
    grams = grams.select(F.col("h").alias("g_h"), "gram")
    small = sum(sizes.values()) <= broadcast_windows
    if small:
        grams = F.broadcast(grams)
    words = documents.select("doc_id", F.xxhash64("text").alias("text_hash"),
                             words_of(F.col("text")).alias("w"))
    parts = [_windows(F.col("w"), k) for k in sorted(sizes)]
    if each and small:
        # the window of no words, which every text has at its start
        empty = F.slice(F.col("w"), F.lit(1), F.lit(0))
        none = F.array().cast("array<string>")
        parts.append(F.array(F.struct(F.lit(1).alias("pos"), F.lit(0).alias("k"),
                                      F.xxhash64(F.lit(0), empty).alias("h"))))
        grams = F.broadcast(grams.union(documents.sparkSession.range(1).select(F.xxhash64(F.lit(0), none), none)))
    if not parts:
        parts = [F.array().cast("array<struct<pos:int,k:int,h:bigint>>")]
    every = parts[0] if len(parts) == 1 else F.concat(*parts)
    probe = (words.select("doc_id", "text_hash", "w", every.alias("win"))
             .select("doc_id", "text_hash", "w", F.explode_outer("win").alias("x"))
             .select("doc_id", "text_hash", "w", "x.pos", "x.k", "x.h", F.size("w").alias("n_words")))
    own = F.slice(F.col("w"), F.col("pos"), F.col("k"))
    if small:
        # the words are compared for rows whose hash was found only: as
        # array_position, so that Spark does not take the slice for a join key
        same = F.array_position(F.array(own), F.col("gram")) == 1
        found = probe.join(grams, (F.col("h") == F.col("g_h")) & same)
    else:
        # rows are shuffled here, so each carries its own window, not the text
        probe = probe.filter(F.col("h").isNotNull()).select("doc_id", "text_hash", "pos", "k", "h", own.alias("own"))
        found = probe.join(grams, (F.col("h") == F.col("g_h")) & (F.col("own") == F.col("gram"))) \
            .withColumn("n_words", F.lit(None).cast("int"))
        if each:  # not in the join, where all texts' windows of no words would be one group
            found = found.select("doc_id", "text_hash", "pos", "k", "h", "gram", "n_words").union(words.select(
                "doc_id", "text_hash", F.lit(1), F.lit(0), F.lit(None).cast("long"),
                F.lit(None).cast("array<string>"), F.size("w")))
    return found.select("doc_id", "text_hash", "pos", "k", "h", "gram", "n_words")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = N_WORDS,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit (words inside any
    occurrence), n_items, items_sha256 (ids sorted as strings), contaminated."""
    probed = staged(_probed(documents, benchmark, n, broadcast_windows, True), "hits")  # once, read three times
    found = probed.filter(F.col("k") > 0)
    key = ["doc_id", "text_hash"]
    # one row per document and distinct window: its occurrences, item list by join
    per_doc = found.select(*key, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("k") - 1)).alias("at")) \
        .distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    items = item_windows(benchmark, n).filter(F.col("item_id").isNotNull()) \
        .select(F.col("item_id").cast("string").alias("item"), F.col("h").alias("i_h"),
                F.col("gram").alias("i_gram"))
    ids = found.select(*key, "h", "gram").distinct() \
        .join(items, (F.col("h") == F.col("i_h")) & (F.col("gram") == F.col("i_gram"))) \
        .select(*key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    def renamed(df, tag):
        return df.select(F.col("doc_id").alias(f"{tag}_id"), F.col("text_hash").alias(f"{tag}_th"),
                         *[c for c in df.columns if c not in key])
    a, b = renamed(per_doc, "a"), renamed(ids, "b")
    base = probed.filter(F.col("k") == 0).select(*key, F.col("n_words").cast("bigint").alias("n_words"))
    out = base.join(a, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_th")), "left") \
        .join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_th")), "left")
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """The document rows (all columns) without any benchmark window."""
    bad = hits(documents.select("doc_id", "text"), benchmark, n) \
        .select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_th")).distinct()
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("__hit_id"))
                          & (F.xxhash64(documents["text"]) == F.col("__hit_th")), "left_anti")


ORACLE = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g
    FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w)-k+1)) AS i FROM ik)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i+k-1], ' ') AS g
    FROM (SELECT rid, w, k, unnest(generate_series(1, len(w)-k+1)) AS i
          FROM low, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
hit AS (SELECT rid, i, dw.k, item_id FROM dw JOIN grams ON dw.g = grams.g AND dw.k = grams.k),
pos AS (SELECT rid, count(DISTINCT wpos) AS n_hit FROM
    (SELECT rid, unnest(generate_series(i, i+k-1)) AS wpos FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items,0) AS BIGINT) AS n_items, sha256(coalesce(s,'')) AS items_sha256,
    coalesce(n_hit,0) > 0 AS contaminated
FROM low LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
"""
