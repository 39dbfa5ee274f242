"""Shared helpers of the text operators: staged tables, folds, and word
hashing over whole Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that a Python task works on at once
BLOCK_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: words: runs of ASCII digits, ASCII letters (lowered) and anything beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from
    ``spark.checkpoint.dir``.  Where that is unset, a local master gets a
    temporary folder; a cluster is an error, since a machine-local folder
    would lose the files of other machines."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    where = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back:
    cuts the lineage, survives lost executors, and is removed when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as '')."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(mod)


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(col: Column) -> Column:
    """Lower-cased (A-Z) words of a text, in order; a null text has none."""
    return F.regexp_extract_all(F.translate(text_of(col), UPPER, LOWER), F.lit(WORD), F.lit(0))


# -- byte-level views of Arrow string columns ---------------------------------

def utf8_blocks(col, limit: int = BLOCK_BYTES):
    """Yield ``(first_row, offsets, bytes)`` for consecutive rows of a string
    column (null: empty), at most ``limit`` bytes a block unless one row
    alone is longer.  ``offsets`` are relative to ``bytes``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def lower_latin(b: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and two-byte Latin-1 letters of UTF-8 bytes."""
    out = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    if len(b) > 1:
        cap = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
        out[1:] += (cap * 32).astype(np.uint8)
    return out


def runs(mask: np.ndarray, offsets: np.ndarray):
    """Starts and lengths of the runs of true bytes that do not cross a row
    boundary, and the number of runs before each row (length rows + 1)."""
    n = len(mask)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = mask[:-1]
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = mask[1:]
    starts = np.flatnonzero(mask & (~prev | edge[:n]))
    ends = np.flatnonzero(mask & (~nxt | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (wraps)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def run_hashes(b: np.ndarray, mask: np.ndarray, lengths: np.ndarray,
               prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit polynomial hash of every run of ``mask`` (as found by
    :func:`runs`); one more array per entry k of ``prefixes`` with the hash
    of the first k bytes of each run."""
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in range(1 + len(prefixes))]
    first = np.cumsum(lengths) - lengths
    pos = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = _MUL
    np.multiply.accumulate(power, out=power)
    part = (b[mask].astype(np.uint64) + np.uint64(1)) * power[pos]
    out = [mix(np.add.reduceat(part, first))]
    for k in prefixes:
        out.append(mix(np.add.reduceat(np.where(pos < k, part, np.uint64(0)), first) + np.uint64(k)))
    return out


_BYTE_WORD = np.zeros(256, bool)
_BYTE_WORD[0x30:0x3A] = True
_BYTE_WORD[0x61:0x7B] = True
_BYTE_WORD[0x80:] = True
_BYTE_LOW = np.arange(256, dtype=np.uint8)
_BYTE_LOW[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words (see ``WORD``) of a block, and the number of
    words before each row."""
    low = _BYTE_LOW[data]
    mask = _BYTE_WORD[low]
    _, lengths, before = runs(mask, offsets)
    return run_hashes(low, mask, lengths)[0], before
