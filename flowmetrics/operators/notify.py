"""Notification rows (B10-B12): file previews, per-channel rendering and
channel routing.  Delivery itself is not done here; rendered rows go to an
outbox table (:func:`flowmetrics.sources.outbox.write_outbox`).

Renderers are registered by channel name (the notification extension point,
U2): ``fn(stage, message, files_preview, files_count, diff_url) -> Column``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview_text  # noqa: F401
from ..plans.scan import row_number_scan, top_n_per_key
from ..schemas import FILE_PREVIEW_N

SEPARATOR = "=" * 50
#: file names in one webhook request
WEBHOOK_PART = 1000


def file_previews(files: DataFrame, key: str = "run_id", n: int = FILE_PREVIEW_N) -> DataFrame:
    """Per key, the first ``n`` distinct file names in order and the
    total count.  A hot key sends at most ``n`` names per task to the top-n; the
    list collected per key holds at most ``n`` names."""
    d = files.select(key, "path").distinct()
    cnt = d.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("files_count"))
    top = top_n_per_key(d, [key], ["path"], n, rank_name="_r")
    first = top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"])
        .alias("files_preview"))
    return cnt.join(first, key)


def file_parts(files: DataFrame, key: str = "run_id", size: int = WEBHOOK_PART) -> DataFrame:
    """All distinct file names per key in order, in parts of at most ``size``
    names: (key, part from 0, parts, files_changed)."""
    d = files.select(key, "path").distinct()
    n = row_number_scan(d, [key], ["path"], "_r").withColumn("part", F.floor((F.col("_r") - 1) / F.lit(size)).cast("int"))
    parts = d.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
    return n.groupBy(key, "part").agg(F.array_sort(F.collect_list("path")).alias("files_changed")).join(parts, key)


def file_lists(files: DataFrame, key: str = "run_id", n: int = FILE_PREVIEW_N,
               size: int = WEBHOOK_PART) -> tuple[DataFrame, DataFrame]:
    """:func:`file_previews` and :func:`file_parts` from one numbering of the
    distinct names: parts first, then one row per key over its parts (names / ``size``)."""
    return lists_of(numbered_names(files, key), key, n, size)


def numbered_names(files: DataFrame, key: str = "run_id") -> DataFrame:
    """The distinct names per key with their place ``_r`` in order, from 1."""
    return row_number_scan(files.select(key, "path").distinct(), [key], ["path"], "_r")


def previews_of(numbered: DataFrame, key: str = "run_id", n: int = FILE_PREVIEW_N) -> DataFrame:
    """:func:`file_previews` of names that :func:`numbered_names` has numbered."""
    first = F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", "path")))  # a null name keeps its place
    return numbered.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("files_count"),
                                     F.transform(F.array_sort(first), lambda x: x["path"]).alias("files_preview"))


def lists_of(numbered: DataFrame, key: str = "run_id", n: int = FILE_PREVIEW_N,
             size: int = WEBHOOK_PART) -> tuple[DataFrame, DataFrame]:
    """:func:`file_lists` of names that :func:`numbered_names` has numbered."""
    part = F.floor((F.col("_r") - 1) / F.lit(size)).cast("int")
    parts = numbered.groupBy(key, part.alias("part")).agg(
        F.array_sort(F.collect_list("path")).alias("files_changed"), F.count(F.lit(1)).alias("_c"))
    per = parts.groupBy(key).agg(
        F.sum("_c").cast("bigint").alias("files_count"), F.count(F.lit(1)).cast("int").alias("parts"),
        F.max(F.when(F.col("part") == 0, F.slice("files_changed", 1, n))).alias("files_preview"))
    return (per.select(key, "files_count", "files_preview"),
            parts.drop("_c").join(per.select(key, "parts"), key))


def render_console(stage, message, preview, count, diff_url) -> Column:
    files = F.when(count > 0, F.concat(F.lit("\n"), preview_text(preview, count, indent="  "))) \
        .otherwise(F.lit(""))
    diff = F.when(diff_url.isNotNull(), F.concat(F.lit("\nView diff: "), diff_url)).otherwise(F.lit(""))
    return F.concat(F.lit(SEPARATOR + "\nNOTIFICATION: Stage '"), stage, F.lit("' requires attention\n"),
                    F.lit("Message: "), message, F.lit("\nFiles changed: "), count.cast("string"),
                    files, diff, F.lit("\n" + SEPARATOR))


def render_logging(stage, message, preview, count, diff_url) -> Column:
    return F.concat(F.lit("Notification: stage="), stage, F.lit(", message="), message,
                    F.lit(", files_changed="), count.cast("string"))


def _text_block(kind, text):
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def render_slack(stage, message, preview, count, diff_url, username: str = "flowmetrics") -> Column:
    header = F.struct(F.lit("header").alias("type"), _text_block(
        "plain_text", F.concat(F.lit("Stage '"), stage, F.lit("' requires attention"))).alias("text"))
    msg = F.struct(F.lit("section").alias("type"), _text_block("mrkdwn", message).alias("text"))
    files = F.when(count > 0, F.struct(F.lit("section").alias("type"), _text_block(
        "mrkdwn", F.concat(F.lit("*Files changed:*\n```"), preview_text(preview, count), F.lit("```")))
        .alias("text")))
    diff = F.when(diff_url.isNotNull(), F.struct(F.lit("section").alias("type"), _text_block(
        "mrkdwn", F.concat(F.lit("<"), diff_url, F.lit("|View Diff>"))).alias("text")))
    blocks = F.filter(F.array(header, msg, files, diff), lambda b: b.isNotNull())
    return F.to_json(F.struct(F.lit(username).alias("username"), blocks.alias("blocks")))


def render_webhook(stage, message, preview, count, diff_url) -> Column:
    return F.to_json(F.struct(stage.alias("stage"), message.alias("message"),
                              preview.alias("files_changed"), diff_url.alias("diff_url")),
                     {"ignoreNullFields": "false"})


RENDERERS: dict[str, Callable[..., Column]] = {
    "console": render_console, "logging": render_logging,
    "slack": render_slack, "webhook": render_webhook,
}


def register_renderer(channel: str, fn: Callable[..., Column]) -> None:
    """Add a notification channel renderer."""
    RENDERERS[channel] = fn


@contextmanager
def renderer(channel: str, fn: Callable[..., Column]):
    """A channel renderer for the plans built within a block."""
    before = RENDERERS.get(channel)
    RENDERERS[channel] = fn
    try:
        yield
    finally:
        if before is None:
            del RENDERERS[channel]
        else:
            RENDERERS[channel] = before


def render_notifications(requests: DataFrame, channels=None, key: str = "request_id",
                         files: DataFrame | None = None, files_key: str = "run_id") -> DataFrame:
    """One row per request and channel with the rendered payload; the
    webhook, which carries the whole list of files, has one row per part.
    ``requests``: key, stage, message, files_preview (array), files_count,
    diff_url, and ``files_key`` where ``files`` (see :func:`file_parts`) is
    given; without it the webhook's list is ``files_preview``.  ``channels``
    defaults to all with a renderer, registered ones included.  Returns key,
    channel, part, payload."""
    channels = list(channels or RENDERERS)
    if files is not None and "webhook" in channels:
        whole = requests.drop("files_preview").join(files, files_key, "left").withColumnRenamed(
            "files_changed", "files_preview")
        rest = [c for c in channels if c != "webhook"]
        hook = _rendered(whole, ["webhook"], key)
        return hook if not rest else _rendered(requests, rest, key).unionByName(hook)
    return _rendered(requests, channels, key)


def _rendered(requests: DataFrame, channels: list[str], key: str) -> DataFrame:
    r = requests.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    args = (F.col("stage"), F.col("message"),
            F.coalesce(F.col("files_preview"), F.array().cast("array<string>")),
            F.coalesce(F.col("files_count"), F.lit(0).cast("bigint")), F.col("diff_url"))
    payload = None
    for c in channels:
        fn = RENDERERS[c]
        payload = (F.when(F.col("channel") == c, fn(*args)) if payload is None
                   else payload.when(F.col("channel") == c, fn(*args)))
    if "part" not in requests.columns:
        return r.select(key, "channel", F.lit(0).alias("part"), payload.alias("payload"))
    # a request in several parts says which one it is
    part, parts = F.coalesce("part", F.lit(0)), F.coalesce("parts", F.lit(1))
    tail = F.concat(F.lit(',"part":'), (part + 1).cast("string"), F.lit(',"parts":'), parts.cast("string"), F.lit("}"))
    payload = F.when(parts > 1, F.concat(F.substring(payload, F.lit(1), F.length(payload) - 1), tail)).otherwise(payload)
    return r.select(key, "channel", part.alias("part"), payload.alias("payload"))


def approval_message(stage: Column) -> Column:
    return F.concat(F.lit("Stage '"), stage, F.lit("' complete. Review required."))


def route_channels(df: DataFrame, configured: str = "configured_channel", known=None) -> DataFrame:
    """The configured channel when known (by default: has a renderer, the
    registered ones included), else (unknown or missing configuration) the
    console."""
    c = F.col(configured)
    return df.withColumn("channel", F.when(c.isin(list(known or RENDERERS)), c).otherwise(F.lit("console")))
