"""Chunks: time windows of console messages, token windows of documents, entries of manuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import SNIPPET_CHARS

#: Streams of one log keep their arrival order in (stream, seq).
WINDOW_MINUTES, MAX_MESSAGES = 5, 50
CHUNK_TOKENS, OVERLAP_TOKENS = 256, 64


def _runs(messages: DataFrame, keys: tuple[str, ...], part: int) -> DataFrame:
    """messages with __run, which rises where __w changes from one message of a key to the next."""
    changes = lambda order: F.coalesce(F.lag("__w").over(order) != F.col("__w"), F.lit(False)).cast("int")
    if not part:
        order = Window.partitionBy(*keys).orderBy("seq")
        return messages.withColumn("__run", F.sum(changes(order)).over(order))
    # Runs are counted inside parts; a row for each part carries the count and the last window to the next ones.
    out = messages.withColumns({**{k: F.coalesce(k, F.lit("")) for k in keys}, "__p": F.floor(F.col("seq") / part)})
    inside = Window.partitionBy(*keys, "__p").orderBy("seq")
    out = out.withColumn("__local", F.sum(changes(inside)).over(inside))
    ends = out.groupBy(*keys, "__p").agg(F.max("__local").alias("cuts"), F.min_by("__w", "seq").alias("first"), F.max_by("__w", "seq").alias("last"))
    order = Window.partitionBy(*keys).orderBy("__p")
    ends = ends.withColumn("at", F.coalesce(F.lag("last").over(order) != F.col("first"), F.lit(False)).cast("int"))
    so_far = F.sum(F.col("cuts") + F.col("at")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cuts")
    out = out.join(ends.select(*keys, "__p", so_far.alias("__before")), [*keys, "__p"])
    return out.withColumn("__run", F.col("__before") + F.col("__local")).drop("__p", "__local", "__before")


def window_chunks(messages: DataFrame, minutes: int = WINDOW_MINUTES, max_messages: int = MAX_MESSAGES, keys: tuple[str, ...] = ("sysname", "julian_date"), part: int = 0) -> DataFrame:
    """Messages in order cut where the window of the day changes or a chunk is full (0: never full).

    One window over ``keys``, through which a filter on them reaches the scan; with keys=('stream',)
    the cut ignores systems and days, and the chunk takes those of its first message.  Where one key
    is too much for a task, ``part`` (such as 1 << 20) finds the cuts inside so many numbers of seq, for
    one more pass over times and keys and one more shuffle; the chunks are the same.
    """
    out = _runs(messages.withColumn("__w", F.floor(tx.minute_of_day(F.col("ts")) / minutes)), keys, part)
    if max_messages:
        inside = Window.partitionBy(*keys, "__run").orderBy("seq")
        out = out.withColumn("__part", F.floor((F.row_number().over(inside) - 1) / max_messages))
    else:
        out = out.withColumn("__part", F.lit(0))
    rank = tx.severity_rank(F.col("severity"))
    first, last = (lambda c: F.min_by(c, "seq")), (lambda c: F.max_by(c, "seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "msgid", "text")))
    groups = [*keys, "__run", "__part"]
    own = {c: F.col(c if c in keys else f"__{c}") for c in ("sysname", "julian_date")}
    out = out.groupBy(*groups).agg(
        F.min("seq").alias("seq"), *[first(c).alias(f"__{c}") for c in ("sysname", "julian_date", "jobname", "ts") if c not in keys],
        last("ts").alias("ts_end"), F.max_by("severity", F.struct(rank, -F.col("seq"))).alias("severity"),
        ordered.alias("__all"), F.count("*").cast("int").alias("msg_count"),
    )
    full = F.array_join(F.transform("__all", lambda x: x["text"]), "\n")
    out = out.withColumns({"full_text": full, "msgid": tx.msgid_list(F.transform("__all", lambda x: x["msgid"]))})
    return out.select(
        F.concat_ws("/", F.lit("operlog"), own["sysname"], own["julian_date"], F.concat(F.col("__ts"), F.lit("-"), F.col("ts_end"))).alias("filename"),
        tx.snippet(F.col("full_text"), SNIPPET_CHARS).alias("snippet"), F.lit("operlog").alias("source_type"), "msgid",
        F.when(F.trim("severity") == "", " ").otherwise(F.col("severity")).alias("severity"), F.col("__jobname").alias("jobname"),
        own["sysname"].alias("sysname"), F.col("__ts").alias("ts_start"), "ts_end", own["julian_date"].alias("julian_date"), "msg_count", "full_text", "seq",
    )


def closed(messages: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Messages whose window is over: those of every system but its last window, which may still grow."""
    at = F.struct(tx.full_date(F.col("julian_date")).alias("day"), F.floor(tx.minute_of_day(F.col("ts")) / minutes).alias("w"))
    last = messages.groupBy(F.col("sysname").alias("__sys")).agg(F.max(at).alias("__last"))
    return messages.join(last, F.col("sysname") == F.col("__sys")).where(at < F.col("__last")).drop("__sys", "__last")


def token_budget(chunk_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, prefix_tokens: int = 0) -> tuple[int, int]:
    """Tokens of a chunk and the step between chunks; a budget under 32 is an error."""
    budget = chunk_tokens - prefix_tokens
    if budget < 32:
        raise ValueError(f"{budget} tokens a chunk are too few")
    return budget, max(1, budget - overlap)


def token_windows(n_tokens: Column, budget: int, step: int) -> Column:
    """Array of (chunk_no from 1, start, end) token windows; the last one ends at n_tokens."""
    last = F.when(n_tokens <= budget, 0).otherwise(F.ceil((n_tokens - budget) / step)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i + 1).alias("chunk_no"), (i * step).cast("int").alias("start"), F.least(i * step + budget, n_tokens).cast("int").alias("end")),
    )


def document_chunks(documents: DataFrame, id_col: str = "filename", text_col: str = "content", chunk_tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, prefix_tokens: int = 0, n_tokens: Column | None = None, with_text: bool = True) -> DataFrame:
    """Overlapping windows of each document's tokens, mapped to characters in proportion, with or without their text.

    n_tokens: a token count by the embedder; words, if none is given.  Documents without a
    token give no chunk.
    """
    budget, step = token_budget(chunk_tokens, overlap, prefix_tokens)
    text = F.col(text_col)
    count = F.size(F.split(tx.trim(text), r"\s+")) if n_tokens is None else n_tokens
    docs = documents.where(F.length(tx.trim(text)) > 0).select(id_col, text.alias("__text"), count.cast("int").alias("n_tokens"))
    docs = docs.withColumn("__size", F.length("__text").cast("long"))
    size = F.col("__size")
    at = lambda c: F.least((c.cast("long") * size / F.col("n_tokens")).cast("long"), size)

    def cut(w: Column) -> Column:
        a, b = at(w["start"]), at(w["end"])
        part = [F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int")).alias("full_text")] if with_text else []
        return F.struct(w["chunk_no"].alias("chunk_no"), w["start"].alias("token_start"), w["end"].alias("token_end"), a.alias("char_start"), b.alias("char_end"), *part)

    # Pieces are cut before the rows are made, so no row carries the whole text.
    pieces = F.transform(token_windows(F.col("n_tokens"), budget, step), cut)
    out = docs.select(id_col, "n_tokens", F.explode(pieces).alias("w")).select(id_col, "n_tokens", "w.*")
    return out.withColumn("snippet", tx.snippet(F.col("full_text"), SNIPPET_CHARS)) if with_text else out


def manual_entries(files: DataFrame, id_col: str = "filename", text_col: str = "content") -> DataFrame:
    """One row for each entry of message manuals: from a line that starts with an id to the next such line.

    Text before the first id is dropped; trailing newlines and blanks are trimmed.
    """
    lines = files.select(F.col(id_col).alias("base"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("own", tx.extract_leading_msgid(F.col("line")))
    order = Window.partitionBy("base").orderBy("line_no")
    lines = lines.withColumn("block", F.sum((F.col("own") != "").cast("int")).over(order)).where("block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy("base", "block").agg(F.max("own").alias("msgid"), F.regexp_replace(text, r"[ \n]+\z", "").alias("full_text"))
    return out.select(
        F.concat("base", F.lit(" ["), "msgid", F.lit("]")).alias("filename"), "base", "block", "msgid", tx.severity_of(F.col("msgid")).alias("severity"),
        tx.snippet(F.col("full_text"), SNIPPET_CHARS).alias("snippet"), "full_text", F.lit("ibm_doc").alias("source_type"),
    )
