"""Canonical schemas of stored chunks and of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

CHUNKS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", _L), ("filename", _S), ("snippet", _S), ("source_type", _S), ("mtime", _L), ("msgid", _S), ("severity", _S),
        ("jobname", _S), ("sysname", _S), ("ts_start", _S), ("ts_end", _S), ("julian_date", _S), ("msg_count", _I), ("full_text", _S),
        ("embedding", T.ArrayType(T.FloatType())),
    )]
)

#: Metadata columns that every search returns; the embedding is never among them.
META = ["filename", "snippet", "source_type", "full_text", "msgid", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date", "msg_count"]
RESULT = ["distance", "rowid", *META, "store_tag"]

#: Rows of this type are bookkeeping and never returned.
HIDDEN_TYPE = "operlog_meta"
SNIPPET_CHARS, DISPLAY_CHARS, SAMPLE_CHARS = 500, 200, 80


def conform(df: DataFrame) -> DataFrame:
    """df with every column of CHUNKS, in order: absent or null texts become '', counts 0."""
    out = []
    for field in CHUNKS.fields:
        c = F.col(field.name) if field.name in df.columns else F.lit(None)
        c = c.cast(field.dataType)
        if field.name in ("filename", "snippet", "source_type", "msgid", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date", "full_text"):
            c = F.coalesce(c, F.lit(""))
        elif field.name in ("mtime", "msg_count"):
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)
