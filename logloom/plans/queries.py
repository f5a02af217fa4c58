"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking, console, embed, etl, filters, fusion, incremental, keyword, knn
from ..operators.keyword import KeywordQuery
from ..sinks import render
from ..sources import syslog
from ..sources.store import ChunkStore
from .query import Options, overlay, parse_query
from .scratch import folder
from .search import search
from .views import MESSAGES_SQL, SKIPPED_SQL, chunks_sql, log_chunks, messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- vectors -------------------------------------------------------------------------------

_Q = 7  # the query vector is the vector of this row


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


_DIST = f"list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_Q}))"


@query(f"SELECT vec_id AS id, label, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 5")
def knn_topk(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, knn.vector_of(v, _Q), 5).withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id AS id, label, round({_DIST}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 5")
def knn_filtered_topk(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, knn.vector_of(v, _Q), 5, where=F.col("label") == 3).withColumn("distance", F.round("distance", 6))


@query(
    f"""SELECT vec_id AS id, label, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_Q})), 6) AS distance
FROM embeddings ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_Q})), vec_id LIMIT 5"""
)
def knn_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, knn.vector_of(v, _Q), 5, metric="cosine").withColumn("distance", F.round("distance", 6))


@query("""
WITH p AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dist
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM p)
SELECT qid, id, round(dist, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def knn_batch_topk(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return knn.knn_batch(v, q, 5).withColumn("distance", F.round("distance", 6))


@query("""
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])])) AS s FROM embeddings)
SELECT vec_id, round(CAST(CAST(v[1] / s AS FLOAT) AS DOUBLE), 5) AS first_value, round(s, 5) AS norm FROM n""")
def vector_normalize(spark, d):
    v = table(spark, d, "embeddings")
    unit = vx.l2_normalize(F.col("embedding"))
    return v.select("vec_id", F.round(F.element_at(unit, 1).cast("double"), 5).alias("first_value"), F.round(vx.norm(F.col("embedding")), 5).alias("norm"))


@query(f"""
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_Q})), 6) AS dot
FROM embeddings""")
def vector_dot(spark, d):
    v = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in knn.vector_of(v, _Q, "vec_id")])
    return v.select("vec_id", F.round(vx.dot(F.col("embedding"), q), 6).alias("dot"))


@query(f"""
WITH sem AS (SELECT vec_id, row_number() OVER (ORDER BY {_DIST}, vec_id) AS rank FROM embeddings QUALIFY rank <= 10),
kw AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings WHERE label = 3 QUALIFY rank <= 10),
s AS (SELECT vec_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY vec_id),
f AS (SELECT vec_id, min(l * 1000 + rank) AS seen FROM (SELECT *, 0 AS l FROM kw UNION ALL SELECT *, 1 FROM sem) GROUP BY vec_id)
SELECT vec_id AS id, round(score, 9) AS score FROM s JOIN f USING (vec_id) ORDER BY round(score, 12) DESC, seen, vec_id LIMIT 5""")
def hybrid_rrf(spark, d):
    """A keyword list (latest rows of one type) and a semantic list, fused."""
    v = _vectors(spark, d)
    near = knn.knn(v, knn.vector_of(v, _Q), 10)
    sem = near.select("id", F.row_number().over(Window.orderBy("distance", "id")).alias("rank"))
    few = v.where("label = 3").select("id").orderBy(F.desc("id")).limit(10)
    kw = few.select("id", F.row_number().over(Window.orderBy(F.desc("id"))).alias("rank"))
    return fusion.fuse([kw, sem], ["id"], k=5).select("id", F.round("score", 9).alias("score"))


@query(f"""
WITH d AS (SELECT vec_id, label, {_DIST} AS dist FROM embeddings),
a AS (SELECT vec_id AS id, '' AS store_tag, dist FROM d WHERE label < 5 ORDER BY dist, vec_id LIMIT 5),
b AS (SELECT vec_id AS id, 'ibm_doc' AS store_tag, dist FROM d WHERE label >= 5 ORDER BY dist, vec_id LIMIT 5)
SELECT id, store_tag, round(dist, 6) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY dist, store_tag, id LIMIT 5""")
def two_store_union_topk(spark, d):
    v = _vectors(spark, d)
    q = knn.vector_of(v, _Q)
    parts = [knn.knn(v, q, 5, where=w).select("id", F.lit(tag).alias("store_tag"), "distance") for tag, w in (("", F.col("label") < 5), ("ibm_doc", F.col("label") >= 5))]
    return parts[0].unionByName(parts[1]).orderBy("distance", "store_tag", "id").limit(5).withColumn("distance", F.round("distance", 6))


# ---- keyword search over stored log chunks ---------------------------------------------------

_HIT = "SELECT id AS rowid, filename, snippet, msgid, severity, jobname, sysname, ts_start, ts_end, julian_date, msg_count FROM chunk"
_LATEST = "ORDER BY julian_date DESC, ts_start DESC, id LIMIT"
_COLS = ["rowid", "filename", "snippet", "msgid", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date", "msg_count"]


def _keyword(name: str, kq: Callable[[SparkSession, str], KeywordQuery], where: str, limit: int = 20) -> None:
    def run(spark, d):
        return keyword.keyword_search(log_chunks(spark, d), kq(spark, d), limit).select(*_COLS)

    run.__name__ = name
    query(f"WITH {chunks_sql()} {_HIT} WHERE {where} {_LATEST} {limit}")(run)


def _fixed(**fields):
    return lambda spark, d: KeywordQuery(**fields)


_MEMBER = "list_contains(string_split(upper(msgid), ','), '{}')"
_keyword("keyword_msgid_exact", _fixed(msgid="IEF450E"), _MEMBER.format("IEF450E"))
_keyword("keyword_msgid_wildcard", _fixed(msgid="ICH*"), "msgid ILIKE '%ICH%'")
_keyword("keyword_msgid_single_wildcard", _fixed(msgid="IE?450E"), "msgid ILIKE '%IE_450E%'")
_keyword("keyword_job_like", _fixed(jobname="job0001*"), "jobname ILIKE 'job0001%'")
_keyword("keyword_text_ilike", _fixed(text="ief450e"), "snippet ILIKE '%ief450e%'")
_keyword("keyword_since_before", _fixed(ts_after="08:00", ts_before="17:30"), "ts_end >= '08:00' AND ts_start <= '17:30'")


def _a_day(spark, d):
    return messages(spark, d).agg(F.min("julian_date")).first()[0]


_DAY = "(SELECT min(julian_date) FROM msg)"
_keyword(
    "keyword_severity_date",
    lambda spark, d: KeywordQuery(severity="A", julian_date=_a_day(spark, d), source_type="operlog", sysname="SYS1"),
    f"severity = 'A' AND julian_date = {_DAY} AND source_type = 'operlog' AND sysname = 'SYS1'",
)


@query(f"WITH {chunks_sql()} {_HIT} WHERE julian_date = {_DAY} AND ts_end >= '11:50:00.00' AND ts_start <= '12:10:59.99' AND sysname = 'SYS1'")
def timeline_window(spark, d):
    return keyword.timeline(log_chunks(spark, d), _a_day(spark, d), "12:00", 10, "SYS1").select(*_COLS)


@query(f"WITH {chunks_sql()} SELECT count(*) AS chunks FROM chunk")
def store_count(spark, d):
    return log_chunks(spark, d).agg(F.count("*").alias("chunks"))


@query(f"""
WITH {chunks_sql()}
SELECT id AS rowid, filename, severity, ts_start, msg_count FROM chunk WHERE {_MEMBER.format("IEC030A")} {_LATEST} 5""")
def json_result_output(spark, d):
    """Results through their JSON form and back, which must lose nothing."""
    hits = keyword.keyword_search(log_chunks(spark, d), KeywordQuery(msgid="IEC030A"), 5)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*keyword.latest_first())))
    parsed = render.results_json(ranked).withColumn("o", F.from_json("json", "filename string, severity string, ts_start string, msg_count int"))
    return ranked.select("rank", "rowid").join(parsed, "rank").select("rowid", "o.filename", "o.severity", "o.ts_start", "o.msg_count")


# ---- console messages ------------------------------------------------------------------------


@query(f"WITH {MESSAGES_SQL} SELECT seq, msgid FROM msg WHERE NOT {SKIPPED_SQL}")
def msg_filter_skip(spark, d):
    return filters.drop_skipped(messages(spark, d)).select("seq", "msgid")


@query(f"WITH {MESSAGES_SQL} SELECT seq, msgid FROM msg WHERE NOT {SKIPPED_SQL}")
def msg_filter_table(spark, d):
    """The same skip list given as a table."""
    entries = spark.createDataFrame([(x,) for x in filters.DEFAULT_SKIP], "pattern string")
    return filters.drop_listed(messages(spark, d), entries).select("seq", "msgid")


_INTERESTING = f"""msgid <> '' AND NOT {SKIPPED_SQL} AND (severity IN ('A', 'E') OR regexp_matches(msgid,
 '^(IEF|IEC|IEA|IEE|IGD|ICH|IRR|CSV|IOS|IGF|IXC|IXL|ARC|ADR|DFH|DSN|CSQ|IST|EZA|EZB|EZY|BPXF|BPXM|BPXP|IKJ|CRE)'))"""


@query(f"WITH {MESSAGES_SQL} SELECT seq, msgid, severity FROM msg WHERE {_INTERESTING}")
def interesting_messages(spark, d):
    return filters.interesting(messages(spark, d)).select("seq", "msgid", "severity")


@query(f"WITH {MESSAGES_SQL} SELECT msgid, min(seq) AS seq, arg_min(text, seq) AS text, count(*) AS count FROM msg GROUP BY msgid")
def dedupe_by_msgid(spark, d):
    return console.first_by_msgid(messages(spark, d)).select("msgid", "seq", "text", "count")


_GROUPS = f"""
grp AS (
  SELECT msgid, count(*) AS count, arg_min(ts, seq) AS first_timestamp, arg_max(ts, seq) AS last_timestamp,
         string_agg(DISTINCT nullif(jobname, ''), ',' ORDER BY nullif(jobname, '')) AS jobnames,
         string_agg(DISTINCT nullif(sysname, ''), ',' ORDER BY nullif(sysname, '')) AS sysnames,
         substr(arg_min(text, seq), 1, 80) AS sample_text, arg_min(severity, seq) AS severity,
         CASE WHEN arg_min(severity, seq) IN ('A', 'E') THEN 'critical' WHEN arg_min(severity, seq) = 'W' THEN 'warning' ELSE 'info' END AS tier
  FROM msg WHERE {_INTERESTING} GROUP BY msgid)"""


@query(f"WITH {MESSAGES_SQL}, {_GROUPS} SELECT * FROM grp")
def summary_groups(spark, d):
    g = console.groups(filters.interesting(messages(spark, d)))
    return g.withColumns({c: F.array_join(c, ",") for c in ("jobnames", "sysnames")})


@query(f"""
WITH {MESSAGES_SQL}, {_GROUPS}
SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY count DESC, msgid) AS INT) AS place, msgid, count FROM grp""")
def summary_tiers(spark, d):
    return console.by_tier(console.groups(filters.interesting(messages(spark, d)))).select("tier", "place", "msgid", "count")


@query(f"""
WITH {chunks_sql()}, {_GROUPS},
occ AS (SELECT id, julian_date, ts_start, unnest(string_split(msgid, ',')) AS one FROM chunk),
lat AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY julian_date DESC, ts_start DESC, id) AS n FROM occ QUALIFY n <= 200),
his AS (SELECT one, count(*) AS h, count(DISTINCT julian_date) AS dd FROM lat GROUP BY one)
SELECT msgid, count, CASE WHEN severity IN ('A', 'E', 'W') THEN coalesce(h, 0) ELSE -1 END AS history_count,
       CASE WHEN severity IN ('A', 'E', 'W') THEN coalesce(dd, 0) ELSE 0 END AS history_days
FROM grp LEFT JOIN his ON one = msgid""")
def history_annotation(spark, d):
    g = console.groups(filters.interesting(messages(spark, d)))
    return console.with_history(g, log_chunks(spark, d)).select("msgid", "count", "history_count", "history_days")


@query(f"""
WITH {MESSAGES_SQL}
SELECT count(*) AS parsed, CAST(count_if({SKIPPED_SQL}) AS BIGINT) AS skipped, CAST(count_if({_INTERESTING}) AS BIGINT) AS interesting,
       count(DISTINCT CASE WHEN {_INTERESTING} THEN msgid END) AS unique_ids FROM msg""")
def run_counters(spark, d):
    return console.run_counters(messages(spark, d))


@query(f"WITH {MESSAGES_SQL} SELECT seq FROM msg WHERE julian_date || ' ' || ts >= {_DAY} || ' 12:00:00.00'")
def since_filter(spark, d):
    start = F.try_to_timestamp(F.lit(_a_day(spark, d) + "12"), F.lit("yyyyDDDHH"))
    return syslog.since(messages(spark, d), start).select("seq")


_CHUNK = "SELECT id, filename, msgid, severity, jobname, sysname, ts_start, ts_end, julian_date, msg_count, full_text FROM chunk"
_CHUNK_COLS = ["id", "filename", "msgid", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date", "msg_count", "full_text"]


@query(f"WITH {chunks_sql(5, 0)} {_CHUNK}")
def window_chunks(spark, d):
    return log_chunks(spark, d, 5, 0).select(*_CHUNK_COLS)


@query(f"WITH {chunks_sql(60, 3, True)} {_CHUNK}")
def window_chunks_maxmsgs(spark, d):
    return log_chunks(spark, d, 60, 3, True).select(*_CHUNK_COLS)


@query(f"WITH {chunks_sql(1440, 0)} SELECT sysname, julian_date, severity FROM chunk")
def severity_max(spark, d):
    """The gravest severity of each system's day."""
    return log_chunks(spark, d, 1440, 0).select("sysname", "julian_date", "severity")


@query(f"""
WITH {MESSAGES_SQL}, u AS (SELECT msgid, min(seq) AS seq FROM msg WHERE {_INTERESTING} GROUP BY msgid),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE label % 4 WHEN 0 THEN 'IEF450E' WHEN 1 THEN 'IEC030A' WHEN 2 THEN 'ICH408W' ELSE 'X' END AS mid FROM embeddings),
q AS (SELECT msgid, e AS qe FROM u JOIN v ON vec_id = seq % 400),
kw AS (SELECT msgid, vec_id, row_number() OVER (PARTITION BY msgid ORDER BY vec_id) AS rank FROM q JOIN v ON mid = msgid QUALIFY rank <= 5),
se AS (SELECT msgid, vec_id, row_number() OVER (PARTITION BY msgid ORDER BY list_distance(e, qe), vec_id) AS rank FROM q, v QUALIFY rank <= 5),
al AS (SELECT *, 0 AS l FROM kw UNION ALL SELECT *, 1 FROM se),
sc AS (SELECT msgid, vec_id, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS seen FROM al GROUP BY ALL)
SELECT msgid, vec_id AS rowid, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY msgid ORDER BY round(score, 12) DESC, seen, vec_id) AS INT) AS rank
FROM sc QUALIFY rank <= 5""")
def enrich_topk_per_msgid(spark, d):
    """Context of every unique interesting message from a store of vectors, keyword and semantic lists fused."""
    v = table(spark, d, "embeddings")
    mid = F.when(F.col("label") % 4 == 0, "IEF450E").when(F.col("label") % 4 == 1, "IEC030A").when(F.col("label") % 4 == 2, "ICH408W").otherwise("X")
    empty = {c: F.lit("") for c in ("filename", "snippet", "full_text", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date")}
    store = v.select(F.col("vec_id").alias("id"), "embedding", mid.alias("msgid")).withColumns({**empty, "source_type": F.lit("ibm_doc"), "msg_count": F.lit(0)})
    unique = console.first_by_msgid(filters.interesting(messages(spark, d)))
    asked = unique.join(v.select(F.col("vec_id").alias("__v"), F.col("embedding").alias("qvec")), F.col("__v") == F.col("seq") % 400)
    return console.enrich(asked.select("msgid", "qvec"), [("", store)], 5).select("msgid", "rowid", F.round("score", 9).alias("score"), "rank")


# ---- text functions and parsing ----------------------------------------------------------------


def _log_lines(spark, d) -> DataFrame:
    """Messages written as log lines, each followed by one continuation, as one stream for each system."""
    m = messages(spark, d)
    head = F.concat(F.lit("N 4000000 "), "sysname", F.lit(" "), "julian_date", F.lit(" "), "ts", F.lit(" "), "jobname", F.lit(" 00000090  "), "text")
    more = F.concat(F.lit("S                    MORE "), "jobname")
    rows = m.select(F.col("sysname").alias("stream"), F.col("seq"), F.posexplode(F.array(head, more)).alias("k", "line"))
    return rows.select("stream", (F.col("seq") * 2 + F.col("k")).alias("line_no"), "line")


@query(f"WITH {MESSAGES_SQL} SELECT seq * 2 AS seq, sysname, julian_date, ts, jobname, msgid, severity FROM msg")
def syslog_parse(spark, d):
    return syslog.parse(_log_lines(spark, d)).select("seq", "sysname", "julian_date", "ts", "jobname", "msgid", "severity")


@query(f"WITH {MESSAGES_SQL} SELECT seq * 2 AS seq, text || ' MORE ' || jobname AS text FROM msg")
def continuation_join(spark, d):
    return syslog.parse(_log_lines(spark, d)).select("seq", "text")


@query(f"WITH {MESSAGES_SQL} SELECT seq, regexp_extract(text, '(?:^|[^A-Z$#@])([A-Z$][A-Z$#@]{{1,7}}[0-9]{{1,5}}[IEWASDX])(?:[ \t\n]|$)', 1) AS msgid FROM msg")
def extract_msgid(spark, d):
    return messages(spark, d).select("seq", tx.extract_msgid(F.col("text")).alias("msgid"))


_PACKED = 1 << 12  # numbers of seq whose messages of a system are one JSON document


@query(f"WITH {MESSAGES_SQL} SELECT sysname AS stream, seq, text AS line FROM msg")
def json_content_extract(spark, d):
    """Collected logs wrapped in JSON by system and part of the log, taken apart again."""
    m = messages(spark, d).withColumn("part", F.floor(F.coalesce("seq", F.lit(0)) / _PACKED))
    packed = m.groupBy("sysname", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("all"))
    content = F.array_join(F.transform("all", lambda x: x["text"]), "\n")
    doc = F.to_json(F.struct(F.create_map("sysname", F.struct(content.alias("content"), F.length(content).cast("long").alias("content_length"))).alias("data"), F.lit(1).alias("system_logs")))
    part = F.col("part").cast("string")
    lines = syslog.json_lines(packed.select(part.alias("part"), doc.alias("value")), within=F.col("part")).withColumnRenamed("stream", "log")
    place = F.row_number().over(Window.partitionBy("sysname", "part").orderBy("seq")) - 1
    order = m.select(F.concat_ws("#", part, "sysname").alias("log"), F.col("sysname").alias("stream"), "seq", place.alias("line_no"))
    return lines.join(order, ["log", "line_no"]).select("stream", "seq", "line")


@query(f"""
WITH {MESSAGES_SQL}
SELECT seq, right(msgid, 1) AS severity, CASE WHEN right(msgid, 1) IN ('A', 'E') THEN 'critical' WHEN right(msgid, 1) = 'W' THEN 'warning' ELSE 'info' END AS tier,
       CASE right(msgid, 1) WHEN 'A' THEN 7 WHEN 'E' THEN 6 WHEN 'W' THEN 5 WHEN 'I' THEN 1 ELSE 0 END AS rank, substr(text, length(msgid) + 2) AS excerpt,
       CAST(substr(ts, 1, 2) AS INT) * 60 + CAST(substr(ts, 4, 2) AS INT) AS minute, regexp_matches(msgid, '^[A-Z$#@]{{2,8}}[0-9]{{1,5}}[A-Z]?$') AS is_id
FROM msg""")
def text_functions(spark, d):
    msgid = F.col("msgid")
    severity = tx.severity_of(msgid)
    return messages(spark, d).select(
        "seq", severity.alias("severity"), tx.tier(severity).alias("tier"), tx.severity_rank(severity).alias("rank"),
        tx.excerpt(F.col("text"), msgid).alias("excerpt"), tx.minute_of_day(F.col("ts")).alias("minute"), tx.looks_like_msgid(msgid).alias("is_id"),
    )


@query(f"""
WITH {chunks_sql()},
a AS (SELECT id AS rowid, '' AS store_tag, julian_date, ts_start FROM chunk WHERE sysname = 'SYS1' AND {_MEMBER.format("ICH408W")} {_LATEST} 3),
b AS (SELECT id AS rowid, 'ibm_doc' AS store_tag, julian_date, ts_start FROM chunk WHERE sysname = 'SYS2' AND {_MEMBER.format("ICH408W")} {_LATEST} 5)
SELECT rowid, store_tag, CAST(row_number() OVER (ORDER BY store_tag, julian_date DESC, ts_start DESC, rowid) AS INT) AS rank
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY rank <= 5""")
def search_two_stores_keyword(spark, d):
    """A parsed keyword query over a small main store, filled up from the knowledge store."""
    c = log_chunks(spark, d)
    few = keyword.keyword_search(c.where("sysname = 'SYS1'"), KeywordQuery(msgid="ICH408W"), 3).select(F.col("rowid").alias("id"))
    main = c.join(few, "id", "left_semi")
    return search("MSG:ICH408W", main, c.where("sysname = 'SYS2'")).select("rowid", "store_tag", "rank")


@query("SELECT vec_id, list_aggregate(CAST(embedding AS FLOAT[]), 'max') AS most FROM embeddings")
def vector_bytes_roundtrip(spark, d):
    """Vectors to big-endian blobs and back through byte-order detection."""
    from .api import convert_vectors

    v = table(spark, d, "embeddings").select("vec_id", vx.encode_vector(F.col("embedding"), "big").alias("embedding"))
    return convert_vectors(v).select("vec_id", F.array_max("embedding").alias("most"))


# ---- documents -------------------------------------------------------------------------------------

_TOK = "len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', ''), '[ \\t\\n\\x0b\\f\\r]+'))"
_WINDOWS = f"""
t AS (SELECT doc_id, text, {_TOK} AS n FROM documents WHERE length(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) > 0),
w AS (SELECT doc_id, text, n, unnest(range(0, CAST(CASE WHEN n <= 64 THEN 0 ELSE ceil((n - 64) / 48) END AS BIGINT) + 1)) AS i FROM t),
win AS (SELECT doc_id, text, n, CAST(i + 1 AS INT) AS chunk_no, CAST(i * 48 AS INT) AS token_start, CAST(least(i * 48 + 64, n) AS INT) AS token_end FROM w)"""


def _doc_chunks(spark, d, with_text: bool = True) -> DataFrame:
    return chunking.document_chunks(table(spark, d, "documents"), "doc_id", "text", 64, 16, with_text=with_text)


@query(f"WITH {_WINDOWS} SELECT doc_id, CAST(n AS INT) AS n_tokens, chunk_no, token_start, token_end FROM win")
def doc_chunk_windows(spark, d):
    return _doc_chunks(spark, d, False).select("doc_id", "n_tokens", "chunk_no", "token_start", "token_end")


@query(f"""
WITH {_WINDOWS}, c AS (SELECT *, CAST(token_start AS BIGINT) * length(text) // n AS a, CAST(token_end AS BIGINT) * length(text) // n AS b FROM win)
SELECT doc_id, chunk_no, a AS char_start, b AS char_end, substr(text, a + 1, b - a) AS full_text FROM c""")
def char_offsets(spark, d):
    return _doc_chunks(spark, d).select("doc_id", "chunk_no", "char_start", "char_end", "full_text")


def _files(spark, d) -> tuple[DataFrame, DataFrame]:
    """A scan (sources as directories) and what was indexed before it."""
    docs = table(spark, d, "documents")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    scan = docs.where("doc_id % 10 <> 1").select(name.alias("filename"), F.col("n_chars").alias("mtime"))
    stored = docs.where("doc_id % 10 <> 2").select(
        F.concat(name, F.lit(" [chunk 1]")).alias("filename"), (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)).alias("mtime")
    )
    return scan, incremental.indexed_files(stored)


@query("""
SELECT source || '/' || doc_id || '.txt' AS filename, CASE doc_id % 10 WHEN 2 THEN 'new' WHEN 3 THEN 'updated' ELSE 'unchanged' END AS status
FROM documents WHERE doc_id % 10 <> 1""")
def incremental_status(spark, d):
    return incremental.classify(*_files(spark, d)).select("filename", "status")


@query("SELECT source || '/' || doc_id || '.txt' AS base FROM documents WHERE doc_id % 10 = 1 AND starts_with(source, 'src1')")
def removed_files_antijoin(spark, d):
    scan, old = _files(spark, d)
    return incremental.removed(old, scan, ["src1"]).select("base")


@query("""
SELECT CASE doc_id % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'new' WHEN 3 THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS files
FROM documents GROUP BY 1""")
def index_counters(spark, d):
    scan, old = _files(spark, d)
    return incremental.counters(incremental.classify(scan, old), incremental.removed(old, scan))


@query(f"""
WITH {chunks_sql()},
mark AS (SELECT sysname, max(julian_date || ' ' || ts_end) AS mark FROM chunk WHERE id % 3 = 0 GROUP BY sysname)
SELECT id, filename FROM chunk LEFT JOIN mark USING (sysname) WHERE mark IS NULL OR julian_date || ' ' || ts_start > mark""")
def hwm_incremental(spark, d):
    c = log_chunks(spark, d)
    return incremental.beyond(c, incremental.high_water(c.where("id % 3 = 0"))).select("id", "filename")


_MANUAL = """
m AS (SELECT doc_id, string_split('Front matter' || chr(10) || 'IEF' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'I ' || replace(text, chr(10), ' ') || chr(10) || 'ABEND_0C4' || chr(10) || 'Explanation' || chr(10), chr(10)) AS l FROM documents)"""


def _manuals(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.concat(
        F.lit("Front matter\nIEF"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("I "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nABEND_0C4\nExplanation\n")
    )
    return docs.select(F.concat(F.lit("manual/"), F.col("doc_id").cast("string")).alias("filename"), text.alias("content"))


@query(f"""
WITH {_MANUAL}
SELECT 'manual/' || doc_id AS base, 'IEF' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'I' AS msgid, 'I' AS severity, rtrim(l[2], ' ' || chr(10)) AS full_text FROM m
UNION ALL SELECT 'manual/' || doc_id, 'ABEND_0C4', ' ', 'ABEND_0C4' || chr(10) || 'Explanation' FROM m""")
def ibm_message_split(spark, d):
    return chunking.manual_entries(_manuals(spark, d)).select("base", "msgid", "severity", "full_text")


_HASHED = """list_transform(range(0, 64), lambda k: list_sum(list_transform(list_filter({0}, lambda h: (h >> 1) % 64 = k), lambda h: CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)))"""
_HASHES = "list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT))"
_ASKED = "the message of the system"


@query(f"""
WITH {_WINDOWS}, c AS (SELECT *, CAST(token_start AS BIGINT) * length(text) // n AS a, CAST(token_end AS BIGINT) * length(text) // n AS b FROM win),
h AS (SELECT doc_id * 100000 + chunk_no AS id, {_HASHES.format("substr(text, a + 1, b - a)")} AS hs FROM c UNION ALL SELECT -1, {_HASHES.format(f"'{_ASKED}'")}),
v AS (SELECT id, list_transform({_HASHED.format("hs")}, lambda x: CASE WHEN x < 0 THEN -sqrt(-x) ELSE sqrt(coalesce(x, 0)) END) AS v FROM h),
u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 1e-30)) AS u FROM v),
x AS (SELECT id, round(list_distance(CAST(u AS DOUBLE[]), (SELECT CAST(u AS DOUBLE[]) FROM u WHERE id = -1)), 4) AS distance FROM u WHERE id >= 0)
SELECT id, distance FROM x ORDER BY distance, id LIMIT 5""")
def hash_embed_search(spark, d):
    """Document chunks embedded by the hashing embedder and searched by text."""
    e = embed.HashEmbedder(64, n_ctx=sys.maxsize)
    chunks = _doc_chunks(spark, d).select((F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("id"), embed.embed(F.col("full_text"), e).alias("embedding"))
    return knn.knn(chunks, [float(x) for x in e.encode([_ASKED])[0]], 5, digits=4)


@query(f"""
WITH {_MANUAL}
SELECT 'manual/' || doc_id AS file, 'IEF' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'I' AS msgid, 'Meaning of it' AS text FROM m
UNION ALL SELECT 'manual/' || doc_id, 'IEC030I', 'data error while reading' || chr(10) || 'More' FROM m""")
def pdf_message_split(spark, d):
    docs = table(spark, d, "documents")
    text = F.concat(F.lit("Front\nChapter 1. IEF messages 3\nIEF"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("I\nMeaning of it\nIBM\n\nIEC030I data error while reading\nTable....... 12\nMore\n30\n"))
    return etl.message_entries(docs.select(F.concat(F.lit("manual/"), F.col("doc_id").cast("string")).alias("filename"), text.alias("content"))).select("file", "msgid", "text")


@query("""
SELECT 'codes/' || doc_id AS file, code, body AS text FROM documents,
(VALUES ('ABEND_0C4', 'System code 0C4 (S0C4)' || chr(10) || chr(10) || 'Explanation: protection'), ('WAIT_0A1', 'System code 0A1 (S0A1)' || chr(10) || 'Explanation: wait'),
        ('IPCS_1200', 'IPCS user completion code 1200' || chr(10) || 'Explanation: user')) AS v(code, body)""")
def abend_code_split(spark, d):
    docs = table(spark, d, "documents")
    text = "Contents\n0C1\nChapter 2. System completion codes\n0C4\n\nExplanation: protection\n\nChapter 3. Wait state codes\n0A1\nExplanation: wait\nChapter 5. Other\n0A2\nExplanation: none\nChapter 7. IPCS codes\n1200\nExplanation: user\n"
    return etl.code_entries(docs.select(F.concat(F.lit("codes/"), F.col("doc_id").cast("string")).alias("filename"), F.lit(text).alias("content"))).select("file", "code", "text")


_SUBCODES = [("ABEND_0Cx", "System code 0Cx (S0Cx)\nExplanation: all\n0C1\nOperation exception\n0C4\nProtection\nSystem action\nEnds")]
_SUBCODES += [(f"ABEND_{c}", f"System abend code {c} (S{c})\n\nSystem code 0Cx (S0Cx)\nExplanation: all\n\n{t}\n\nSystem action\nEnds") for c, t in (("0C1", "Operation exception"), ("0C4", "Protection"))]


def _values(rows: list[tuple]) -> str:
    one = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _subcodes(spark, d) -> DataFrame:
    text = "Chapter 2. System completion codes\n0Cx\nExplanation: all\n0C1\nOperation exception\n0C4\nProtection\nSystem action\nEnds\nChapter 3. Wait state codes\n0A1\nExplanation: wait\n"
    docs = table(spark, d, "documents")
    return etl.code_entries(docs.select(F.concat(F.lit("codes/"), F.col("doc_id").cast("string")).alias("filename"), F.lit(text).alias("content")))


@query(f"SELECT 'codes/' || doc_id AS file, code, body AS text FROM documents, (VALUES {_values(_SUBCODES)}, ('WAIT_0A1', 'System code 0A1 (S0A1)' || chr(10) || 'Explanation: wait')) AS v(code, body)")
def abend_subcode_split(spark, d):
    """A code page for a family of codes, taken apart into its members."""
    return _subcodes(spark, d).select("file", "code", "text")


@query("SELECT 3 * count(*) AS abend, count(*) AS wait, CAST(0 AS BIGINT) AS ipcs FROM documents")
def abend_code_counts(spark, d):
    return etl.code_counts(_subcodes(spark, d))


@query("""
SELECT file, string_agg(code || chr(10) || body || chr(10), chr(10) ORDER BY n) AS content
FROM (SELECT DISTINCT 'm' || source AS file, code, body, n FROM documents, (VALUES ('IEF450I', 'Meaning of it', 1), ('IEC030I', 'data error while reading' || chr(10) || 'More', 2)) AS v(code, body, n)) GROUP BY file""")
def manual_files(spark, d):
    """Cleaned manuals written as text files and read again."""
    text = "Chapter 1. IEF messages\nIEF450I\nMeaning of it\nIBM\n\nIEC030I data error while reading\nMore\n30\n"
    docs = table(spark, d, "documents").select(F.concat(F.lit("m"), "source").alias("filename"), F.lit(text).alias("content")).distinct()
    path = folder(spark, "manuals")
    render.write_manuals(etl.manual_text(etl.message_entries(docs), "msgid"), path)
    back = spark.read.schema("value string, file string").text(path, wholetext=True)
    return back.select("file", F.regexp_replace("value", r"\n\z", "").alias("content"))


# ---- stores that are written, and runs over them -----------------------------------------------------


def _stored(spark, d) -> ChunkStore:
    """The log chunks in a store of their own."""
    store = ChunkStore(spark, folder(spark, "chunks"))
    store.append(log_chunks(spark, d))
    return store


@query(f"WITH {chunks_sql()} SELECT id, filename, source_type, julian_date, ts_start, severity, msg_count FROM chunk WHERE sysname <> 'SYS1' OR msg_count > 1")
def store_roundtrip(spark, d):
    """Two appends, then the chunks of one system's files replaced by some of them."""
    c = log_chunks(spark, d)
    store = ChunkStore(spark, folder(spark, "chunks"))
    store.append(c.where("sysname <> 'SYS1'"))
    store.append(c.where("sysname = 'SYS1'"))
    mine = store.read().where("sysname = 'SYS1'")
    store.replace(mine.where("msg_count > 1"), mine.select(tx.base_filename(F.col("filename")).alias("base")))
    return store.read().select("id", "filename", "source_type", "julian_date", "ts_start", "severity", "msg_count")


@query(f"WITH {chunks_sql()} SELECT id FROM chunk WHERE sysname <> 'SYS0'")
def store_delete_files(spark, d):
    store = _stored(spark, d)
    store.delete_files(store.read().where("sysname = 'SYS0'").select(tx.base_filename(F.col("filename")).alias("base")).distinct())
    return store.read().select("id")


@query(f"WITH {chunks_sql()} {_HIT} WHERE julian_date = {_DAY} AND ts_end >= '11:50:00.00' AND ts_start <= '12:10:59.99' AND sysname = 'SYS1'")
def timeline_on_store(spark, d):
    """A timeline that reads one day's folder of a written store."""
    return keyword.timeline(_stored(spark, d).read(), _a_day(spark, d), "12:00", 10, "SYS1").select(*_COLS)


@query(f"WITH {chunks_sql()} {_HIT} WHERE {_MEMBER.format('IEF450E')} AND julian_date = {_DAY} {_LATEST} 20")
def keyword_on_store(spark, d):
    return keyword.keyword_search(_stored(spark, d).read(), KeywordQuery(msgid="ief450e", julian_date=_a_day(spark, d)), 20).select(*_COLS)


@query(f"WITH {chunks_sql(5, 50, True)} SELECT filename, msgid, severity, msg_count FROM chunk")
def ingest_growing_window(spark, d):
    """A log ingested in the middle of a window, again when it has grown, and once more when it is complete."""
    from .api import ingest

    m = messages(spark, d)
    store = ChunkStore(spark, folder(spark, "chunks"))
    early = m.where((F.col("julian_date") < "2024010") | (F.col("julian_date") == "2024010") & (F.col("ts") < "12:02:30.00"))
    ingest(early, store)
    ingest(m, store)
    ingest(m, store, complete=True)
    return store.read().select("filename", "msgid", "severity", "msg_count")


@query(f"WITH {MESSAGES_SQL} SELECT sysname, julian_date, count(*) AS messages FROM msg WHERE NOT {SKIPPED_SQL} AND msgid <> '' GROUP BY ALL")
def stream_ingest(spark, d):
    """Log files read as a stream of lines into a store."""
    from ..streaming import ingest as streaming

    path = folder(spark, "logs")
    # A file for each system, in the order of arrival.
    lines = _log_lines(spark, d).repartition("stream").sortWithinPartitions("stream", "line_no")
    lines.select("line", F.col("stream").alias("system")).write.partitionBy("system").text(path)
    store = ChunkStore(spark, folder(spark, "chunks"))
    files = streaming.log_files(spark, f"{path}/*/")
    streaming.ingest(files, store, folder(spark, "progress")).awaitTermination()
    return store.read().groupBy("sysname", "julian_date").agg(F.sum("msg_count").alias("messages"))


@query(f"""
WITH {MESSAGES_SQL}
SELECT strftime(time_bucket(INTERVAL 60 MINUTE, strptime(julian_date || ts || '0000', '%Y%j%H:%M:%S.%f')), '%Y-%m-%d %H:%M') AS start, sysname, severity, count(*) AS messages FROM msg GROUP BY ALL""")
def stream_severity_windows(spark, d):
    """Event-time windows of a stream of messages, under a watermark."""
    from ..streaming import ingest as streaming

    path, name = folder(spark, "messages"), "sevw_" + uuid.uuid4().hex
    m = messages(spark, d)
    m.write.parquet(path)
    stream = spark.readStream.schema(m.schema).parquet(path)
    started = streaming.severity_windows(stream, 60).writeStream.format("memory").queryName(name).outputMode("complete")
    started.option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "sysname", "severity", "messages")


_VSTORE = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, CASE label % 4 WHEN 0 THEN 'IEF450E' WHEN 1 THEN 'IEC030A' WHEN 2 THEN 'ICH408W' ELSE 'X' END AS mid, CASE WHEN label < 5 THEN 0 ELSE 1 END AS store FROM embeddings)"


def _vector_stores(spark, d) -> list[tuple[str, DataFrame]]:
    """The vectors as chunks of two stores, by label."""
    v = table(spark, d, "embeddings")
    mid = F.when(F.col("label") % 4 == 0, "IEF450E").when(F.col("label") % 4 == 1, "IEC030A").when(F.col("label") % 4 == 2, "ICH408W").otherwise("X")
    empty = {c: F.lit("") for c in ("snippet", "full_text", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date")}
    chunks = v.select(F.col("vec_id").alias("id"), "embedding", "label", mid.alias("msgid"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("filename"))
    chunks = chunks.withColumns({**empty, "source_type": F.lit("ibm_doc"), "msg_count": F.lit(0)})
    return [("", chunks.where("label < 5").drop("label")), ("ibm_doc", chunks.where("label >= 5").drop("label"))]


_FROM_Q = f"list_distance(e, (SELECT e FROM v WHERE vec_id = {_Q}))"


@query(f"""
WITH {_VSTORE},
kw AS (SELECT *, row_number() OVER (ORDER BY store, vec_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY vec_id) AS p FROM v WHERE mid = 'IEF450E' QUALIFY p <= CASE store WHEN 0 THEN 10 ELSE 5 END)),
se AS (SELECT *, row_number() OVER (ORDER BY store, p) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY {_FROM_Q}, vec_id) AS p FROM v QUALIFY p <= CASE store WHEN 0 THEN 10 ELSE 5 END)),
al AS (SELECT vec_id, store, rank, 0 AS l FROM kw UNION ALL SELECT vec_id, store, rank, 1 FROM se),
sc AS (SELECT vec_id, store, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS seen FROM al GROUP BY ALL)
SELECT vec_id AS rowid, CASE store WHEN 0 THEN '' ELSE 'ibm_doc' END AS store_tag, round(score, 9) AS score,
       CAST(row_number() OVER (ORDER BY round(score, 12) DESC, seen, store, vec_id) AS INT) AS rank FROM sc QUALIFY rank <= 5""")
def search_hybrid_two_stores(spark, d):
    """A query with an id and words over two stores: both lists of both stores, fused."""
    (_, main), (_, knowledge) = _vector_stores(spark, d)
    out = search("MSGID:IEF450E job abended", main, knowledge, vector=knn.vector_of(table(spark, d, "embeddings"), _Q, "vec_id"))
    return out.select("rowid", "store_tag", F.round("score", 9).alias("score"), "rank")


@query(f"""
WITH {_VSTORE}
SELECT vec_id AS rowid, CASE store WHEN 0 THEN '' ELSE 'ibm_doc' END AS store_tag, CAST(row_number() OVER (ORDER BY {_FROM_Q}, store, vec_id) AS INT) AS rank FROM v QUALIFY rank <= 5""")
def search_semantic_two_stores(spark, d):
    (_, main), (_, knowledge) = _vector_stores(spark, d)
    out = search("why did the job end", main, knowledge, vector=knn.vector_of(table(spark, d, "embeddings"), _Q, "vec_id"))
    return out.select("rowid", "store_tag", "rank")


_ENRICHED = f"""
{MESSAGES_SQL}, u AS (SELECT msgid, min(seq) AS seq, count(*) AS count FROM msg WHERE {_INTERESTING} GROUP BY msgid), {_VSTORE},
q AS (SELECT msgid, e AS qe FROM u JOIN v ON vec_id = seq % 400),
kw AS (SELECT msgid, vec_id, store, row_number() OVER (PARTITION BY msgid ORDER BY store, vec_id) AS rank FROM (SELECT msgid, vec_id, store, row_number() OVER (PARTITION BY msgid, store ORDER BY vec_id) AS p FROM q JOIN v ON mid = msgid QUALIFY p <= 5)),
se AS (SELECT msgid, vec_id, store, row_number() OVER (PARTITION BY msgid ORDER BY store, p) AS rank FROM (SELECT msgid, vec_id, store, row_number() OVER (PARTITION BY msgid, store ORDER BY list_distance(e, qe), vec_id) AS p FROM q, v QUALIFY p <= 5)),
al AS (SELECT *, 0 AS l FROM kw UNION ALL SELECT *, 1 FROM se),
sc AS (SELECT msgid, vec_id, store, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS seen, min(l) AS lo, max(l) AS hi FROM al GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY msgid ORDER BY round(score, 12) DESC, seen, store, vec_id) AS rank, min(lo) OVER (PARTITION BY msgid) = 0 AND max(hi) OVER (PARTITION BY msgid) = 1 AS fused FROM sc)"""


def _enriched(spark, d) -> tuple[DataFrame, DataFrame]:
    """Unique messages, and their context from two stores."""
    v = table(spark, d, "embeddings")
    unique = console.first_by_msgid(filters.interesting(messages(spark, d)))
    asked = unique.join(v.select(F.col("vec_id").alias("__v"), F.col("embedding").alias("qvec")), F.col("__v") == F.col("seq") % 400)
    return unique, console.enrich(asked.select("msgid", "qvec"), _vector_stores(spark, d), 5)


@query(f"""WITH {_ENRICHED}
SELECT msgid, vec_id AS rowid, CASE store WHEN 0 THEN '' ELSE 'ibm_doc' END AS store_tag, CAST(rank AS INT) AS rank FROM pl WHERE NOT fused OR rank <= 5""")
def enrich_two_stores(spark, d):
    return _enriched(spark, d)[1].select("msgid", "rowid", "store_tag", "rank")


@query(f"""WITH {_ENRICHED}
SELECT msgid, count, 'f' || vec_id AS filename, CAST(rank - 1 AS INT) AS place FROM pl JOIN u USING (msgid) WHERE NOT fused OR rank <= 5""")
def enriched_json_output(spark, d):
    """Enriched messages through their JSON form and back."""
    out = render.enriched_json(*_enriched(spark, d)).withColumn("o", F.from_json("json", "msgid string, count long, context array<struct<filename:string>>"))
    return out.select("o.msgid", "o.count", F.posexplode("o.context").alias("place", "c")).select("msgid", "count", "c.filename", "place")


@query(f"""
WITH {MESSAGES_SQL}, {_GROUPS}
SELECT msgid, tier, count, sample_text, sysnames, (SELECT count(*) FROM msg) AS total, CAST((SELECT sum(count) FROM grp) AS BIGINT) AS interesting FROM grp""")
def summary_json_output(spark, d):
    """A summary through its JSON form and back."""
    m = messages(spark, d)
    some = filters.interesting(m)
    groups = console.groups(some).withColumns({"history_count": F.lit(-1), "history_days": F.lit(0)})
    doc = spark.createDataFrame([(render.summary_json(m.count(), some.count(), groups),)], "json string")
    kind = "total_messages long, interesting_messages long, groups array<struct<msgid:string,tier:string,count:long,sample_text:string,sysnames:array<string>>>"
    o = doc.select(F.from_json("json", kind).alias("o")).select("o.total_messages", "o.interesting_messages", F.explode("o.groups").alias("g"))
    return o.select("g.*", F.col("total_messages").alias("total"), F.col("interesting_messages").alias("interesting")).withColumn("sysnames", F.array_join("sysnames", ","))


@query(f"""
WITH {MESSAGES_SQL}, {_GROUPS}, j AS (SELECT msgid, string_split(jobnames, ',') AS js FROM grp)
SELECT msgid, array_to_string(js[1:4], ', ') || CASE WHEN len(js) > 4 THEN ', ...' ELSE '' END AS jobs FROM j""")
def summary_job_lists(spark, d):
    return console.groups(filters.interesting(messages(spark, d))).select("msgid", tx.join_some(F.col("jobnames")).alias("jobs"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') || chr(9) || '\n' || chr(13) || chr(10) AS x FROM documents)
SELECT doc_id, replace(replace(replace(x, '\', '\\'), chr(9), '\t'), chr(10), '\n') AS escaped, regexp_replace(replace(x, chr(13), ''), '[\x00-\x1F]', ' ', 'g') AS line, true AS same FROM t""")
def text_escapes(spark, d):
    """Cache and one-line JSON forms of texts with tabs, backslashes and line ends."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\t\\n\r\n")).alias("x"))
    escaped = tx.cache_escape(F.col("x"))
    return t.select("doc_id", escaped.alias("escaped"), tx.one_line(F.col("x")).alias("line"), (tx.cache_unescape(escaped) == F.col("x")).alias("same"))


# ---- the query language ----------------------------------------------------------------------------------

#: query, mode, text, msgid, job, system, severity, type, text pattern
_CLASSIFIED = [
    ("IEF450I", "keyword", "", "IEF450I", "", "", "", "", ""),
    ("DFH*", "keyword", "", "DFH*", "", "", "", "", ""),
    ("JOB:PAYROLL", "keyword", "", "", "PAYROLL", "", "", "", ""),
    ("sev:e", "keyword", "", "", "", "", "E", "", ""),
    ("MSGID:IEF* JOB:PAY* abend", "hybrid", "abend", "IEF*", "PAY*", "", "", "", ""),
    ("TYPE:operlog reboot", "hybrid", "reboot", "", "", "", "", "operlog", ""),
    ("SYS:", "keyword", "", "", "", "", "", "", ""),
    ("IEC030I data management error", "hybrid", "data management error", "IEC030I", "", "", "", "", ""),
    ("DFH* storage", "hybrid", "storage", "DFH*", "", "", "", "", ""),
    ("S0C7", "hybrid", "S0C7", "", "", "", "", "", "S0C7"),
    ("DB2", "keyword", "", "DB2", "", "", "", "", ""),
    ("storage shortage during batch", "semantic", "storage shortage during batch", "", "", "", "", "", ""),
    ("17:30 JOB:X", "semantic", "17:30 JOB:X", "", "", "", "", "", ""),
]
_PARSED = ["query", "mode", "text", "msgid", "jobname", "sysname", "severity", "source_type", "pattern"]


def _parsed(spark, found) -> DataFrame:
    rows = [(q, p.mode, p.text, k.msgid, k.jobname, k.sysname, k.severity, k.source_type, k.text) for q, p in found for k in [p.keyword]]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in _PARSED))


@query(f"SELECT * FROM (VALUES {_values(_CLASSIFIED)}) AS v({', '.join(_PARSED)})")
def query_classification(spark, d):
    return _parsed(spark, [(q, parse_query(q)) for q, *_ in _CLASSIFIED])


_OVERLAID = [
    ("storage shortage", "hybrid", "storage shortage", "", "PAY*", "", "", "", ""),
    ("IEF450I", "keyword", "", "IEF450I", "PAY*", "", "", "", ""),
    ("MSGID:IEF* JOB:X abend", "hybrid", "abend", "IEF*", "PAY*", "", "", "", ""),
]


@query(f"SELECT * FROM (VALUES {_values(_OVERLAID)}) AS v({', '.join(_PARSED)})")
def option_overlay(spark, d):
    """An explicit job over what the query says."""
    return _parsed(spark, [(q, overlay(parse_query(q), Options(job="PAY*"))) for q, *_ in _OVERLAID])
