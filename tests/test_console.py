import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators import chunking, console, filters, fusion
from logloom.operators.keyword import has_msgid
from logloom.sources import syslog


def msgs(spark, items):
    """(seq, sysname, date, ts, job, text)"""
    df = spark.createDataFrame(items, "seq long, sysname string, julian_date string, ts string, jobname string, text string")
    msgid = tx.extract_msgid(F.col("text"))
    return df.withColumns({"stream": F.lit(""), "msgid": msgid, "severity": tx.severity_of(msgid)})


LINES = [
    "N 0000000 SYS1 26087 17:30:45.12 STC00123 IEF450I PAYROLL - ABEND=S0C7",
    "S                    MORE TEXT",
    "N short",
    "N 4000000 SA2B     2026087 17:31:00.00 JOB00001 00000090  $HASP373 PAYROLL STARTED",
    "IEC030I E37-04,IFG0554P,PAYROLL",
    "N 4000000 SYS1 2026087 17:31:05.50 JOB00002 00000090  CSV003E REQUESTED MODULE X NOT FOUND",
    "N 4000000 SYS1 2026087 17:31:05.50 JOB00002 CSV003E REQUESTED MODULE X NOT FOUND",
]


def test_syslog(spark):
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)], "stream string, line_no long, line string")
    got = [tuple(r) for r in syslog.parse(lines).orderBy("seq").select("sysname", "julian_date", "ts", "jobname", "text", "msgid").collect()]
    assert got == [
        ("SYS1", "26087", "17:30:45.12", "STC00123", "IEF450I PAYROLL - ABEND=S0C7 MORE TEXT", "IEF450I"),
        ("SA2B", "2026087", "17:31:00.00", "JOB00001", "$HASP373 PAYROLL STARTED", ""),
        ("SYS1", "2026087", "17:31:05.50", "JOB00002", "CSV003E REQUESTED MODULE X NOT FOUND", "CSV003E"),
        ("SYS1", "2026087", "17:31:05.50", "JOB00002", "SV003E REQUESTED MODULE X NOT FOUND", "SV003E"),
    ]


def test_window_chunks_in_parts(spark):
    r = random.Random(4)
    items, minute = [], 0
    for i in range(300):
        minute = max(0, min(1439, minute + r.choice([0, 0, 0, 1, 7, -6])))
        items.append((i, f"S{r.randint(0, 1)}", f"202608{r.randint(7, 8)}", f"{minute // 60:02d}:{minute % 60:02d}:00.00", "J", f"IEF450I M{i}"))
    m = msgs(spark, items).repartition(3)
    key = lambda df: sorted(tuple(x) for x in df.select("filename", "seq", "msg_count", "ts_end", "full_text").collect())
    for most in (0, 4):
        want = key(chunking.window_chunks(m, 5, most))
        for part in (1, 7, 64, 1000):
            assert key(chunking.window_chunks(m, 5, most, part=part)) == want


def test_large_files_in_splits_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(syslog, "PART", 700)
    head = "N 4000000 SYS1 2026087 17:31:05.50 JOB00002 00000090  CSV003E MESSAGE {}"
    lines = []
    for i in range(300):
        lines += [head.format(i), *(f"S          more {i} {k}" for k in range(i % 4))]
    lines[50:50] = ["S          " + "x" * 300] * 9
    (tmp_path / "big.log").write_text("\n".join(["S          before any head", *lines]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = syslog.read_lines(spark, str(tmp_path / "big.log"))
        assert spark.read.text(str(tmp_path / "big.log")).rdd.getNumPartitions() > 3
        got = [r["text"] for r in syslog.parse(split).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = syslog.lines_of(spark.read.text(str(tmp_path / "big.log"), wholetext=True))
    monkeypatch.setattr(syslog, "PART", 1 << 20)
    want = [r["text"] for r in syslog.parse(whole).orderBy("seq").collect()]
    assert got == want and len(got) == 300 and got[3].endswith("more 3 0 more 3 1 more 3 2")


def test_json_wrapper(spark):
    doc = spark.createDataFrame([('{"data":{"SYS1":{"content":"a\\nb \\"c\\"","content_length":5},"SYS2":{"content":"d","content_length":1}},"system_logs":2}',)], "value string")
    assert sorted(map(tuple, syslog.json_lines(doc).collect())) == [("SYS1", 0, "a"), ("SYS1", 1, 'b "c"'), ("SYS2", 0, "d")]


def test_json_wrapper_of_a_very_long_log(spark):
    content = F.repeat(F.lit("abcdefghijklmnopqrs\\n"), 1_100_000)
    doc = spark.range(1).select(F.concat(F.lit('{"data":{"SYS1":{"content":"'), content, F.lit('end","content_length":22000003}},"system_logs":1}')).alias("value"))
    assert tuple(syslog.json_lines(doc).agg(F.count("*"), F.max("line_no"), F.max("line")).first()) == (1_100_001, 1_100_000, "end")


def test_json_documents_of_a_log_are_bounded(spark, tmp_path, monkeypatch):
    from logloom.plans import queries

    events = spark.range(100).selectExpr("id * 7 AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 5 AS user_id", "'error' AS event_type", "0D AS value", "concat('{', id, '}') AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    sizes, whole = [], syslog.json_lines

    def spy(documents, *args, **more):
        sizes.extend(r[0] for r in documents.select(F.length("value")).collect())
        return whole(documents, *args, **more)

    monkeypatch.setattr(queries.syslog, "json_lines", spy)
    monkeypatch.setattr(queries, "_PACKED", 70, raising=False)
    got = sorted(tuple(r) for r in queries.json_content_extract(spark, str(tmp_path)).collect())
    assert got == sorted((f"SYS{i % 5 % 3}", i * 7, f"IEF450E {{{i}}}") for i in range(100))
    assert len(sizes) == 30 and max(sizes) < 200


IDS = [
    ("IEF450I", "IEF450I", "IEF450I", True),
    ("JOB1 IEF450I X", "IEF450I", "JOB1", None),
    ("DFH2206 date time", "", "DFH2206", None),
    ("DFH2206", "", "DFH2206", True),
    ("ICH70001I userid", "ICH70001I", "ICH70001I", None),
    ("ABEND_0C4", "", "ABEND_0C4", False),
    ("S0C7", "", "", False),
    ("CSQ9999E,", "", "", False),
    ("IEF4500000I", "", "", False),
]


def test_message_ids(spark):
    df = spark.createDataFrame([(x[0],) for x in IDS], "t string")
    got = df.select("t", tx.extract_msgid(F.col("t")), tx.extract_leading_msgid(F.col("t")), tx.looks_like_msgid(F.col("t"))).collect()
    for r, (_, a, b, c) in zip(got, IDS):
        assert (r[1], r[2]) == (a, b), r
        assert c is None or r[3] == c, r


def scan_msgid(text):
    """Left to right, by runs of upper-case characters: the first run that makes an id."""
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        if re.match(r"[A-Z$]", text[i]):
            while j < n and re.match(r"[A-Z$#@]", text[j]):
                j += 1
            k = j
            while k < n and text[k].isdigit():
                k += 1
            if 2 <= j - i <= 8 and k > j:
                if k - j <= 5 and k < n and text[k] in "IEWASDX":
                    if k + 1 == n or text[k + 1] in " \t\n":
                        return text[i : k + 1]
                    k += 1
                j = k
        i = j
    return ""


def test_message_ids_against_scanner(spark):
    r = random.Random(5)
    parts = ["IEF", "A", "$", "12", "450", "I", "E", "x", "#", "X", " ", "ABCDEFGHI", "999999"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.extract_msgid(F.col("t")).alias("m")).collect()
    assert [m for _, m in got] == [scan_msgid(t) for t, _ in got]
    assert sum(m != "" for _, m in got) > 20


def test_filters(spark):
    ids = ["$HASP373I", "IEF285I", "", "IEF450I", "XYZ001E", "XYZ001I"]
    df = spark.createDataFrame([(i, x[-1:] or " ") for i, x in zip(ids, ids)], "msgid string, severity string")
    assert sorted(r[0] for r in filters.drop_skipped(df).collect()) == ["", "IEF450I", "XYZ001E", "XYZ001I"]
    assert sorted(r[0] for r in filters.interesting(df).collect()) == ["IEF450I", "XYZ001E"]
    assert filters.interesting(df, verbose=True).count() == 5
    entries = spark.createDataFrame([("# note",), ("$HASP*",), (" IEF285I ",)], "pattern string")
    assert sorted(r[0] for r in filters.drop_listed(df, entries).collect()) == ["", "IEF450I", "XYZ001E", "XYZ001I"]


def test_skip_file(spark, tmp_path):
    path = str(tmp_path / "skip.txt")
    assert filters.load_skip_list(spark, path) == filters.DEFAULT
    (tmp_path / "own.txt").write_text("# c\n ABC1I \nXY*\n\n")
    assert filters.load_skip_list(spark, str(tmp_path / "own.txt")) == filters.SkipList(("ABC1I",), ("XY",))


def test_membership(spark):
    df = spark.createDataFrame([(x,) for x in ("IEF450I", "IEF450I,X1I", "A1I,IEF450I", "A1I,IEF450I,B1I", "XIEF450I")], "m string")
    assert [r[0] for r in df.select(has_msgid(F.col("m"), "ief450i")).collect()] == [True] * 4 + [False]


def test_window_chunks(spark):
    items = [(i, "S", "2026001", f"00:{m:02d}:00.00", "J", f"IEF45{i}I t") for i, m in enumerate([0, 1, 2, 6, 4])]
    got = chunking.window_chunks(msgs(spark, items), 5, 2).orderBy("seq").collect()
    assert [r["msgid"] for r in got] == ["IEF450I,IEF451I", "IEF452I", "IEF453I", "IEF454I"]
    assert got[0]["full_text"] == "IEF450I t\nIEF451I t" and got[0]["msg_count"] == 2
    assert got[0]["filename"] == "operlog/S/2026001/00:00:00.00-00:01:00.00"


def test_summary_and_history(spark):
    items = [
        (1, "S1", "2026001", "10:00:00.00", "B", "IEF450E first " + "x" * 100), (2, "S2", "2026001", "09:00:00.00", "A", "IEF450E second"),
        (3, "S1", "2026001", "11:00:00.00", "", "ABC100W warn"), (4, "S1", "2026001", "11:00:00.00", "C", "ABC200S other"),
    ]
    m = msgs(spark, items)
    got = {r["msgid"]: r for r in console.groups(m).collect()}
    e = got["IEF450E"]
    assert (e["count"], e["first_timestamp"], e["last_timestamp"], e["jobnames"], e["sysnames"], len(e["sample_text"])) == (2, "10:00:00.00", "09:00:00.00", ["A", "B"], ["S1", "S2"], 80)
    assert {k: v["tier"] for k, v in got.items()} == {"IEF450E": "critical", "ABC100W": "warning", "ABC200S": "info"}
    store = spark.createDataFrame([(i, "operlog", "IEF450E,X1I", f"202600{i % 3}", "01:00") for i in range(5)], "id long, source_type string, msgid string, julian_date string, ts_start string")
    h = {r["msgid"]: (r["history_count"], r["history_days"]) for r in console.with_history(console.groups(m), store).collect()}
    assert h == {"IEF450E": (5, 3), "ABC100W": (0, 0), "ABC200S": (-1, 0)}
    none = console.with_history(console.groups(m), store.where("id < 0")).select("history_count").distinct().collect()
    assert [r[0] for r in none] == [-1]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, rank int")
    b = spark.createDataFrame([(20, 1), (40, 2)], "id long, rank int")
    got = [(r["id"], r["score"]) for r in fusion.fuse([a, b], ["id"]).collect()]
    assert [g[0] for g in got] == [20, 10, 40, 30]
    assert [g[1] for g in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62, 1 / 63])


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\tb\nc\\d", "IEF450I PAYROLL", "p/x.txt [chunk 12]", "x [IEF1I]", ["a", "b", "c", "d", "e"])], "s string, t string, f string, g string, v array<string>")
    r = df.select(
        tx.cache_unescape(tx.cache_escape(F.col("s"))), tx.cache_escape(F.col("s")), tx.excerpt(F.col("t"), F.lit("IEF450I")), tx.base_filename(F.col("f")),
        tx.base_filename(F.col("g")), tx.join_some(F.col("v")), tx.minute_of_day(F.lit("17:30:45.12")), tx.minute_of_day(F.lit("x")),
        tx.event_time(F.lit("26087"), F.lit("17:30:45.12")).cast("string"),
    ).first()
    assert tuple(r) == ("a\tb\nc\\d", "a\\tb\\nc\\\\d", "PAYROLL", "p/x.txt", "x", "a, b, c, d, ...", 1050, 0, "2026-03-28 17:30:45.12")
