import json
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions import vectors as vx
from logloom.operators import chunking, embed, etl, incremental, keyword, knn
from logloom.plans.query import Options
from logloom.plans.search import search
from logloom.sinks import render
from logloom.sources import files, syslog
from logloom.sources.store import ChunkStore
from logloom.streaming import ingest


def chunks(spark, embedder):
    texts = [
        (1, "ibm.txt [IEF450I]", "ibm_doc", "IEF450I", "I", "", "", "", "IEF450I JOB ABENDED during a step"),
        (2, "operlog/SYS1/a", "operlog", "IEF450I,IEC030I", "I", "10:00:00.00", "10:04:00.00", "2026087", "IEF450I PAYROLL failed\nIEC030I E37 space"),
        (3, "operlog/SYS1/b", "operlog", "DFH2206", " ", "10:05:00.00", "10:06:00.00", "2026087", "DFH2206 storage shortage"),
        (4, "_operlog_hwm", "operlog_meta", "", "", "", "", "", "operlog/SYS1/b"),
    ]
    df = spark.createDataFrame(texts, "id long, filename string, source_type string, msgid string, severity string, ts_start string, ts_end string, julian_date string, full_text string")
    df = df.withColumns({"snippet": F.col("full_text"), "jobname": F.lit("PAYROLL"), "sysname": F.lit("SYS1"), "msg_count": F.lit(1), "mtime": F.lit(0).cast("long")})
    return df.withColumn("embedding", embed.embed(F.col("full_text"), embedder))


def test_store_roundtrip(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.count() == 0
    store.append(chunks(spark, embed.HashEmbedder(8)))
    store.append(spark.createDataFrame([("a.txt [chunk 1]", "x", 5), ("a.txt [chunk 2]", "y", 5), ("b.txt", "z", 6)], "filename string, snippet string, mtime long"))
    assert store.count() == 7
    got = {r["base"]: r["mtime"] for r in incremental.indexed_files(store.read()).collect()}
    assert got["a.txt"] == 5 and got["b.txt"] == 6
    store.delete_files(spark.createDataFrame([("a.txt",)], "base string"))
    assert store.count() == 5
    store.replace(spark.createDataFrame([("b.txt", "new", 7)], "filename string, snippet string, mtime long"), spark.createDataFrame([("b.txt",)], "base string"))
    assert [r["snippet"] for r in store.read().where("filename = 'b.txt'").collect()] == ["new"]
    assert store.read().where("source_type = 'operlog'").count() == 2
    ids = [r["id"] for r in store.read().collect()]
    assert len(set(ids)) == len(ids)


def test_search_modes(spark):
    e = embed.HashEmbedder(64)
    c = chunks(spark, e)
    kw = search("IEF450I", c).collect()
    assert [r["rowid"] for r in kw] == [2, 1]
    assert [r["rowid"] for r in search("DFH*", c).collect()] == [3]
    sem = search("storage shortage", c, embedder=e, options=Options(k=2)).collect()
    assert sem[0]["rowid"] == 3 and len(sem) == 2 and 4 not in [r["rowid"] for r in sem]
    hyb = search("IEC030I space", c, knowledge=c.where("id = 1"), embedder=e, options=Options(k=3)).collect()
    assert (hyb[0]["rowid"], hyb[0]["store_tag"]) == (2, "") and [r["rank"] for r in hyb] == [1, 2, 3]
    only = search("storage shortage", c, embedder=e, options=Options(source_type="ibm_doc")).collect()
    assert [r["rowid"] for r in only] == [1]
    doc = json.loads(render.query_json("IEF450I", "keyword", search("IEF450I", c)))
    assert [r["filename"] for r in doc["results"]] == ["operlog/SYS1/a", "ibm.txt [IEF450I]"]
    assert "ts_start" not in doc["results"][1] and "\n" not in doc["results"][0]["snippet"]
    assert "msgid: DFH2206" in render.results_text(search("DFH*", c))
    tl = keyword.timeline(c, "2026087", "10:00", 2).collect()
    assert [r["rowid"] for r in tl] == [2]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [list(r[0]) for r in df.select(vx.l2_normalize(F.col("v"))).collect()]
    assert got == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    back = df.select(vx.decode_vector(vx.encode_vector(F.col("v"), "big"), "big").alias("v"), vx.plausible(F.col("v")).alias("p")).collect()
    assert [list(r["v"]) for r in back] == [[3.0, 4.0], [0.0, 0.0]] and [r["p"] for r in back] == [False, True]
    assert df.select(vx.dot(F.col("v"), F.array(F.lit(1.0)))).first()[0] == 0.0


def test_knn_batch_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(3)
    q = df.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    for metric in ("l2", "cosine"):
        got = {(x["qid"], x["rank"]): x["id"] for x in knn.knn_batch(df, q, 3, metric=metric, block_queries=4).collect()}
        for i in range(0, 60, 7):
            w = v.astype(float)
            d = np.sqrt(((w - w[i]) ** 2).sum(1)) if metric == "l2" else 1 - w @ w[i] / np.linalg.norm(w, axis=1) / np.linalg.norm(w[i])
            assert [got[i, k] for k in (1, 2, 3)] == np.argsort(d, kind="stable")[:3].tolist()


def knn_task(spark, monkeypatch, queries, k, metric="l2"):
    """What a task of knn_batch does with its batches, as a function in this process."""
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "qid long, qvec array<float>")
    v = spark.createDataFrame([], "id long, embedding array<float>")
    seen, kind = [], type(v)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: seen.append(f) or whole(self, f, schema))
    knn.knn_batch(v, q, k, metric=metric)
    (run,) = seen
    return lambda batches: {(x["qid"], x["id"]): x["distance"] for out in run(iter(batches)) for x in out.to_pylist()}


def vector_batch(v, first=0):
    return pa.RecordBatch.from_pydict({"id": list(range(first, first + len(v))), "embedding": pa.array(v.tolist(), pa.list_(pa.float32()))})


def test_knn_batch_memory_does_not_follow_the_number_of_queries(spark, monkeypatch):
    r = np.random.default_rng(5)
    run = knn_task(spark, monkeypatch, r.standard_normal((4000, 4), np.float32), 3)
    batch = vector_batch(r.standard_normal((10_000, 4), np.float32))
    tracemalloc.start()
    try:
        found = run([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 12_000 and peak < 100 << 20


def test_knn_batch_in_tiles(spark, monkeypatch):
    """Tiles smaller than k, ties across tiles, copies, and values that are no numbers, which come last."""
    r = np.random.default_rng(6)
    v = r.integers(0, 3, (300, 3)).astype(np.float32)
    v[7], v[150] = np.nan, np.inf
    for metric in ("l2", "cosine"):
        run = knn_task(spark, monkeypatch, v[10:30], 5, metric)
        monkeypatch.setattr(knn, "TILE", 12, raising=False)
        monkeypatch.setattr(knn, "TILE_ROWS", 4, raising=False)
        found = run([vector_batch(v[:101]), vector_batch(v[101:], 101)])
        for i, q in enumerate(v[10:30].astype(float)):
            d = np.sqrt(((v - q) ** 2).sum(1)) if metric == "l2" else None
            if d is None:
                n = np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(q)
                d = np.where(n > 0, 1 - np.divide(v @ q, n, out=np.zeros(300), where=n > 0), 1)
            want = sorted((round(x, 9), j) for j, x in enumerate(d) if np.isfinite(v[j]).all())[:5]
            got = sorted((round(x, 9), j) for (a, j), x in found.items() if a == i)
            assert got == want if metric == "l2" else [x for x, _ in got] == [x for x, _ in want]


def test_hash_embed_search_ranks_by_the_rounded_distance(spark, tmp_path):
    """More than fifty chunks before one whose rounded distance is the same and whose id is smaller; a chunk of many words is read whole."""
    import duckdb

    from logloom.plans import queries

    words = lambda n: "the message of the system " + ".".join(["filler"] * n)
    rows = [(0, words(2001)), *((i, words(2000)) for i in range(1, 61)), (61, words(3000)), (62, ""), (63, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["hash_embed_search"]).fetchall()
    assert [x for x, _ in want] == [1, 100_001, 200_001, 300_001, 400_001]
    assert [(x["id"], x["distance"]) for x in queries.hash_embed_search(spark, str(tmp_path)).collect()] == want


def test_single_search_computes_each_vector_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string").select("id", embed.embed(F.col("t"), embed.HashEmbedder(4)).alias("embedding"))
    near = knn.knn(df, [1.0, 0.0, 0.0, 0.0], 2)
    assert near._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    mixed = spark.createDataFrame([(1, [1.0]), (2, None), (3, [3.0, 0.0]), (4, [2.0, 0.0])], "id long, embedding array<float>")
    assert [tuple(x) for x in knn.knn(mixed, [1.0, 0.0], 4).collect()] == [(4, 1.0), (3, 2.0)]


def test_hash_embedder_equals_word_by_word(monkeypatch):
    monkeypatch.setattr(embed, "TEXTS", 3, raising=False)
    texts = ["a b a", "", None, "Ä_1 x,y x", "storage " * 9, "z"]
    got = embed.HashEmbedder(5, n_ctx=4).encode(texts)
    for row, text in zip(got, texts):
        want = np.zeros(5, np.float32)
        for w in re.findall(r"\w+", (text or "").lower())[:4]:
            h = embed._word_hash(w)
            want[(h >> 1) % 5] += 1 if h & 1 else -1
        want = np.sign(want) * np.sqrt(np.abs(want))
        assert np.array_equal(row, want / (np.linalg.norm(want) or np.float32(1)))


def test_token_windows(spark):
    df = spark.createDataFrame([(100,), (50,), (1,)], "n int")
    got = [[(w["start"], w["end"]) for w in r[0]] for r in df.select(chunking.token_windows(F.col("n"), 50, 40)).collect()]
    assert got == [[(0, 50), (40, 90), (80, 100)], [(0, 50)], [(0, 1)]]
    with pytest.raises(ValueError):
        chunking.token_budget(30)


def test_file_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("IEF450I abend\n text\nABEND_0C4\nmore\n")
    (tmp_path / "b.md").write_text("")
    (tmp_path / "c.log").write_text("x")
    got = files.scan(spark, str(tmp_path), "txt,.md")
    assert [r["filename"].rsplit("/", 1)[1] for r in got.collect()] == ["a.txt"]
    assert files.read_files(spark, [str(tmp_path / "c.log")]).count() == 1
    assert files.parse_suffixes("txt,.md, ,") == [".txt", ".md"]
    entries = chunking.manual_entries(got).orderBy("block").collect()
    assert [(r["msgid"], r["severity"], r["full_text"]) for r in entries] == [("IEF450I", "I", "IEF450I abend\n text"), ("ABEND_0C4", " ", "ABEND_0C4\nmore")]


def test_subcodes():
    text = "System code 0Cx (S0Cx)\nExplanation: all\n0C1\nOperation exception\n0C4\nProtection\nSystem action\nEnds"
    got = etl.split_subcodes("ABEND_0Cx", text)
    assert [c for c, _ in got] == ["ABEND_0Cx", "ABEND_0C1", "ABEND_0C4"]
    assert got[2][1] == "System abend code 0C4 (S0C4)\n\nSystem code 0Cx (S0Cx)\nExplanation: all\n\nProtection\n\nSystem action\nEnds"


def test_streaming_ingest(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    line = "N 4000000 SYS1 2026087 17:{:02d}:00.00 JOB00001 00000090  IEF450I FAILED {}"
    (logs / "1.log").write_text("\n".join(line.format(m, m) for m in (0, 1, 6)))
    store = ChunkStore(spark, str(tmp_path / "store"))
    run = lambda: ingest.ingest(ingest.log_files(spark, str(logs)), store, str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(r["msg_count"] for r in store.read().collect()) == [1, 2]
    run()
    assert store.count() == 2
    (logs / "2.log").write_text("\n".join(line.format(m, m) for m in (5, 30)))
    run()
    assert sorted(r["ts_start"] for r in store.read().collect()) == ["17:00:00.00", "17:06:00.00", "17:30:00.00"]


def test_severity_windows_stream(spark, tmp_path):
    (tmp_path / "m").mkdir()
    spark.createDataFrame([("2026087", f"17:0{i}:00.00", "S", "E") for i in range(8)], "julian_date string, ts string, sysname string, severity string").write.mode("overwrite").parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("julian_date string, ts string, sysname string, severity string").parquet(str(tmp_path / "m"))
    q = ingest.severity_windows(stream).writeStream.format("memory").queryName("sevw").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["messages"] for r in spark.table("sevw").collect()) == [3, 5]


def test_since():
    now = 1_800_000_000 * 1_000_000
    assert ingest.since("nonsense", now) == -1
    assert ingest.since("2027-01-15T07:00", now) == 60
    assert ingest.since("2999-01-01", now) == 1


def test_bare_and_cache(spark, tmp_path):
    m = syslog.bare(spark.createDataFrame([("IEC030I E37-04",)], "value string")).first()
    assert (m["msgid"], m["severity"]) == ("IEC030I", "I")
    context = spark.createDataFrame([("IEF450I", 0.5, "ibm_doc", "f", "s", "", "", "IEF450I")], "msgid string, distance double, source_type string, filename string, snippet string, store_tag string, ts_start string, chunk_msgid string")
    path = str(tmp_path / "cache")
    render.save_cache(context, path, "k5", now=1000)
    assert render.load_cache(spark, path, 120, now=1100).count() == 1
    assert render.load_cache(spark, path, 120, now=1200).count() == 0


def test_index_summarize_enrich(spark, tmp_path):
    from logloom.plans import api

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("storage " * 300)
    (docs / "b.txt").write_text("network trouble")
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert api.index(spark, store, str(docs), "txt") == {"new": 2}
    assert store.read().where("filename LIKE '%a.txt [chunk %'").count() == 2
    assert api.index(spark, store, str(docs), "txt") == {"unchanged": 2}
    (docs / "b.txt").unlink()
    (docs / "c.txt").write_text("IEF450I explained")
    assert api.index(spark, store, str(docs), "txt") == {"unchanged": 1, "new": 1, "removed": 1}
    assert store.read().where("filename LIKE '%b.txt'").count() == 0

    lines = ["N 4000000 SYS1 2026087 17:3{}:00.00 JOB00001 00000090  {}".format(i, t) for i, t in enumerate(["IEF450I FAILED", "IEC030A NO SPACE", "IEF285I SKIPPED", "IEF450I FAILED"])]
    m = syslog.parse(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, line_no long, line string"))
    api.ingest(m, store)
    assert store.read().where("source_type = 'operlog'").count() == 0  # its only window may still grow
    for _ in range(2):
        api.ingest(m, store, complete=True)
    assert [r["msg_count"] for r in store.read().where("source_type = 'operlog'").collect()] == [3]
    s = {r["msgid"]: r for r in api.summarize(m, store.read()).collect()}
    assert (s["IEC030A"]["tier"], s["IEC030A"]["history_count"], s["IEF450I"]["count"]) == ("critical", 1, 2)
    text = render.summary_text(4, 3, api.summarize(m, store.read()))
    assert "IEC030A x1 -- NO SPACE" in text and "seen 1 times across 1 days" in text and "INFO (1 unique IDs, 2 total)" in text
    assert json.loads(render.summary_json(4, 3, api.summarize(m, store.read())))["groups"][0]["msgid"] == "IEC030A"
    unique, context = api.enrich(m, store.read(), k=2)
    rows = [json.loads(r["json"]) for r in render.enriched_json(unique, context).orderBy("seq").collect()]
    assert [r["msgid"] for r in rows] == ["IEF450I", "IEC030A"] and rows[0]["count"] == 2
    assert rows[0]["context"][0]["source_type"] == "operlog" and len(rows[0]["context"]) == 2

    hits = api.search_once(spark, str(docs), "storage", k=1).collect()
    assert "a.txt" in hits[0]["filename"]


def _log(spark, minutes, date="2026087"):
    lines = [f"N 4000000 SYS1 {date} 17:{m:02d}:00.00 JOB00001 00000090  IEF450I FAILED {m}" for m in minutes]
    return syslog.parse(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, line_no long, line string"))


def test_ingest_of_a_window_that_grows(spark, tmp_path):
    from logloom.plans import api

    store = ChunkStore(spark, str(tmp_path / "store"))
    metrics = render.Metrics()
    api.ingest(_log(spark, [0, 2]), store, metrics=metrics)
    api.ingest(_log(spark, [0, 2, 3, 6]), store, metrics=metrics)
    api.ingest(_log(spark, [0, 2, 3, 6, 7]), store, complete=True, metrics=metrics)
    api.ingest(_log(spark, [0, 2, 3, 6, 7, 8]), store, complete=True)
    got = sorted((r["ts_start"], r["ts_end"], r["msg_count"]) for r in store.read().collect())
    assert got == [("17:00:00.00", "17:03:00.00", 3), ("17:06:00.00", "17:07:00.00", 2), ("17:08:00.00", "17:08:00.00", 1)]
    assert (metrics.values["chunks"], metrics.values["messages"]) == (2, 5) and metrics.values["ingest_ms"] > 0


def test_short_dates_keep_their_zeros_and_compare_with_long_ones(spark, tmp_path):
    from logloom.plans import api

    store = ChunkStore(spark, str(tmp_path / "store"))
    api.ingest(_log(spark, [0], "05012"), store, complete=True)
    assert [r["julian_date"] for r in store.read().collect()] == ["05012"]
    assert store.read().where("julian_date = '05012'").count() == 1
    api.ingest(_log(spark, [0, 1], "2005012"), store, complete=True)
    assert sorted((r["julian_date"], r["msg_count"]) for r in store.read().collect()) == [("05012", 1), ("2005012", 1)]


def test_store_reads_one_day_only(spark, tmp_path):
    from logloom.plans import api

    store = ChunkStore(spark, str(tmp_path / "store"))
    for date in ("2026087", "2026088"):
        api.ingest(_log(spark, [0], date), store, complete=True)
    plan = keyword.timeline(store.read(), "2026088", "17:00").select("rowid")._jdf.queryExecution().executedPlan().toString()
    assert "2026088" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "embedding" not in plan


def test_hybrid_ties_go_to_the_keyword_list(spark):
    v = spark.createDataFrame([(i, "ABC001E" if i in (30, 31) else "", [1.0, float(i)]) for i in (1, 2, 30, 31)], "id long, msgid string, embedding array<float>")
    empty = ("filename", "snippet", "full_text", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date")
    c = v.withColumns({**{x: F.lit("") for x in empty}, "source_type": F.lit("operlog"), "msg_count": F.lit(1)})
    out = search("MSGID:ABC001E words", c, options=Options(k=4), vector=[1.0, 0.0]).collect()
    # keyword: 30, 31; semantic: 1, 2, 30, 31
    assert [r["rowid"] for r in out] == [30, 31, 1, 2] and [r["rank"] for r in out] == [1, 2, 3, 4]
    few = search("MSGID:ABC001E words", c.where("id < 31"), options=Options(k=4), vector=[1.0, 30.0]).collect()
    assert [r["rowid"] for r in few] == [30, 2, 1]
    tied = search("MSGID:ABC001E words", c.where("id IN (1, 30)"), options=Options(k=1), vector=[1.0, 0.0]).collect()
    assert [r["rowid"] for r in tied] == [30]


def test_absent_and_odd_files(spark, tmp_path):
    (tmp_path / "a[1].txt").write_text("x")
    with pytest.warns(UserWarning, match="no such file"):
        got = files.read_files(spark, [str(tmp_path / "a[1].txt"), str(tmp_path / "none.txt")]).collect()
    assert [r["content"] for r in got] == ["x"]
    plan = files.scan(spark, str(tmp_path)).select("filename", "mtime")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_streaming_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "N 4000000 {} 2026087 17:00:00.00 JOB00001 00000090  IEF450I FAILED"
    for n, s in enumerate(("SYS1", "SYS2")):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"data": {s: {"content": line.format(s), "content_length": 9}}, "system_logs": 1}))
    store = ChunkStore(spark, str(tmp_path / "store"))
    ingest.ingest(ingest.json_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["sysname"] for r in store.read().collect()) == ["SYS1", "SYS2"]


def test_pooled_embedder(spark):
    model = lambda tokens: np.array([[t, 1.0] for t in tokens])
    e = embed.PooledEmbedder(lambda t: [len(w) for w in t.split()], model, 2, n_ctx=3, prefix="x ")
    assert e.encode(["aaa bbbbb c", ""]).tolist() == [pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)]), pytest.approx([np.sqrt(0.5)] * 2)]
    e = embed.PooledEmbedder(lambda t: [len(w) for w in t.split()], model, 2, pooling="last")
    got = spark.createDataFrame([("a bb",), (None,)], "t string").select(embed.embed(F.col("t"), e).alias("v")).collect()
    assert list(got[0]["v"]) == pytest.approx([2 / np.sqrt(5), 1 / np.sqrt(5)]) and list(got[1]["v"]) == [0.0, 0.0]
    with pytest.raises(ValueError):
        embed.PooledEmbedder(str.split, model, 2, pooling="max")


def test_convert_vectors(spark):
    from logloom.plans import api

    blobs = [(np.array([0.5, -0.5, 0.1, 0.7], ">f4").tobytes(),), (np.array([0.5, -0.5, 0.1, 0.7], "<f4").tobytes(),)]
    got = api.convert_vectors(spark.createDataFrame([(bytearray(b[0]),) for b in blobs], "embedding binary")).collect()
    assert [[round(x, 3) for x in r[0]] for r in got] == [[0.5, -0.5, 0.1, 0.7]] * 2
