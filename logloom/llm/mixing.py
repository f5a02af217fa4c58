"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Every source's documents are put in a fixed pseudo-random order and cut into blocks of
``block_docs``.  Target weights become integer quotas n of a frame of ``slots`` slots (largest
remainder, at least one each).  Block i of a source is released at slot floor(i * slots / n)
and due by slot ceil((i + 1) * slots / n).  Each slot takes, of the released blocks, the one
with the earliest deadline.  As the quotas add up to the frame, every deadline is met, so
until a source runs out each prefix holds its target share to within less than one block;
slots of a source that has run out stay empty and no row is dropped.

One frame is simulated, in an ``aggregate`` expression over one row; it repeats for ever, so
the slot of any block follows from its number.  Sources of one quota share their windows, so a
slot compares one block for each quota that occurs.  The work over documents is one window over
(source, bucket), where a bucket is a hash range of about ``bucket_docs`` documents (by default
a fourth of a shuffle partition's share): a source with a third of all rows is as many buckets
as it needs.

Defined results: a null source is a source of its own; a source without a weight gets the
least quota, one slot; repeated rows get places of their own; an empty table gives an empty
result.

A frame has ``SLOTS`` slots, and ``PER_SOURCE`` more for each source beyond as many, so there is room
for any number of sources and one source more never changes the method; a frame of given ``slots`` has
room for that many sources.  Quotas are rounded: a source drifts from its weight by a fixed number of
blocks a frame.  On request only (``exact``) there is no frame: block i of a source of weight w has the
virtual time (i + phase) / w, and a block's slot is its rank by that time.  Phases are multiples of the
golden ratio, so the sources' blocks interleave; no deviation adds up with the table.  There a source
without a weight gets the least weight of any.  One row a source, and one a slot, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import n_partitions, table

SLOTS = 1000
PER_SOURCE = 10
BLOCK_DOCS = 32
_GOLDEN, _RANGE = 0.6180339887498949, 4096
_KEY, _HASH, _BUCKET = "__mix_source", "__mix_hash", "__mix_bucket"


def _weighted(counts: DataFrame, weights: DataFrame | None, alpha: float) -> DataFrame:
    if weights is None:
        return counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        return counts.join(weights.select(F.col(weights.columns[0]).alias(_KEY), F.col(weights.columns[1]).cast("double").alias("weight")), _KEY, "left").fillna({"weight": 0.0})


def quotas(counts: DataFrame, weights: DataFrame | None = None, slots: int | None = None, alpha: float = 0.5) -> DataFrame:
    """Per source key: n_docs and quota.  Without weights (key, weight), a source's weight is n_docs ** alpha."""
    w = _weighted(counts, weights, alpha)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("n_sources", F.count("*").over(every))
    if slots is None:
        w = w.withColumn("slots", SLOTS + PER_SOURCE * F.greatest(F.col("n_sources") - SLOTS, F.lit(0)))
    else:
        w = w.withColumn("slots", F.lit(slots)).where(F.assert_true(F.col("n_sources") <= slots, F.lit(f"more than {slots} sources")).isNull())
    # One slot for each source, the rest by largest remainder.
    share = F.round(F.col("weight") / F.sum("weight").over(every) * (F.col("slots") - F.col("n_sources")), 6)
    w = w.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("quota", F.floor("share").cast("int") + 1)
    left = F.col("slots") - F.sum("quota").over(every)
    rank = F.row_number().over(every.orderBy((F.floor("share") - F.col("share")), F.col(_KEY)))
    w = w.withColumn("left", left).withColumn("rank", rank)
    return w.select(_KEY, "n_docs", (F.col("quota") + (F.col("rank") <= F.col("left")).cast("int")).alias("quota"))


def frame(quota: DataFrame, slots: int | None = None) -> DataFrame:
    """The earliest-deadline-first schedule of one frame, by default of as many slots as the quotas add up to.

    Source key, k (its k-th block), slot, slots.
    """
    same = quota.groupBy(F.col("quota").alias("n")).agg(F.array_sort(F.collect_list(_KEY)).alias("keys"))
    total = F.sum(F.col("n").cast("long") * F.size("keys")) if slots is None else F.lit(slots).cast("long")
    one = same.agg(F.array_sort(F.collect_list(F.struct("n", "keys", F.size("keys").alias("m")))).alias("src"), total.alias("slots")).where(F.size("src") > 0)
    length = F.col("slots")

    # The sources of a quota take turns, so the number of their blocks done tells the next one.
    def block(done, s):
        k = F.floor(done / s["m"])
        due, release = F.ceil((k + 1) * length / s["n"]), F.floor(k * length / s["n"])
        key = s["keys"][(done % s["m"]).cast("int")]
        return F.when(k < s["n"], F.struct(due.alias("due"), key.alias("key"), s["n"].alias("n"), release.alias("release"), done.alias("done")))

    def step(state, t):
        best = F.array_min(F.transform(state["next"], lambda x: F.when(x["release"] <= t, x)))

        def take(b):
            after = F.zip_with(state["next"], F.col("src"), lambda x, s: F.when(x["n"] == b["n"], block(x["done"] + 1, s)).otherwise(x))
            return F.struct(after.alias("next"), F.concat(state["picked"], F.array(b["key"])).alias("picked"))

        return F.transform(F.array(best), take)[0]  # a lambda's argument is computed once

    # In stretches, so that a slot's pick copies the picks of its stretch only.
    def stretch(state, i):
        none = F.struct(state["next"].alias("next"), F.array().cast("array<string>").alias("picked"))
        out = F.aggregate(F.sequence(i * SLOTS, F.least((i + 1) * SLOTS, length) - 1), none, step)
        return F.transform(F.array(out), lambda o: F.struct(o["next"].alias("next"), F.concat(state["picked"], F.array(o["picked"])).alias("picked")))[0]

    first = F.transform("src", lambda s: block(F.lit(0).cast("long"), s))
    start = F.struct(first.alias("next"), F.array().cast("array<array<string>>").alias("picked"))
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / SLOTS))
    picked = F.aggregate(stretches, start, stretch, lambda s: F.flatten(s["picked"]))
    flat = one.select("slots", F.posexplode(picked).alias("slot", _KEY))
    return flat.withColumn("k", F.row_number().over(Window.partitionBy(_KEY).orderBy("slot")) - 1)


def times(counts: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """Per source key: n_docs, weight, phase and every (the sum of the weights)."""
    w = _weighted(counts, weights, alpha)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    w = w.withColumn("weight", F.coalesce("weight", F.min("weight").over(every), F.lit(1.0)))
    rank = F.row_number().over(every.orderBy(F.col("weight").desc(), F.col(_KEY)))
    return w.select(_KEY, "n_docs", "weight", ((rank * F.lit(_GOLDEN)) % 1).alias("phase"), F.sum("weight").over(every).alias("every"))


def ranked_blocks(source: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source key, block, slot) of every block, by its virtual time; ranges of time are ranked apart."""
    last = F.floor((F.col("n_docs") - 1) / block_docs)
    blocks = source.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = blocks.withColumn("time", (F.col("block") + F.col("phase")) / F.col("weight"))
    blocks = blocks.select(_KEY, "block", "time", F.floor(F.col("time") * F.col("every") / _RANGE).alias("range"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("time", _KEY))
    return blocks.withColumn("rank", rank).join(sums, "range").select(_KEY, "block", (F.col("before") + F.col("rank") - 1).alias("slot"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
    slots: int | None = None,
    alpha: float = 0.5,
    bucket_docs: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """docs with mix_block (the source's block), mix_slot and mix_offset; order by the last two to read the mixture.

    slots: of a frame; by default SLOTS, and PER_SOURCE more for each source beyond as many.
    exact: slots by virtual time instead of a frame.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.withColumns({_KEY: key, _HASH: digest})
    counts = docs.groupBy(key.alias(_KEY)).agg(F.count("*").alias("n_docs"))
    if weights is not None:
        weights = weights.select(F.concat(F.lit("s"), F.col(weights.columns[0]).cast("string")), weights.columns[1])
    quota = times(counts, weights, alpha) if exact else quotas(counts, weights, slots, alpha)
    # One row a source; of a frame at most one for each slot.
    share = F.sum("n_docs").over(Window.partitionBy(F.lit(0))) / (4 * n_partitions(docs.sparkSession))
    source = F.broadcast(quota.withColumn("buckets", F.ceil(F.col("n_docs") / (share if bucket_docs is None else bucket_docs))))
    head = F.conv(F.substring(_HASH, 1, 8), 16, 10).cast("long")
    bucket = F.floor(head * F.col("buckets") / F.lit(1 << 32)).cast("int")

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(source, _KEY).withColumn(_BUCKET, bucket).drop("n_docs", "buckets", "weight", "phase", "every")

    own = bucketed(docs.select(key.alias(_KEY), digest.alias(_HASH))).groupBy(_KEY, _BUCKET).agg(F.count("*").alias("n"))
    before = Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(_KEY, _BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_before"), "n")
    if exact:
        # The slots of a bucket's blocks travel with its offset, so the documents meet them without another exchange.
        first, last = F.floor(F.col("__mix_before") / block_docs), F.floor((F.col("__mix_before") + F.col("n") - 1) / block_docs)
        spread = offsets.withColumn("block", F.explode(F.sequence(first, last))).join(ranked_blocks(quota, block_docs), [_KEY, "block"])
        offsets = spread.groupBy(_KEY, _BUCKET, "__mix_before").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("__mix_slots"))
    else:
        offsets = offsets.drop("n")
    rank = F.row_number().over(Window.partitionBy(_KEY, _BUCKET).orderBy(_HASH, F.col(id_col)))
    out = bucketed(keyed).withColumn("__mix_rank", rank).join(offsets, [_KEY, _BUCKET])
    out = out.withColumn("__mix_at", F.col("__mix_before") + F.col("__mix_rank") - 1)
    out = out.withColumns({"mix_block": F.floor(F.col("__mix_at") / block_docs), "mix_offset": (F.col("__mix_at") % block_docs).cast("int")})
    kept = [docs[c] for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_offset")]
    if exact:
        at = F.col("mix_block") - F.floor(F.col("__mix_before") / block_docs)
        return out.withColumn("mix_slot", F.col("__mix_slots")[at.cast("int")]["slot"].cast("long")).select(*kept, "mix_block", "mix_slot", "mix_offset")
    out = out.withColumn("__mix_k", (F.col("mix_block") % F.col("quota")).cast("int")).withColumnRenamed("quota", "__mix_quota")
    plan = F.broadcast(frame(quota).select(F.col(_KEY), F.col("k").alias("__mix_k"), F.col("slot").alias("__mix_slot"), F.col("slots").alias("__mix_slots")))
    out = out.join(plan, [_KEY, "__mix_k"])
    slot = F.floor(F.col("mix_block") / F.col("__mix_quota")) * F.col("__mix_slots") + F.col("__mix_slot")
    return out.withColumn("mix_slot", slot.cast("long")).select(*kept, "mix_block", "mix_slot", "mix_offset")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows laid out in mixing order over range partitions."""
    return mixed.orderBy("mix_slot", "mix_offset")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op9_mixing": op9_mixing}


def oracle(docs: str = "documents", keep: str = "doc_id, source") -> str:
    """DuckDB SQL of the mixture of a relation with doc_id and source."""
    return f"""
WITH RECURSIVE src AS (
  SELECT coalesce('s' || source, 'null') AS key, count(*) AS n_docs FROM {docs} GROUP BY 1),
sh AS (
  SELECT key, n_docs, round(sqrt(n_docs) / sum(sqrt(n_docs)) OVER () * ({SLOTS} - count(*) OVER ()), 6) AS share FROM src),
qu AS (
  SELECT key, CAST(floor(share) AS INT) + 1 + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, key)
           <= {SLOTS} - sum(CAST(floor(share) AS INT) + 1) OVER () THEN 1 ELSE 0 END AS n FROM sh),
li AS (SELECT list(key ORDER BY key) AS keys, list(n ORDER BY key) AS ns FROM qu),
sim AS (
  SELECT -1 AS t, [0 FOR x IN ns] AS done, CAST(NULL AS BIGINT) AS pick FROM li
  UNION ALL
  SELECT t + 1, [d + CASE WHEN i = best THEN 1 ELSE 0 END FOR d, i IN done], best
  FROM (
    SELECT t, done, list_min([CASE WHEN d < ns[i] AND floor(d * {SLOTS} / ns[i]) <= t + 1
                                   THEN ceil((d + 1) * {SLOTS} / ns[i]) * 100000 + i END FOR d, i IN done]) % 100000 AS best
    FROM (SELECT t, done FROM sim WHERE t < {SLOTS} - 1), li)),
fr AS (
  SELECT keys[CAST(pick AS BIGINT)] AS key, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k
  FROM sim, li WHERE t >= 0),
po AS (
  SELECT *, coalesce('s' || source, 'null') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p FROM {docs})
SELECT {keep}, CAST(p // {BLOCK_DOCS} AS BIGINT) AS mix_block,
       CAST((p // {BLOCK_DOCS}) // n * {SLOTS} + slot AS BIGINT) AS mix_slot, CAST(p % {BLOCK_DOCS} AS INT) AS mix_offset
FROM po JOIN qu USING (key) JOIN fr ON fr.key = po.key AND fr.k = (p // {BLOCK_DOCS}) % n"""


def oracle_exact(docs: str = "documents", keep: str = "doc_id, source") -> str:
    """DuckDB SQL of the exact mixture, by virtual time, of a relation with doc_id and source."""
    return f"""
WITH src AS (SELECT coalesce('s' || source, 'null') AS key, count(*) AS n_docs, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM {docs} GROUP BY 1),
ph AS (SELECT *, (row_number() OVER (ORDER BY weight DESC, key) * CAST({_GOLDEN} AS DOUBLE)) % 1 AS phase FROM src),
bl AS (SELECT key, b, (b + phase) / weight AS time FROM ph, unnest(range(0, (n_docs - 1) // {BLOCK_DOCS} + 1)) AS u(b)),
sl AS (SELECT key, b, row_number() OVER (ORDER BY time, key) - 1 AS slot FROM bl),
po AS (
  SELECT *, coalesce('s' || source, 'null') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p FROM {docs})
SELECT {keep}, CAST(b AS BIGINT) AS mix_block, CAST(slot AS BIGINT) AS mix_slot, CAST(p % {BLOCK_DOCS} AS INT) AS mix_offset
FROM po JOIN sl ON sl.key = po.key AND sl.b = p // {BLOCK_DOCS}"""


ORACLE_SQL = {"op9_mixing": oracle()}
