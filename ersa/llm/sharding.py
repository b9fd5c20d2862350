"""Sharding by extendible hashing: shards no larger than a byte limit, split only where needed.

Each row has a 64-bit hash key.  The directory maps key prefixes to shards: a shard is a prefix
of ``depth`` bits, and a prefix whose rows exceed the limit splits on its next bit, so only
oversized shards grow deeper.  The directory is found from sizes alone: one aggregate gives the
bytes under every prefix of a first, fine depth; sums over shorter prefixes of that small table
give the shallowest prefix that fits.  What still does not fit goes on, ``STEP_BITS`` at a time,
over the rows under oversized prefixes only.

Rows whose whole key is equal cannot be told apart by bits.  Such a bucket gets overflow pages:
its rows in content order, cut by running size.  The running sum is kept per block of rows, so
a hot key is not gathered in one task.  A single row above the limit is a page of its own.

Edge cases: a null text has 0 bytes and a null id hashes like any value; repeated rows share a
key and may meet in overflow pages; an empty table has no shards; other columns are carried
along by ``assign_shards`` under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ersa.llm.common import store

KEY_BITS = 60
STEP_BITS = 12
#: Rows of one overflow bucket that one task orders.
PAGE_BLOCK_ROWS = 20_000


def hash_key(*cols: str) -> Column:
    """The first 60 bits of the MD5 of the values as text: the same in any engine."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(key: Column, depth: Column | int) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", key, (F.lit(KEY_BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The shards of rows (key, bytes): depth, prefix, n_bytes; ``fits`` is false for full-depth overflow buckets."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    start = max(1, (max(1, total) // max(1, limit)).bit_length() + 2)
    shards, top, rest = None, 0, sizes
    depth = min(KEY_BITS, start)
    while True:
        # one scan: bytes under each prefix of `depth` bits; at most 2^depth rows, and at most total/limit
        # of them lead to a further round
        fine = store(rest.groupBy(_prefix(F.col("key"), depth).alias("fine")).agg(F.sum("bytes").alias("bytes")), "prefixes")
        levels = fine.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "fine", "bytes")
        sums = (levels.groupBy("depth", F.call_function("shiftright", F.col("fine"), (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"))
                .agg(F.sum("bytes").alias("n_bytes")).withColumn("fits", F.col("n_bytes") <= limit))
        parents = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        # a shard is a prefix that fits below a parent that does not (or the root of this round)
        found = sums.join(parents, (sums["depth"] == parents["depth"])
                          & (F.call_function("shiftright", sums["prefix"], F.lit(1)) == parents["parent"]), "left") \
            .where((parents["parent"].isNotNull() | (sums["depth"] == (0 if top == 0 else -1))) & (sums["fits"] | (sums["depth"] == KEY_BITS))) \
            .select(sums["depth"].cast("int").alias("depth"), "prefix", "n_bytes", "fits")
        shards = found if shards is None else shards.unionByName(found)
        over = store(sums.where(~F.col("fits") & (F.col("depth") == depth) & (F.col("depth") < KEY_BITS)).select("prefix"), "oversized")
        if depth == KEY_BITS or over.isEmpty():
            return store(shards, "directory")
        rest = store(rest.join(over, _prefix(F.col("key"), depth) == F.col("prefix"), "left_semi"), "rest")
        top, depth = depth, min(KEY_BITS, depth + STEP_BITS)


def assign_shards(df: DataFrame, limit: int, key: Column, size: Column, order: list[Column]) -> DataFrame:
    """Every row of ``df`` with shard_depth, shard_prefix, shard_page and shard_bytes.

    ``key``: a long of 60 bits; ``size``: the row's bytes; ``order``: what orders an overflow
    bucket's rows (equal rows may be dealt in any order, which leaves the same table).
    """
    rows = df.withColumn("__key", key).withColumn("__bytes", size)
    shards = directory(rows.select(F.col("__key").alias("key"), F.col("__bytes").alias("bytes")), limit)
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()]       # at most 61
    cut = F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("__key"), d).alias("p")) for d in sorted(depths)])
    whole = shards.where("fits").select("depth", "prefix", F.col("n_bytes").alias("shard_bytes"))
    # the directory at its global depth is as large as the deepest shard asks for; joining on the row's
    # own (depth, prefix) instead keeps it at one row per shard
    by_depth = rows.withColumn("__at", F.explode(cut)).select("*", F.col("__at.d").alias("__d"), F.col("__at.p").alias("__p")) \
        if len(depths) > 1 else rows.select("*", F.lit(depths[0] if depths else 0).alias("__d"),
                                             _prefix(F.col("__key"), depths[0] if depths else 0).alias("__p"))
    names = [*df.columns, "__key", "__bytes"]
    placed = by_depth.join(whole, (F.col("__d") == F.col("depth")) & (F.col("__p") == F.col("prefix"))) \
        .select(*[F.col(f"`{c}`") for c in names], F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"),
                F.lit(0).cast("long").alias("shard_page"), "shard_bytes")
    buckets = shards.where(~F.col("fits")).select(F.col("prefix").alias("__key"))
    if buckets.isEmpty():
        return placed.drop("__key", "__bytes")
    return placed.unionByName(_overflow(rows, buckets, limit, order)).drop("__key", "__bytes")


def _overflow(rows: DataFrame, buckets: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """Pages of the buckets of equal keys: running bytes, by blocks, cut at the limit."""
    hot = rows.join(buckets, "__key", "left_semi")
    content = hot.withColumn("__o", F.xxhash64(*order))
    n = hot.groupBy("__key").agg(F.count("*").alias("__n"))
    blocked = content.join(n, "__key").withColumn(
        "__block", F.call_function("shiftrightunsigned", F.col("__o"), F.lit(1)) % F.greatest(F.lit(1), F.ceil(F.col("__n") / PAGE_BLOCK_ROWS)))
    # a page holds whole rows: blocks start new pages, so no running state crosses tasks; inside a block a
    # row opens a page when the bytes before it pass a multiple of the limit less the largest row
    inside = Window.partitionBy("__key", "__block").orderBy("__o", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = Window.partitionBy("__key", "__block")
    step = F.greatest(F.lit(1), F.lit(limit) - F.coalesce(F.max(F.when(F.col("__bytes") <= limit, F.col("__bytes"))).over(usable), F.lit(0)) + 1)
    run = blocked.withColumn("__run", F.sum("__bytes").over(inside) - F.col("__bytes")) \
        .withColumn("__page", F.floor(F.col("__run") / step)).withColumn("__big", F.col("__bytes") > limit)
    heads = run.groupBy("__key", "__block", "__page", "__big", F.when(F.col("__big"), F.col("__run")).alias("__own")) \
        .agg(F.sum("__bytes").alias("shard_bytes"))
    heads = heads.withColumn("shard_page", F.row_number().over(
        Window.partitionBy("__key").orderBy("__block", "__page", "__big", "__own")).cast("long"))
    keep = rows.columns
    joined = run.alias("r").join(heads.alias("h"), (F.col("r.__key") == F.col("h.__key")) & (F.col("r.__block") == F.col("h.__block"))
                                 & (F.col("r.__page") == F.col("h.__page")) & (F.col("r.__big") == F.col("h.__big"))
                                 & F.when(F.col("r.__big"), F.col("r.__run")).eqNullSafe(F.col("h.__own")))
    return joined.select(*[F.col(f"r.`{c}`") for c in keep], F.lit(KEY_BITS).alias("shard_depth"),
                         F.col("r.__key").alias("shard_prefix"), F.col("h.shard_page"), F.col("h.shard_bytes"))


def shard_documents(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of the text) and the shard of every document."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"))
    return assign_shards(slim, limit, hash_key("doc_id"), F.col("n_bytes"), [F.col("doc_id"), F.col("n_bytes")])


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` with all their columns as Parquet, one folder (``shard``) per shard; a shard fits one task by its byte limit.

    Rows carry their shard through the assignment and are not joined to it, so null and repeated ids are written as they are.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"))
    placed = assign_shards(packed, limit, hash_key("doc_id"), F.col("n_bytes"), [F.col("doc_id"), F.col("n_bytes")])
    shard = F.concat_ws("-", "shard_depth", "shard_prefix", "shard_page").alias("shard")
    placed.select("row.*", shard).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
