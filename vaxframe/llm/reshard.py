"""Resharding by minimum-cost flow.

Old shard sizes and new capacities form a small transport problem: a byte that stays costs nothing, one that
moves costs one. The flow says how many bytes go from each old shard to each new one; blocks of documents
then realise it. The problem has as many nodes as there are shards, whatever the corpus, so it is solved on
the driver; documents are only counted and cut in blocks on the executors.

The law is ``bytes``: shard sizes differ by little more than one small document per transfer. Inside an old
shard documents lie in size order, largest first, so what moves is the tail of small ones and every cut falls
between small documents.

Defined results: a null text has size 1 and the checksum of an empty one; documents without an id are dealt
over the old shards by their text; rows alike are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaxframe.llm.keys import maybe_in, row_key, without
from vaxframe.sources.scratch import stage

OLD_SHARDS, NEW_SHARDS = 12, 16
#: Documents in a block, as expected; blocks of one size class are split until they have no more.
BLOCK_ROWS = 50_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units to send from i to j, at least cost; successive shortest paths over at most a few dozen nodes."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    arcs: list[list] = []  # [to, room, cost]; the reverse of arc k is k ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, price: int) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(arcs))
            arcs.append([y, r, p])

    for i, have in enumerate(supply):
        arc(source, i, have, 0)
        for j in range(m):
            arc(i, n + j, have, cost(i, j))
    for j, room in enumerate(capacity):
        arc(n + j, sink, room, 0)
    while True:
        dist, by = {source: 0}, {}
        queue = [source]
        while queue:  # label correcting; reverse arcs have negative cost
            nearer = []
            for x in queue:
                for k in out[x]:
                    y, room, price = arcs[k]
                    if room > 0 and dist[x] + price < dist.get(y, 1 << 62):
                        dist[y], by[y] = dist[x] + price, k
                        nearer.append(y)
            queue = nearer
        if sink not in dist:
            break
        path, y = [], sink
        while y != source:
            path.append(by[y])
            y = arcs[by[y] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    flow = {}
    for i in range(n):
        for k in out[i]:
            if k % 2 == 0 and arcs[k ^ 1][1] > 0:
                flow[i, arcs[k][0] - n] = arcs[k ^ 1][1]
    return flow


def transfer_plan(sizes: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new): the byte ranges of each old shard and where they go; what stays comes first."""
    total = sum(sizes)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(sizes, capacity, lambda i, j: int(i != j))
    plan = []
    for old in range(len(sizes)):
        at = 0
        for new in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):
            plan.append((old, at, at + flow[old, new], new))
            at += flow[old, new]
    return plan


def assign(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """doc_id, row key, size, text_crc32, old_shard, shard and slot of every document. The text is read once and not shuffled."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        "doc_id", row_key().alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid")), "sizes")
    n_rows = rows.count()
    parts = max(1, -(-n_rows // (old_shards * BLOCK_ROWS)))
    placed = rows.select(
        "*", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.col("key")).alias("spread")
    ).select(
        "doc_id", "key", "size", "text_crc32", "uid", F.pmod("spread", F.lit(old_shards)).cast("int").alias("old_shard"),
        (-F.floor(F.log2("size") * 4)).cast("int").alias("klass"), F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"))
    block = ["old_shard", "klass", "part"]
    blocks = stage(placed.groupBy(*block).agg(F.sum("size").alias("bytes")), "blocks")
    sizes = [0] * old_shards
    for old, n in blocks.groupBy("old_shard").agg(F.sum("bytes")).collect():  # a number per old shard
        sizes[old] = n
    plan = spark.createDataFrame(transfer_plan(sizes, new_shards), "old_shard int, lo long, hi long, shard int")
    upto = Window.partitionBy("old_shard").orderBy("klass", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*block, F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*block).orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, block)
        .withColumn("at", F.col("offset") + F.col("before")).join(F.broadcast(plan), "old_shard").where("at >= lo and at < hi")
        .drop("lo", "hi", "offset", "before", "at")
    )
    moved = stage(cut, "moved")
    pieces = moved.groupBy("shard", *block).agg(F.count("*").alias("n"))
    first = Window.partitionBy("shard").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("shard", *block, F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", *block).orderBy("uid")) - 1
    return moved.withColumn("number", number).join(starts, ["shard", *block]).select(
        "doc_id", "key", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"))


def _occurrences(rows: DataFrame, part) -> DataFrame:
    """Adds occurrence, which numbers the rows of each key from 0. A key's rows are numbered part by part, ``_at`` orders a part."""
    rows = stage(rows.withColumn("_part", part), "repeats")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_key", "_part").agg(F.count("*").alias("n")).select("_key", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_at")) - 1
    return rows.withColumn("number", number).join(first, ["_key", "_part"]).withColumn("occurrence", F.col("first") + F.col("number")).drop("_part", "_at", "number", "first")


def rewrite(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the files of every shard that gains or loses documents, one folder ``_shard=`` a shard; other shards keep their files.

    Each row of ``docs`` goes to one place, with its own columns and ``_slot``; input columns ``_shard`` and ``_slot`` are an
    older layout's and are replaced. Rows alike in id and text are matched with their places by number.
    """
    moves = assigned.where("old_shard <> shard")
    touched = stage(moves.selectExpr("explode(array(old_shard, shard)) as shard").distinct(), "touched")  # a row per shard at most
    columns = [c for c in docs.columns if c.lower() not in ("_shard", "_slot")]
    rows = docs.select(row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    places = assigned.join(F.broadcast(touched), "shard", "left_semi").selectExpr("key as _key", "shard as _shard", "slot as _slot")
    repeated = stage(assigned.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").selectExpr("key as _key"), "repeated")
    single = without(rows, "_key", repeated).join(places.join(repeated, "_key", "left_anti"), "_key")
    # Rows alike have one old shard: of a key either all rows are in touched shards or none is.
    several = maybe_in(rows, "_key", repeated).join(repeated, "_key", "left_semi").withColumn("_at", F.monotonically_increasing_id())
    dealt = places.join(repeated, "_key", "left_semi").withColumn("_at", F.col("_slot"))
    several = _occurrences(several, F.shiftright("_at", 33)).join(
        _occurrences(dealt, F.col("_shard") * F.lit(1 << 32) + F.floor(F.col("_slot") / BLOCK_ROWS)), ["_key", "occurrence"])
    out = single.select("_row.*", "_shard", "_slot").unionByName(several.select("_row.*", "_shard", "_slot"))
    out.write.partitionBy("_shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    left = touched.join(assigned.select("shard").distinct(), "shard", "left_anti").collect()  # shards that lose everything
    for shard in left:
        out.drop("_shard").limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_shard={shard[0]}")


def shards_digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
