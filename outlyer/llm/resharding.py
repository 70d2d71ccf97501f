"""Resharding by minimum-cost flow: new capacities, fewest bytes moved.

Sizes of the old shards and capacities of the new ones make a transport problem whose graph has
a node per shard, whatever the number of documents. A flow of least cost says how many bytes each
old shard hands to each new one; by default a byte that stays costs 0 and one that moves costs 1.
Documents are then cut along each old shard's byte line: first what stays, then one run for each
receiving shard. A document goes where its middle falls, so a shard misses its capacity by at most
half a document for each cut.

The byte line is a two-level prefix sum: documents fall into blocks of about ``BLOCK_ROWS`` rows,
blocks are summed along a shard, documents inside a block. No task sees a whole shard's documents.
Documents that are large against a shard come first, largest first, so that cuts fall among small
ones; all others lie in hash order.

Defined cases: null text has no bytes; null ids are allowed; repeated rows are placed one by one
(which of two identical rows gets which slot does not matter); an empty table gives an empty
result; copies of a text are not held together, as equal sizes come first.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.llm.common import crc_of_id, scratch, text_of

#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
BLOCK_ROWS = 1024
#: Up to so many places (20 bytes each) are broadcast.
BROADCAST_PLACES = 500_000
#: A document over this part of a shard's capacity counts as large.
LARGE = 1 / 200


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at least total cost (successive shortest paths).

    All supply is placed; capacities are upper bounds and must hold it.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards cannot hold the old ones")
    nodes = ["s", *(("o", i) for i in supply), *(("n", j) for j in capacity), "t"]
    at = {x: k for k, x in enumerate(nodes)}
    edges: list[list[int]] = []  # to, room, cost; the reverse of edge e is e ^ 1
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a: int, b: int, room: int, price: float) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(edges))
            edges.append([y, r, p])

    for i, n in supply.items():
        arc(at["s"], at["o", i], n, 0)
        for j in capacity:
            arc(at["o", i], at["n", j], n, cost(i, j))
    for j, n in capacity.items():
        arc(at["n", j], at["t"], n, 0)
    s, t = at["s"], at["t"]
    while True:
        far = [float("inf")] * len(nodes)
        via = [-1] * len(nodes)
        far[s], queue, queued = 0, deque([s]), {s}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out[x]:
                y, room, price = edges[e]
                if room > 0 and far[x] + price < far[y]:
                    far[y], via[y] = far[x] + price, e
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        if via[t] < 0:
            break
        path, y = [], t
        while y != s:
            path.append(via[y])
            y = edges[via[y] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    sent = {}
    for i in supply:
        for e in out[at["o", i]]:
            y, _, _ = edges[e]
            if y != s and edges[e ^ 1][1] > 0 and not e & 1:
                sent[i, nodes[y][1]] = edges[e ^ 1][1]
    return sent


def fewest_moves(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """The flow of least cost where staying costs 0 and moving costs 1, in one pass over the shards.

    What fits stays; what is left of each shard goes to the next that has room. Each shard keeps as much as any
    flow could leave it, so no flow moves less.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards cannot hold the old ones")
    sent = {(i, i): min(n, capacity[i]) for i, n in supply.items() if min(n, capacity.get(i, 0)) > 0}
    room = iter([(j, n - sent.get((j, j), 0)) for j, n in capacity.items() if n > sent.get((j, j), 0)])
    j, free = None, 0
    for i, n in supply.items():
        left = n - sent.get((i, i), 0)
        while left > 0:
            if not free:
                j, free = next(room)
            part = min(left, free)
            sent[i, j] = sent.get((i, j), 0) + part
            left, free = left - part, free - part
    return sent


def even_capacities(total: int, shards: int) -> dict[int, int]:
    """``total`` bytes dealt evenly, the remainder to the first shards."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(docs: DataFrame, old_shard: Column, capacities=None, shards: int | None = None, cost=None, size: Column | None = None) -> DataFrame:
    """``docs`` with old_shard, size, text_crc32, shard and slot (gapless from 0 in each shard).

    ``old_shard`` is an integer column expression from 0 on, never null. ``capacities`` maps new
    shards to bytes; without it ``shards`` even ones are made. Only doc_id and text are read, and
    the result has those derived columns beside doc_id; join it to the documents, or use
    :func:`assign` to have them added.
    """
    size = F.octet_length(text_of()) + RECORD_BYTES if size is None else size
    rows = scratch(
        docs.select("doc_id", size.cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard")), "sizes"
    )
    sizes = rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # a row a shard
    supply = {r.old_shard: r.bytes for r in sizes}
    capacities = even_capacities(sum(supply.values()), shards) if capacities is None else capacities
    flow = min_cost_flow(supply, capacities, cost) if cost else fewest_moves(supply, capacities)
    arcs = []
    for i in supply:
        start = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            arcs.append((i, j, 2 * start, 2 * (start + flow[i, j])))
            start += flow[i, j]
    arcs = docs.sparkSession.createDataFrame(arcs, "old_shard int, shard int, lo long, hi long")

    blocks = max(1, sum(r.n for r in sizes) // (BLOCK_ROWS * max(1, len(sizes))))
    large = F.col("size") > max(1.0, min(capacities.values(), default=0) * LARGE)
    rows = rows.withColumn("block", F.when(large, -1).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int")))
    along = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).select("old_shard", "block", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("start"))
    order = [F.when(F.col("block") == -1, -F.col("size")), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    inside = Window.partitionBy("old_shard", "block").orderBy(*order)
    placed = (
        rows.join(starts, ["old_shard", "block"])
        .withColumn("middle", 2 * (F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size"))
        .alias("d")
        # arcs has a row for each pair of shards at most
        .join(F.broadcast(arcs.alias("a")), F.expr("d.old_shard = a.old_shard and d.middle >= a.lo and d.middle < a.hi"))
        .select("d.*", "a.shard")
        .withColumn("nth", F.row_number().over(Window.partitionBy("old_shard", "block", "shard").orderBy(*order)) - 1)
        .drop("start", "middle")
    )
    placed = scratch(placed, "placed")
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.join(offsets, ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot")
    )


def hash_layout(shards: int) -> Column:
    """The layout of a corpus that was dealt by crc32 of its ids."""
    return F.pmod(crc_of_id(), F.lit(shards)).cast("int")


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (a scratch table with ``__uid``) with ``__nth``, counting rows of equal key from 0.

    A key's rows are counted by the part of the table that they lie in, and inside each part, so that no task sees all of
    a key that very many rows share.
    """
    rows = rows.withColumn("__part", F.shiftright("__uid", 33))
    along = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    before = before.select(*(F.col(c).alias(f"__k_{c}") for c in key), F.col("__part").alias("__k_part"), "__before")
    inside = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__uid")) - 1
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key] + [F.col("__part") == F.col("__k_part")]
    return rows.withColumn("__in", inside).join(before, same).withColumn("__nth", F.col("__before") + F.col("__in")).drop("__in", "__before", "__part", "__k_part", *(f"__k_{c}" for c in key))


def assign(docs: DataFrame, old_shard: Column, keep_old: bool = False, **options) -> DataFrame:
    """``docs``, all columns kept, with shard and slot, and old_shard if ``keep_old`` (columns of those names are replaced).

    Every row has a place of its own, rows that share an id or have none too: those rows, which should be
    few, are told apart by size, hash of the text and a running number.
    """
    new = ["shard", "slot", *(["old_shard"] if keep_old else [])]
    places = scratch(reshard(docs, old_shard, **options).withColumn("__uid", F.monotonically_increasing_id()), "places")
    repeated = scratch(places.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id")), "repeated")
    docs = docs.drop(*(c for c in docs.columns if c in new))
    n = repeated.count()
    of = lambda rows, how: rows.join(F.broadcast(repeated) if n <= BROADCAST_PLACES else repeated, rows["doc_id"].eqNullSafe(F.col("__id")), how)
    unique = places.select(F.col("doc_id").alias("__id"), *new) if not n else of(places, "left_anti").select(F.col("doc_id").alias("__id"), *new)
    if places.count() <= BROADCAST_PLACES:  # some integers a row; else the documents are shuffled by id
        unique = F.broadcast(unique)
    placed = docs.join(unique, docs["doc_id"] == F.col("__id")).drop("__id")
    if not n:
        return placed
    size = options.get("size")
    size = F.octet_length(text_of()) + RECORD_BYTES if size is None else size
    rows = scratch(of(docs, "left_semi").withColumn("__size", size.cast("long")).withColumn("__crc", F.crc32(text_of().cast("binary"))).withColumn("__old", old_shard.cast("int")).withColumn("__uid", F.monotonically_increasing_id()), "repeated_rows")
    rows = numbered(rows, ["doc_id", "__size", "__crc", "__old"])
    own = numbered(of(places, "left_semi"), ["doc_id", "size", "text_crc32", "old_shard"]).select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__s"), F.col("text_crc32").alias("__c"), F.col("old_shard").alias("__o"), F.col("__nth").alias("__k"), *new
    )
    same = rows["doc_id"].eqNullSafe(own["__id"]) & (rows["__size"] == own["__s"]) & (rows["__crc"] == own["__c"]) & (rows["__old"] == own["__o"]) & (rows["__nth"] == own["__k"])
    return placed.unionByName(rows.join(own, same).select(*docs.columns, *new))


def rewrite_affected(placed: DataFrame, target: str) -> DataFrame:
    """Rewrite in ``target`` (one folder a shard) only the shards that a row enters or leaves; the others keep their files.

    ``placed`` has shard, slot and old_shard (see :func:`assign`) and may be read from ``target`` itself: new files are
    written to a folder beside it and then take the old ones' place, shard by shard; a shard that ends empty loses
    its folder. Rows are written as they stand, so rows that share an id or have none are neither lost nor doubled.
    Returns ``shard, rows_in, rows_out`` of the affected shards.
    """
    spark = placed.sparkSession
    moved = placed.where("shard <> old_shard")
    affected = scratch(
        moved.select(F.col("shard"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        .unionAll(moved.select("old_shard", F.lit(0), F.lit(1)))
        .groupBy("shard")
        .agg(F.sum("i").alias("rows_in"), F.sum("o").alias("rows_out")),
        "affected",
    )
    shards = [r.shard for r in affected.select("shard").collect()]  # a row a shard
    root = target.rstrip("/")
    staged = f"{root}_staged_{uuid.uuid4().hex}"
    rows = placed.join(F.broadcast(affected.select("shard")), "shard", "left_semi").drop("old_shard")
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).write.partitionBy("shard").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(root))
    for k in shards:
        old, new = path(f"{root}/shard={k}"), path(f"{staged}/shard={k}")
        if files.exists(old):
            files.delete(old, True)
        if files.exists(new) and not files.rename(new, old):
            raise OSError(f"shard {k} stays in {staged}")
    files.delete(path(staged), True)
    return affected
