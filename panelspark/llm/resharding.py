"""Resharding by minimum-cost flow.

Rows hash to blocks by their text, so equal texts share a block and never part.
From the bytes that each old shard holds and the capacities of the new shards,
a minimum-cost flow (a byte that stays costs nothing, a byte that moves costs
one) says how much goes from shard to shard. Whole blocks carry it out, and
only shards that lose or gain a block are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, discard, table

#: Blocks that are moved whole; the driver's tables are of this size.
N_BLOCKS = 16_384
N_SHARDS, OLD_SHARDS = 8, 6
SLOT_ROWS = 4_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Cheapest shipment of all ``supply`` into ``capacity``; ``cost(i, j)`` a unit.

    Successive shortest paths with potentials over one node per old and per new
    shard. Capacities must hold the supply.
    """
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are less than the supply")
    source, sink = m + n, m + n + 1
    arcs: list[list] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def arc(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, price])
        out[b].append(len(arcs))
        arcs.append([a, 0, -price])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    middle = len(arcs)
    for i in range(m):
        for j in range(n):
            arc(i, m + j, sum(supply), cost(i, j))
    for j, c in enumerate(capacity):
        arc(m + j, sink, c, 0)
    potential = [0] * len(out)
    left = sum(supply)
    while left:
        dist, via = [None] * len(out), [0] * len(out)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, room, price = arcs[e]
                new = d + price + potential[a] - potential[b]
                if room and (dist[b] is None or new < dist[b]):
                    dist[b], via[b] = new, e
                    heapq.heappush(heap, (new, b))
        potential = [p + (d or 0) for p, d in zip(potential, dist)]
        push, at = left, sink
        while at != source:
            push, at = min(push, arcs[via[at]][1]), arcs[via[at] ^ 1][0]
        at = sink
        while at != source:
            arcs[via[at]][1] -= push
            arcs[via[at] ^ 1][1] += push
            at = arcs[via[at] ^ 1][0]
        left -= push
    return [[arcs[middle + 2 * (i * n + j) + 1][1] for j in range(n)] for i in range(m)]


def plan(blocks: list[tuple[int, int, int]], n_old: int, n_new: int) -> dict[int, int]:
    """New shard of each block ``(block, old shard, bytes)``; shards keep their number.

    The flow fixes how many bytes leave each old shard and where they go. Per
    old shard the largest blocks that still fit leave first; what no whole
    block fits is settled by moving the best block out of the fullest shard.
    """
    total = sum(b for _, _, b in blocks)
    supply = [0] * n_old
    for _, old, size in blocks:
        supply[old] += size
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    to: dict[int, int] = {}
    load = [0] * n_new
    mine: list[list[tuple[int, int]]] = [[] for _ in range(n_old)]
    for block, old, size in blocks:
        mine[old].append((size, block))
    for i in range(n_old):
        room = flow[i]
        rest = []
        for size, block in sorted(mine[i], reverse=True):
            stay = i < n_new and room[i] >= size
            j = i if stay else max(range(n_new), key=lambda j: room[j])
            if room[j] >= size:
                room[j] -= size
                load[j] += size
                to[block] = j
            else:
                rest.append((size, block))
        for size, block in rest:
            j = max(range(n_new), key=lambda j: capacity[j] - load[j])
            load[j] += size
            to[block] = j
    sizes = {block: size for block, _, size in blocks}
    inside: list[set[int]] = [set() for _ in range(n_new)]
    for block, j in to.items():
        inside[j].add(block)
    for _ in range(64 * n_new):
        high = max(range(n_new), key=lambda j: load[j])
        low = min(range(n_new), key=lambda j: load[j])
        gap = load[high] - load[low]
        fit = [b for b in inside[high] if 0 < sizes[b] < gap]
        if not fit:
            break
        best = min(fit, key=lambda b: (abs(gap / 2 - sizes[b]), b))
        inside[high].remove(best)
        inside[low].add(best)
        to[best] = low
        load[high] -= sizes[best]
        load[low] += sizes[best]
    return to


def measure(docs: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``(doc_id, size, text_crc32, text_hash, block)``; size is the text's UTF-8 bytes plus 1."""
    text = F.col("text").cast("string")
    text_hash = F.xxhash64(F.coalesce(text, F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_hash.alias("text_hash"),
        F.pmod(text_hash, F.lit(n_blocks)).cast("int").alias("block"),
    )


def reshard(docs: DataFrame, n_new: int = N_SHARDS, n_old: int = OLD_SHARDS, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``(doc_id, size, text_crc32, text_hash, block, old_shard, shard, slot)`` of every row.

    Old shards are the layout ``block mod n_old``; new shards hold near equal
    bytes. Null and empty texts count one byte and share a block; copies stay
    together, rows that repeat each take a slot, an empty table gives none and
    further columns are ignored. Slots run from 0 without gaps in each shard,
    in order of a hash of the doc_id: counts by cell give each cell's first
    slot, so no window holds more than about SLOT_ROWS rows.
    """
    spark = docs.sparkSession
    rows = cut(measure(docs, n_blocks))
    held = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    to = plan([(r.block, r.block % n_old, r.bytes) for r in sorted(held)], n_old, n_new)
    n_cells = max(1, sum(r.n for r in held) // (SLOT_ROWS * n_new) + 1)
    moves = spark.createDataFrame([(b, b % n_old, j) for b, j in sorted(to.items())], "block int, old_shard int, shard int")
    placed = rows.join(F.broadcast(moves), "block").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(n_cells)).cast("int"))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(order))
        .join(first, ["shard", "cell"])
        .withColumn("slot", F.col("first") + F.col("at") - 1)
        .select("doc_id", "size", "text_crc32", "text_hash", "block", "old_shard", "shard", "slot")
    )


def rewrite(docs: DataFrame, placed: DataFrame, out: str, files_per_shard: int = 8) -> list[int]:
    """Write the shards that lose or gain rows under ``out/shard=N``; returns their numbers.

    A row finds its place by doc_id, text hash and an occurrence number, so null
    and repeated ids keep each row once. Rows of untouched shards are filtered
    out before the write; a shard is dealt to ``files_per_shard`` tasks, and the
    files of a shard that lost its last row go.
    """
    touched = sorted(
        {r.s for r in placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()}
    )
    part = placed.where(F.col("shard").isin(touched))
    filled = {r.shard for r in part.select("shard").distinct().collect()}
    # copies have one shard, so any order among them will do
    number = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    part = part.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "shard", "slot").withColumn("_no", number("_id", "_th"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"_row_id": F.col("doc_id").cast("long"), "_row_th": F.xxhash64(text)}).withColumn("_row_no", number("_row_id", "_row_th"))
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_th") == F.col("_th")) & (F.col("_row_no") == F.col("_no"))
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    (
        rows.join(part, same).select(*[docs[c] for c in docs.columns], "shard", "slot")
        .repartition(max(1, len(touched)) * files_per_shard, "shard", salt)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out)
    )
    spark = docs.sparkSession
    for shard in set(touched) - filled:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/shard={shard}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched


def op5(spark, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
