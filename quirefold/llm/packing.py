"""Filling containers of fixed capacity with items.

Method: harmonic packing. An item of size s belongs to class k if
capacity / (k + 1) < s <= capacity / k; a bin of class k takes k items of it.
Items are dealt to workers by a hash of their id, and every worker packs its
items alone. A bin that its class has filled takes the largest items of smaller
classes that still fit. The last, half-filled bins of the workers go to one more
worker, which packs their items again; those are at most a few hundred items a
worker.

Defined results
  * an item above the capacity is divided into full pieces and a rest, and no
    other item is ever divided; items without tokens are not placed;
  * a container's number is unique within its kind; its items are in order;
  * repeated rows are items of their own; null ids are dealt like any id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import staged

#: Items a worker packs alone, about; and the number of classes.
WORKER_ITEMS, CLASSES = 20_000, 64
#: Containers below this share of the capacity are packed again at the end.
REPACK = 0.9


def pack(size: np.ndarray, capacity: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) for sizes of 1 to capacity."""
    n = len(size)
    bin_of = np.full(n, -1, np.int64)
    order = np.argsort(-size, kind="stable")
    sizes = size[order].tolist()
    kind = np.minimum(capacity // size[order], classes).tolist() if n else []
    # nxt[i]: the first item at or after i that is not placed
    nxt = list(range(n + 1))

    def free(i: int) -> int:
        root = i
        while nxt[root] != root:
            root = nxt[root]
        while nxt[i] != root:
            nxt[i], i = root, nxt[i]
        return root

    neg = -size[order]
    fills: list[int] = []
    i = free(0)
    while i < n:
        k, fill, own = kind[i], 0, 0
        here = len(fills)
        j = i
        # the class's own items, a fixed number a bin
        while own < k and j < n and kind[j] == k and fill + sizes[j] <= capacity:
            bin_of[order[j]] = here
            fill += sizes[j]
            nxt[j] = j + 1
            own += 1
            j = free(j + 1)
        # the gap takes the largest items that fit
        while fill < capacity:
            j = free(max(int(np.searchsorted(neg, fill - capacity, side="left")), i))
            if j >= n:
                break
            bin_of[order[j]] = here
            fill += sizes[j]
            nxt[j] = j + 1
        fills.append(fill)
        i = free(i)
    return bin_of, np.array(fills, np.int64)


DDL = "container_kind string, container long, item_id string, piece long, tokens long, token_start long, worker int, fill long"
SCHEMA = pa.schema(
    [("container_kind", pa.string()), ("container", pa.int64()), ("item_id", pa.string()), ("piece", pa.int64()), ("tokens", pa.int64()), ("token_start", pa.int64()), ("worker", pa.int32()), ("fill", pa.int64())]
)


def pack_workers(capacities: dict[str, int]):
    """Rows (container_kind, item_id, piece, tokens, token_start, worker), sorted by kind and worker."""

    def flush(rows: list[tuple]):
        kind, worker = rows[0][0], rows[0][5]
        size = np.array([r[3] for r in rows], np.int64)
        bin_of, fills = pack(size, capacities[kind])
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            b = bin_of[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part]),
                    pa.array(b + (np.int64(worker) << 32)),
                    *(pa.array([r[i] for r in part], SCHEMA.field(i + 1).type) for i in range(1, 5)),
                    pa.array(np.full(len(part), worker, np.int32)),
                    pa.array(fills[b]),
                ],
                schema=SCHEMA,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0], row[5]) != (held[0][0], held[0][5]):
                    yield from flush(held)
                    held = []
                held.append(row)
        if held:
            yield from flush(held)

    return run


def pack_items(items: DataFrame, capacities: dict[str, int], worker_items: int = WORKER_ITEMS) -> DataFrame:
    """Items (item_id, n_tokens) -> container_kind, container, item_id, piece, tokens, token_start.

    ``items`` is read twice, so it should be a stored table.
    """
    for kind, capacity in capacities.items():
        if capacity < 1:
            raise ValueError(f"capacity of {kind}: {capacity}")
    items = items.filter("n_tokens > 0")
    count = items.count()
    workers = max(1, -(-count // worker_items))
    sizes = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in capacities.items()))
    pieces = (
        items.withColumn("x", F.explode(sizes))
        .select("item_id", "n_tokens", "x.container_kind", "x.capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_tokens - 1) div capacity"))))
        .withColumn("token_start", F.col("piece") * F.col("capacity"))
        .withColumn("tokens", F.least("capacity", F.col("n_tokens") - F.col("token_start")))
        .withColumn("worker", F.pmod(F.xxhash64("item_id", "container_kind", "piece"), F.lit(workers)).cast("int"))
    )
    columns = ["container_kind", "item_id", "piece", "tokens", "token_start", "worker"]
    order = ["container_kind", "worker", "item_id", "piece", "tokens", "token_start"]
    first = staged(
        pieces.select(*columns)
        .repartition("container_kind", "worker")
        .sortWithinPartitions(*order)
        .mapInArrow(pack_workers(capacities), DDL)
    )
    capacity = F.element_at(F.create_map(*(x for k, c in capacities.items() for x in (F.lit(k), F.lit(c)))), F.col("container_kind"))
    # of each worker only the last bins can be far from full
    loose = first.withColumn("loose", F.col("fill") < F.lit(REPACK) * capacity)
    again = (
        loose.filter("loose")
        .withColumn("worker", F.lit(workers) + F.pmod(F.xxhash64("container"), F.lit(max(1, workers // 64))).cast("int"))
        .select(*columns)
        .repartition("container_kind", "worker")
        .sortWithinPartitions(*order)
        .mapInArrow(pack_workers(capacities), DDL)
    )
    out = ["container_kind", "container", "item_id", "piece", "tokens", "token_start"]
    return loose.filter("NOT loose").select(*out).unionByName(again.select(*out))


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """One row a kind: containers, tokens, fill (share of the capacity used), items, divided items."""
    capacity = F.element_at(F.create_map(*(x for k, c in capacities.items() for x in (F.lit(k), F.lit(c)))), F.col("container_kind"))
    bins = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.count_if(F.col("piece") > 0).alias("later"))
    return bins.groupBy("container_kind").agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count("*") * F.first(capacity))).alias("fill"),
        F.sum("items").alias("pieces"),
        F.sum("later").alias("later_pieces"),
    )


def read_capacities(sizes: DataFrame) -> dict[str, int]:
    """The settings table (one row a kind) as a dict on the driver."""
    return {r[0]: int(r[1]) for r in sizes.select("container_kind", "capacity_tokens").limit(1000).collect()}
