"""Problem 8: texts into containers of fixed capacity.

Bound-certified repacking: items are dealt to partitions of bounded size, each packed by best-fit decreasing. Dual feasible
functions give a lower bound on each partition's containers; a partition that meets its bound is certified and done. The others
keep their full containers, exchange the rest among themselves by a fresh deal, and are packed again, until all are certified or a deal gains nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.session import settle

#: Items of a partition, on average (they are dealt by hash, so no partition is much larger).
PARTITION_ITEMS = 20_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions: the identity, the threshold functions (items above C - e count as
    whole containers, items below e not at all), and the rounding functions of k steps."""
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    weight = count * np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(weight)])
    best = -(-int(w[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    large = n[-1] - n[capacity - e + 1]
    middle = w[capacity - e + 1] - w[e]
    best = max(best, int((large + -(-middle // capacity)).max()) if len(e) else 0)
    at = np.flatnonzero(count)
    for k in range(1, 31):
        steps = (k + 1) * at
        whole = steps % capacity == 0
        # in units of 1 / (k * capacity): an exact multiple keeps its size, others are rounded down to steps of 1 / k
        value = np.where(whole, at * k, steps // capacity * capacity)
        best = max(best, -(-int((value * count[at]).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: the fullest that still has room. Open rooms are the bits of one integer."""
    order = np.argsort(-sizes, kind="stable")
    placed = np.zeros(len(sizes), dtype=np.int64)
    rooms: dict[int, list[int]] = {}
    mask, used = 0, 0
    for i in order:
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = rooms[room]
            box = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, box = capacity, used
            used += 1
        placed[i] = box
        left = room - size
        rooms.setdefault(left, []).append(box)
        mask |= 1 << left
    return placed


PACKED = "container_kind string, capacity int, deal int, part int, box bigint, key bigint, piece_no int, start_token bigint, tokens int, boxes int, bound int, filled int"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "key", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes, capacity = pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    box = best_fit_decreasing(sizes, capacity)
    filled = np.bincount(box, weights=sizes).astype("int64")
    return pdf.assign(box=box, boxes=np.int32(len(filled)), bound=np.int32(max(1, lower_bound(sizes, capacity))), filled=filled[box].astype("int32"))[[c.split()[0] for c in PACKED.split(", ")]]


def _dealt(items: DataFrame, deal: int, parts) -> DataFrame:
    part = F.pmod(F.xxhash64("key", "piece_no", F.lit(deal)), parts).cast("int")
    columns = ["container_kind", "capacity", "key", "piece_no", "start_token", "tokens"]
    rows = items.select(*columns, F.lit(deal).alias("deal"), part.alias("part"))
    return rows.groupBy("container_kind", "part").applyInPandas(_pack, PACKED)


def _by_kind(counts: dict[str, int]):
    out = F.lit(1)
    for kind, n in counts.items():
        out = F.when(F.col("container_kind") == kind, F.lit(max(1, n))).otherwise(out)
    return out


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", partition_items: int = PARTITION_ITEMS, rounds: int | None = None) -> DataFrame:
    """Rows (container_kind, container_id, key, piece_no, start_token, tokens, capacity, filled, certified) for ``sizes`` (key, tokens) and every
    row of ``containers`` (container_kind, capacity_tokens), a fixed table.

    An item above the capacity is cut into pieces of the capacity, which fill containers of their own, and a rest, which is
    packed; other items stay whole. An item without tokens takes no room and shares a container. Null keys and repeated keys are
    items like any other; null sizes have no row. Without items or containers the result is empty. ``certified``: the
    container's partition uses no more containers than its lower bound. ``rounds`` bounds the exchanges; unbounded, a kind of container is
    exchanged again as long as that saves any.
    """
    known = containers.where("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().collect()
    kinds = F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity"]).alias("capacity")) for r in sorted(known)]).cast("array<struct<container_kind:string,capacity:int>>")
    base = sizes.where("tokens is not null").select(F.col(key).cast("bigint").alias("key"), F.col("tokens").cast("bigint").alias("size"))
    each = base.select("key", "size", F.explode(kinds).alias("c")).select("key", "size", "c.*")  # every item for each of the few kinds
    full = F.when(F.col("size") > F.col("capacity"), (F.col("size") / F.col("capacity")).cast("bigint")).otherwise(F.lit(0))
    rest = F.col("size") - F.col("full") * F.col("capacity")
    each = each.withColumn("full", full).withColumn("rest", rest)
    whole = each.where("full > 0").select(
        "container_kind", "capacity", "key", F.explode(F.expr("sequence(0, cast(full as int) - 1)")).alias("piece_no"), F.col("capacity").alias("tokens")
    ).withColumn("start_token", F.col("piece_no").cast("bigint") * F.col("capacity"))
    items = each.where("rest > 0 or full = 0").select("container_kind", "capacity", "key", F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("rest").cast("int").alias("tokens"))

    n = {r["container_kind"]: r["n"] for r in items.groupBy("container_kind").agg(F.count("*").alias("n")).collect()}
    state = settle(_dealt(items, 0, _by_kind({k: -(-v // partition_items) for k, v in n.items()})))
    deal, gaining = 0, set(n)
    while gaining and deal != rounds:
        deal += 1
        gap = F.col("container_kind").isin(sorted(gaining)) & (F.col("boxes") > F.col("bound"))
        open_ = state.where(gap & (F.col("filled") < F.col("capacity")))
        seen = open_.groupBy("container_kind").agg(F.countDistinct("deal", "part", "box").alias("boxes"), F.count("*").alias("n"), F.countDistinct("deal", "part").alias("parts"))
        before = {r["container_kind"]: r for r in seen.collect()}
        if not before:
            break
        again = settle(_dealt(open_, deal, _by_kind({k: min(r["parts"], -(-r["n"] // partition_items)) for k, r in before.items()})))
        after = {r["container_kind"]: r["boxes"] for r in again.groupBy("container_kind").agg(F.countDistinct("part", "box").alias("boxes")).collect()}
        better = [k for k, m in after.items() if m < before[k]["boxes"]]
        gaining = set(better)
        if not better:
            break
        kept = state.where(~(gap & (F.col("filled") < F.col("capacity")) & F.col("container_kind").isin(better)))
        # what stays of an exchanged partition is full containers, which no packing betters
        kept = kept.withColumn("boxes", F.when(gap & F.col("container_kind").isin(better), F.col("bound")).otherwise(F.col("boxes")))
        state = settle(kept.unionByName(again.where(F.col("container_kind").isin(better))))
    name = F.concat_ws("-", "container_kind", F.col("deal").cast("string"), F.col("part").cast("string"), F.col("box").cast("string"))
    out = state.select("container_kind", name.alias("container_id"), "key", "piece_no", "start_token", "tokens", "capacity", "filled", (F.col("boxes") <= F.col("bound")).alias("certified"))
    alone = F.concat_ws("-", "container_kind", F.lit("full"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("piece_no").cast("string"))
    singles = whole.select("container_kind", alone.alias("container_id"), "key", "piece_no", "start_token", "tokens", "capacity", F.col("tokens").alias("filled"), F.lit(True).alias("certified"))
    return out.unionByName(singles).withColumnRenamed("key", key)


def packing_report(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per kind: containers, tokens, the bound by total size, unused share, and the share of containers in certified partitions."""
    boxes = packed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), F.max("certified").alias("certified"))
    return boxes.groupBy("container_kind", "capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        F.ceil(F.sum("tokens") / F.first("capacity")).alias("least_containers"),
        (1 - F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("unused_share"), F.avg(F.col("certified").cast("double")).alias("certified_share"),
    )
