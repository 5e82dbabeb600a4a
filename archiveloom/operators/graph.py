"""Entity graphs: simple undirected graphs, connected components, communities and their texts."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archiveloom.session import settle, ship

#: Largest component that is split into communities in one task; beyond it the same moves are made over the whole cluster.
LARGEST_IN_MEMORY = 100_000


def simple_graph(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "label", order: str = "pos") -> DataFrame:
    """Rows (src, dst, label): one per unordered pair, with the last label; loops and null ends go."""
    rows = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    pair = rows.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(label).alias("label"), F.col(order).alias("__at"))
    return pair.groupBy("src", "dst").agg(F.max_by("label", "__at").alias("label"))


def vertices(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Distinct ends of all edges, and further vertices (vertex)."""
    out = edges.select(F.col("src").alias("vertex")).unionByName(edges.select(F.col("dst").alias("vertex")))
    return (out.unionByName(extra.select("vertex")) if extra is not None else out).distinct()


def connected_components(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Rows (vertex, component): the component's smallest vertex.

    Large-star and small-star rounds over the edges until none changes: each round links a vertex's neighbours to the
    smallest of them, so that depth halves. Lineage is cut in the shared checkpoint folder; only a count reaches the driver.
    """
    every = vertices(edges, extra)
    links = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        moved = joined.where("v > u") if large else joined
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(links)
    while True:
        links = settle(star(star(links, True), False))
        now = mark(links)
        if tuple(now) == tuple(seen):
            break
        seen = now
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return every.join(roots, every["vertex"] == roots["u"], "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _gives(community: object, turn: int) -> bool:
    """Whether a community gives vertices in this round; else it takes some."""
    return int(hashlib.md5(f"{community}|{turn}".encode()).hexdigest()[0], 16) % 2 == 1


def modularity_communities(pairs: list[tuple], limit: int | None = None, resolution: int = 1) -> dict:
    """Communities of one small graph by rounds of moves to the neighbouring community of the greatest modularity gain (ties: the smallest);
    communities above ``limit`` are split again, and where that leaves one whole (a clique, a star), at twice the ``resolution``, at which a community must
    hold together the better, until none is above it. The name of a community is its smallest vertex.

    In a round each community either gives or takes, so that no two swap. Moves are taken by gain, each less the most that those
    before it to the same or from the same community could cost it, so every move gains; it ends when none is left. Gains are whole numbers.
    """
    near: dict = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    m2 = sum(map(len, near.values()))
    own = {v: v for v in near}
    weight = {v: len(n) for v, n in near.items()}
    turn = 0
    while True:
        moves = []
        for v, ns in near.items():
            inside: dict = defaultdict(int)
            for n in ns:
                inside[own[n]] += 1
            here, k = own[v], len(ns)
            stay = inside.pop(here, 0) * m2 - resolution * (weight[here] - k) * k
            if inside:
                lost, best = min((resolution * weight[c] * k - n * m2, c) for c, n in inside.items())
                if -lost > stay:
                    moves.append((lost + stay, v, here, best, k))
        if not moves:
            break
        before: dict = defaultdict(int)
        taken = []
        for lost, v, here, best, k in sorted(m for m in moves if _gives(m[2], turn) and not _gives(m[3], turn)):
            if -lost - resolution * k * (before[here] + before[best]) > 0:
                taken.append((v, here, best, k))
            before[here] += k
            before[best] += k
        for v, here, best, k in taken:
            own[v] = best
            weight[here] -= k
            weight[best] += k
        turn += 1
    groups: dict = defaultdict(list)
    for v, c in own.items():
        groups[c].append(v)
    out = {}
    for members in groups.values():
        if limit and len(members) > limit:
            inner = set(members)
            finer = resolution * 2 if len(members) == len(near) else resolution
            out |= modularity_communities([(a, b) for a in members for b in near[a] if b in inner and a < b], limit, finer)
            out |= {v: v for v in members if v not in out}
        else:
            out |= dict.fromkeys(members, min(members))
    return out


def _moved(links: DataFrame) -> DataFrame:
    """Rows (piece, vertex, community): the moves of :func:`modularity_communities` for each piece of links (piece, fine, src, dst), both ways each, at
    the resolution ``fine`` of the piece."""
    total = links.groupBy("piece").agg(F.count("*").alias("m2"), F.first("fine").alias("fine"))
    own = settle(links.groupBy("piece", F.col("src").alias("vertex")).agg(F.count("*").alias("k")).join(total, "piece").withColumn("here", F.col("vertex")))
    odd = lambda c, turn: F.substring(F.md5(F.concat(F.col(c).cast("string"), F.lit(f"|{turn}"))), 1, 1).isin(*"13579bdf")
    turn = 0
    while True:
        weight = own.groupBy("here").agg(F.sum("k").alias("w"))
        inside = links.join(own.select(F.col("vertex").alias("dst"), F.col("here").alias("c")), "dst").groupBy(F.col("src").alias("vertex"), "c").agg(F.count("*").alias("n"))
        held = inside.join(own, "vertex").join(weight.withColumnRenamed("here", "c"), "c").join(weight.withColumnRenamed("w", "w_here"), "here")
        same = F.col("c") == F.col("here")
        lost = F.when(~same, F.col("fine") * F.col("w") * F.col("k") - F.col("n") * F.col("m2"))
        stay = F.coalesce(F.max(F.when(same, F.col("n") * F.col("m2"))), F.lit(0)) - F.first("fine") * (F.first("w_here") - F.first("k")) * F.first("k")
        best = held.groupBy("vertex", "here", "k", "fine").agg(F.min(F.when(~same, F.struct(lost.alias("lost"), F.col("c").alias("best")))).alias("b"), stay.alias("stay"))
        moves = settle(best.select("vertex", "here", "k", "fine", "b.best", (F.col("b.lost") + F.col("stay")).alias("lost")).where("lost < 0"))
        if moves.isEmpty():
            return own.select("piece", "vertex", F.col("here").alias("community"))
        before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy("lost", "vertex").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        while moves.where(odd("here", turn) & ~odd("best", turn)).isEmpty():
            turn += 1
        turned = moves.where(odd("here", turn) & ~odd("best", turn)).withColumn("spent", before("here") + before("best")).where("-lost - fine * k * spent > 0")
        own = settle(own.join(turned.select("vertex", "best"), "vertex", "left").select("piece", "vertex", "k", "m2", "fine", F.coalesce("best", "here").alias("here")))
        turn += 1


def large_communities(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (vertex, community) of edges (src, dst) of components of any size: what :func:`modularity_communities` gives, over the whole cluster."""
    both = edges.select("component", "src", "dst").unionByName(edges.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    links, done = settle(both.distinct().withColumnRenamed("component", "piece").withColumn("fine", F.lit(1).cast("bigint"))), []
    while True:
        found = _moved(links)
        named = found.join(found.groupBy("community").agg(F.min("vertex").alias("name"), F.count("*").alias("size")), "community")
        named = settle(named.join(found.groupBy("piece").agg(F.count("*").alias("all")), "piece").select("vertex", "name", "size", "all"))
        again = F.lit(bool(limit)) & (F.col("size") > (limit or 0))
        done.append(named.where(~again).select("vertex", F.col("name").alias("community")))
        split = named.where(again).select("vertex", "name", (F.col("size") == F.col("all")).alias("unsplit"))
        if split.isEmpty():
            break
        inner = links.join(split.select(F.col("vertex").alias("src"), F.col("name").alias("piece_"), "unsplit"), "src").join(split.select(F.col("vertex").alias("dst"), F.col("name").alias("other")), "dst")
        links = settle(inner.where("piece_ = other").select(F.col("piece_").alias("piece"), F.when(F.col("unsplit"), F.col("fine") * 2).otherwise(F.col("fine")).alias("fine"), "src", "dst"))
        # a vertex without links inside stays alone
        done.append(split.join(links.select(F.col("src").alias("vertex")).distinct(), "vertex", "left_anti").select("vertex", F.col("vertex").alias("community")))
    return reduce(DataFrame.unionByName, done)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities of a graph of any size: each vertex takes the label most frequent around it (ties: the smallest), a set number of times."""
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("vertex")).distinct().withColumn("community", F.col("vertex"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["vertex"]).groupBy("src", "community").agg(F.count("*").alias("n"))
        labels = settle(votes.groupBy(F.col("src").alias("vertex")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    return labels


def communities(edges: DataFrame, extra: DataFrame | None = None, limit: int | None = None, largest: int = LARGEST_IN_MEMORY) -> DataFrame:
    """Rows (vertex, component, community): each component split by modularity; a lone vertex is a community. Components of more vertices
    than ``largest`` are never gathered; the same moves give theirs, so the result is the same at any ``largest``."""
    ship(edges.sparkSession)
    comp = settle(connected_components(edges, extra))
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    placed = edges.join(comp.withColumnRenamed("vertex", "src"), "src").join(size, "component").select("component", "src", "dst", "size")
    kind = edges.schema["src"].dataType.simpleString()

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        found = modularity_communities(list(zip(pdf["src"], pdf["dst"])), limit)
        return pd.DataFrame({"vertex": list(found), "community": list(found.values())})

    small = placed.where(F.col("size") <= largest).select("component", "src", "dst").groupBy("component").applyInPandas(split, f"vertex {kind}, community {kind}")
    large = placed.where(F.col("size") > largest)
    found = small if large.isEmpty() else small.unionByName(large_communities(large, limit))
    return comp.join(found, "vertex", "left").select("vertex", "component", F.coalesce("community", "vertex").alias("community"))


def community_lines(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows (community, line): each edge within a community, from both ends: 'a -> b -> label'."""
    both = edges.select("src", "dst", "label").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
    a = membership.select(F.col("vertex").alias("src"), F.col("community").alias("community"))
    b = membership.select(F.col("vertex").alias("dst"), F.col("community").alias("other"))
    line = F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string"), "label")
    return both.join(a, "src").join(b, "dst").where("community = other").select("community", line.alias("line"))


def community_texts(lines: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows (community, text): the lines of a community as a prompt. Beyond ``most`` lines (a model's input has a limit) the rest is in
    further rows (part), so that no community is gathered whole."""
    nth = F.row_number().over(Window.partitionBy("community").orderBy("line")) - 1
    parts = lines.withColumn("part", F.floor(nth / most).cast("int"))
    return parts.groupBy("community", "part").agg((F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("."))).alias("text"))


def allowed_edges(edges: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges (src_kind, label, ...) that a schema (src_kind, label) allows, strictly."""
    return edges.join(schema.select("src_kind", "label").distinct(), ["src_kind", "label"], "left_semi")


def capped(edges: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """At most so many edges of each chunk, in order: the per-chunk cap of extraction."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return edges.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")
