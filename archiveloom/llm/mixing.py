"""Problem 9: records of several sources mixed to target shares of the total size.

Systematic sampling: within a source every record has the same expected copies, their prefix sum runs over the records in order
of size, one random offset is added, and a record is emitted once per integer boundary its step crosses. The prefix sum is
taken in two levels (within small blocks, then over the blocks), so that no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archiveloom.session import settle

BLOCK_ROWS = 100_000
SEED = 20_260


def rates(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """Expected copies per record of each source: a row for every target.

    Without a wanted total it is the largest at which every source that has text meets its share within its repeats; a wanted
    total beyond that is filled as far as the repeats allow. ``targets`` is a fixed table, ``totals`` has one row per target.
    """
    rows = [r.asDict() for r in targets.where("target_share > 0").join(totals, "source", "left").select("source", "target_share", "max_repeats", "records", "tokens").collect()]
    there = [r for r in rows if r["tokens"] and r["max_repeats"]]
    share = sum(r["target_share"] for r in there)
    most = min((r["max_repeats"] * r["tokens"] / (r["target_share"] / share) for r in there), default=0.0)
    total = most if total_tokens is None else total_tokens
    for r in rows:
        r["rate"] = min(float(r["max_repeats"]), r["target_share"] / share * total / r["tokens"]) if r in there else 0.0
    return rows


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, offsets: int = 1) -> DataFrame:
    """Rows (source, doc_id, tokens, repeat_no): one per use of a record, of ``sizes`` (doc_id, source, tokens).

    No record is used more than its source's ``max_repeats``. Sources without a target, and null sources, have no share and give no
    rows; a target without records gives none either (its share can't be met; the report shows it). Ties of size go by a hash
    of the key, so equal rows are told apart only by their number. An empty table gives an empty mixture.
    """
    wanted = targets.where("source is not null and target_share > 0").select("source", F.col("target_share"), F.col("max_repeats"))
    rows = sizes.join(F.broadcast(wanted.select("source")), "source", "left_semi").select("source", F.col("doc_id"), F.col("tokens"))
    bins = rows.withColumn("size_bin", F.floor(F.log2(F.col("tokens") + 1) * 8).cast("int"))
    counts = bins.groupBy("source", "size_bin").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    counts = settle(counts)  # sources times sizes: a few hundred rows for each target
    totals = counts.groupBy("source").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    plan = rates(totals, wanted, total_tokens)
    due = [(r["source"], r["rate"], r["rate"] * r["tokens"]) for r in plan if r["rate"] > 0]
    rate = sizes.sparkSession.createDataFrame(due, "source string, rate double, due double")

    parts = counts.select("source", "size_bin", F.ceil(F.col("records") / BLOCK_ROWS).cast("int").alias("parts"))
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = bins.join(F.broadcast(parts), ["source", "size_bin"]).withColumn("h", order).withColumn("part", F.pmod("h", F.col("parts")))
    blocks = placed.groupBy("source", "size_bin", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("size_bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "size_bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "size_bin", "part").orderBy("tokens", "h", "doc_id")
    ranked = placed.withColumn("at", F.row_number().over(within)).join(blocks, ["source", "size_bin", "part"]).withColumn("rank", F.col("ahead") + F.col("at"))
    ranked = settle(ranked.select("source", "doc_id", "tokens", "rank"))
    drawn = [F.pmod(F.xxhash64("source", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) for k in range(max(1, offsets))]
    copies = lambda offset: F.floor(F.col("rank") * F.col("rate") + offset) - F.floor((F.col("rank") - 1) * F.col("rate") + offset)
    rated = ranked.join(F.broadcast(rate), "source").withColumn("offset", drawn[0])
    if len(drawn) > 1:
        sums = rated.groupBy("source", "due").agg(*[F.sum(copies(d) * F.col("tokens")).alias(f"s{k}") for k, d in enumerate(drawn)])
        off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("due")).alias("off"), F.lit(k).alias("k"), d.alias("offset")) for k, d in enumerate(drawn)])
        rated = rated.drop("offset").join(F.broadcast(sums.select("source", F.array_min(off)["offset"].alias("offset"))), "source")  # one row per target
    used = rated.withColumn("copies", copies(F.col("offset")).cast("int")).where("copies > 0")
    return used.select("source", "doc_id", "tokens", F.explode(F.expr("sequence(1, copies)")).alias("repeat_no"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the actual share of the mixture's tokens, records, uses, tokens and most uses of one record."""
    per = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = per.groupBy("source").agg(F.count("*").alias("records"), F.sum("uses").alias("uses"), F.sum("tokens").alias("tokens"), F.max("uses").cast("int").alias("most_repeats"))
    total = got.agg(F.sum("tokens")).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    return out.select("source", "target_share", "max_repeats", zero("records"), zero("uses"), zero("tokens"), zero("most_repeats"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"))
