"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a group is its target share of the output size
over its own size. Every document takes a count from the Poisson distribution
with that mean, by inverting the distribution function at a number hashed from
its id and the seed; it is exploded by its count and all copies are dealt
anew over the cluster in an order that is hashed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, materialize

OTHER = "*"  # group of all sources without a weight of their own
STEP = 16.0  # larger means are sums of independent draws of at most this mean
TERMS = 96  # P(X >= 96 | mean 16) is below 2 ** -100


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def group_rates(docs: DataFrame, weights: dict[str, float], epochs: float) -> DataFrame:
    """One row per group, at most ``len(weights) + 1``: grp, rate, draws, cdf."""
    share = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    scale = float(sum(weights.values()))
    sizes = docs.groupBy("grp").agg(F.sum("size").alias("size"))
    whole = Window.partitionBy(F.lit(1))
    # shares are renewed over the groups that hold any text
    want = share[F.col("grp")] / F.lit(scale) * (F.col("size") > 0).cast("double")
    sizes = (sizes.withColumn("want", F.coalesce(want, F.lit(0.0)))
             .withColumn("part", F.try_divide("want", F.sum("want").over(whole)))
             .withColumn("target", F.col("part") * F.sum("size").over(whole) * epochs)
             .withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0))
                         .otherwise(F.coalesce(F.try_divide("target", "size"), F.lit(float(epochs))))))
    sizes = (sizes.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
             .withColumn("mean", F.col("rate") / F.col("draws")))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return sizes.select("grp", "rate", "draws", F.aggregate(steps, start, add, lambda a: a["c"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: str = "mix",
                chunk: int = 1024) -> DataFrame:
    """``docs`` with each row repeated by its count: struct ``__row``, ``rate``
    and ``copy`` (from 1), dealt globally.

    ``weights`` gives the share of the output's characters per source; key
    ``*`` stands for all other sources and for null sources (0 if missing).
    Sizes are characters over all rows, null texts count none. A group without
    characters keeps its rows once on average; where no weighted source occurs
    at all, every rate is ``epochs``. Rows that repeat an id get the
    same count each; a null id hashes like the text 'null'. An empty table
    gives an empty result. Where a source is so small that its rate passes half of
    ``chunk``, copies are dealt to tasks by chunks before they are made; the rows are the same."""
    rows = docs.select(F.struct("*").alias(ROW))
    source = F.col(f"{ROW}.source").cast("string")
    named = [k for k in weights if k != OTHER]
    rows = rows.withColumns({
        "grp": F.when(source.isin(named), source).otherwise(F.lit(OTHER)) if named else F.lit(OTHER),
        "size": F.coalesce(F.length(f"{ROW}.text"), F.lit(0)).cast("long"),
        "uid": F.coalesce(F.col(f"{ROW}.doc_id").cast("string"), F.lit("null"))})
    rates = materialize(group_rates(rows, weights, epochs))
    often = (rates.agg(F.max("rate")).first()[0] or 0) > chunk / 2
    drawn = rows.join(F.broadcast(rates), "grp")  # at most len(weights) + 1 rows
    counts = F.transform(F.sequence(F.lit(1), F.col("draws")),
                         lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("uid"),
                                                                                  j.cast("string")))))
    n = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = drawn.withColumn("n", n).filter("n > 0").select(ROW, "rate", "uid", "n")
    first, last = F.lit(1), F.col("n")
    if often:  # a tiny source: its copies are made in chunks, each in a task of its own
        starts = F.sequence(F.lit(1), F.col("n"), F.lit(chunk))
        counted = counted.withColumn("first", F.explode(starts)).repartition(parts, F.xxhash64("uid", "first"))
        first, last = F.col("first"), F.least(F.col("n"), F.col("first") + chunk - 1)
    copies = (counted.select(ROW, "rate", "uid", F.explode(F.sequence(first, last)).alias("copy"))
              .withColumn("place", F.xxhash64(F.lit(seed), "uid", "copy")))
    return copies.repartition(parts, "place").sortWithinPartitions("place").select(ROW, "rate", "copy")
