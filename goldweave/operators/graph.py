"""Best partners, mutual merges, components and routes of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTO, FLOOR, MARGIN, PRICE_GAP = 0.94, 0.59, 0.04, 0.35


def field_conflict(l_maker: Column, r_maker: Column, l_price: Column, r_price: Column, gap: float = PRICE_GAP) -> Column:
    """Makers that differ, or prices that differ by more than ``gap`` of the larger."""
    maker = (l_maker != "") & (r_maker != "") & (l_maker != r_maker)
    price = F.abs(l_price - r_price) / F.greatest(l_price, r_price, F.lit(1.0)) > gap
    return F.coalesce(maker, F.lit(False)) | F.coalesce(price, F.lit(False))


def with_margins(scored: DataFrame) -> DataFrame:
    """``scored`` with place and lead of the best row of each end; -1 stands for a missing second row."""
    out = scored
    for side, other in (("l", "r"), ("r", "l")):
        w = Window.partitionBy(f"{side}_id").orderBy(F.desc("confidence"), f"{other}_id")
        lead = F.col("confidence") - F.lead("confidence", 1, -1.0).over(w)
        out = out.withColumns({f"{side}_rank": F.row_number().over(w), f"{side}_margin": lead})
    return out


def mutual_best(scored: DataFrame, *, low: float = FLOOR, high: float = AUTO, margin: float = MARGIN) -> DataFrame:
    """Pairs between the bounds that are the clear best of both ends and have no conflict."""
    best = with_margins(scored).where((F.col("l_rank") == 1) & (F.col("r_rank") == 1))
    return best.where((F.col("l_margin") >= margin) & (F.col("r_margin") >= margin) & (F.col("confidence") >= low) & (F.col("confidence") < high) & ~F.col("conflict"))


def mutual_top(scored: DataFrame, threshold: float) -> DataFrame:
    return with_margins(scored).where((F.col("l_rank") == 1) & (F.col("r_rank") == 1) & (F.col("confidence") >= threshold))


def retained(scored: DataFrame, merged: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Pairs of the floor or more whose ends are not merged yet."""
    out = scored.where(F.col("confidence") >= floor)
    return out.join(merged.select("l_id"), "l_id", "left_anti").join(merged.select("r_id"), "r_id", "left_anti")


def low_pairs(scored: DataFrame, used: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Pairs below the floor of which no end is in a cluster; ``used`` has l_id and r_id, of which one may be null."""
    out = scored.where(F.col("confidence") < floor)
    for side in ("l_id", "r_id"):
        out = out.join(used.where(F.col(side).isNotNull()).select(side).distinct(), side, "left_anti")
    return out


def components(pairs: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(side, id, component) of the bipartite graph of ``pairs``; the component is its smallest node name.

    Nodes point at the least node around them and edges contract to what they
    point at, so chains shrink by a factor each round.  Tables between rounds
    are checkpointed where the session has a checkpoint folder.
    """
    node = lambda side: F.concat(F.lit(f"{side}:"), F.col(f"{side}_id").cast("string"))
    live = pairs.select(F.least(node("l"), node("r")).alias("a"), F.greatest(node("l"), node("r")).alias("b")).distinct()
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    live, labels = settled(live), settled(labels)
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("o")).union(live.select("b", "a"))
        to = settled(both.groupBy("node").agg(F.least("node", F.min("o")).alias("to")))
        ends = live.join(to.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        renamed = labels.join(to.withColumnRenamed("node", "component"), "component", "left")
        labels = settled(renamed.select("node", F.coalesce("to", "component").alias("component")))
        live = settled(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return labels.select(F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 3)").alias("id"), "component")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed in the shared folder where there is one, else persisted."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def clusters(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per component: its ids on both sides, pairs, best confidence, lead of the best, conflict, competition."""
    own = pairs.join(labels.where("side = 'l'").select(F.col("id").alias("__id"), "component"), F.col("l_id").cast("string") == F.col("__id")).drop("__id")
    w = Window.partitionBy("component").orderBy(F.desc("confidence"), "l_id", "r_id")
    lead = F.when(F.row_number().over(w) == 1, F.col("confidence") - F.lead("confidence").over(w))
    own = own.withColumn("__lead", lead)
    out = own.groupBy("component").agg(
        F.array_sort(F.collect_set("l_id")).alias("l_ids"), F.array_sort(F.collect_set("r_id")).alias("r_ids"), F.count("*").alias("pair_count"),
        F.max("confidence").alias("max_confidence"), F.coalesce(F.max("__lead"), F.lit(1.0)).alias("score_margin"), F.bool_or("conflict").alias("has_field_conflict"),
    )
    many = (F.size("l_ids") > 1) | (F.size("r_ids") > 1)
    return out.withColumn("has_competition", many | (F.col("score_margin") < MARGIN))


def routed(found: DataFrame, *, auto: float = AUTO, floor: float = FLOOR) -> DataFrame:
    single = (F.size("l_ids") == 1) & (F.size("r_ids") == 1) & ~F.col("has_competition") & ~F.col("has_field_conflict")
    route = F.when(single & (F.col("max_confidence") >= auto), "auto_merge").when(F.col("max_confidence") >= floor, "llm_cluster").otherwise("different_entity")
    return found.withColumn("routing_decision", route)


def rank_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the rising order of the columns, from 1.

    Rows are sorted in range partitions; only one count per partition meets in
    one task.
    """
    keys = [c.alias(f"__k{i}") for i, c in enumerate(order)]
    own = settled(df.select("*", *keys).repartitionByRange(*[F.col(f"__k{i}") for i in range(len(keys))]).withColumn("__p", F.spark_partition_id()))
    sums = own.groupBy("__p").agg(F.count("*").alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*[F.col(f"__k{i}") for i in range(len(keys))]))
    out = own.withColumn("__r", inner).join(F.broadcast(before), "__p")  # one row per partition
    return out.withColumn(name, (F.col("__before") + F.col("__r")).cast("long")).drop("__p", "__r", "__before", *[f"__k{i}" for i in range(len(keys))])


def running_sums(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``df`` with ``upto_<v>``, the sum of each value over the rows whose key is not larger, and ``all_<v>``, its sum over all rows.

    Keys are distinct.  Rows are sorted in range partitions; only the
    partitions' sums, one row each, meet in one task.
    """
    own = settled(df.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id()))
    sums = own.groupBy("__p").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    w = Window.orderBy("__p")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sums.select("__p", *[c for v in values for c in (
        F.coalesce(F.sum(f"__s_{v}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{v}"), F.sum(f"__s_{v}").over(whole).alias(f"all_{v}"),
    )])
    inner = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({f"__u_{v}": F.sum(v).over(inner) for v in values}).join(F.broadcast(before), "__p")  # one row per partition
    return out.select(*df.columns, *[c for v in values for c in ((F.col(f"__b_{v}") + F.col(f"__u_{v}")).alias(f"upto_{v}"), F.col(f"all_{v}"))])


def numbered(found: DataFrame) -> DataFrame:
    """Clusters in the order of their best confidence, from 1."""
    out = rank_rows(found.withColumn("__c", -F.col("max_confidence")), [F.col("__c"), F.col("component")], "cluster_seq")
    return out.drop("__c").withColumn("cluster_seq", F.col("cluster_seq").cast("int"))
