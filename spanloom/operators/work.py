"""Work distribution: sizes, memory model, and the nearest task for each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the memory model: units per MiB, units kept back, tasks in flight, minutes to a time-out.
PER_MIB, RESERVE, IN_FLIGHT, TIMEOUT_MIN = 1024, 2000, 4, 45


def size_key(n_bytes: Column) -> Column:
    """MiB, and one more where that is no whole number."""
    mib = n_bytes / F.lit(float(1 << 20))
    return F.when(mib == F.floor(mib), mib).otherwise(mib + 1)


def complexity(size: Column) -> Column:
    return size * PER_MIB


def capacity(free_mem: Column, cores: Column, outbound_mem: Column, outbound: Column) -> Column:
    """The size that a host can take; null where it should get nothing."""
    left = free_mem - outbound_mem
    return F.when((outbound < IN_FLIGHT) & (cores > 1) & (left - RESERVE > 0), left / PER_MIB)


def nearest(hosts: DataFrame, work: DataFrame, cells: int = 1_000) -> DataFrame:
    """hosts: hostname, want.  work: fname, size.  For each host the task whose size is nearest, the smaller of
    two equally near, the last name of equal sizes.

    Tasks are thinned to one per size and hosts to one per wish; both are put in one order of size, and the
    nearest below and above are carried along it by windows over ranges of cells, so no pair is formed.  Cells are
    quantiles of the points, so they hold about as many each; one window runs over one row per cell."""
    sizes = work.groupBy("size").agg(F.max("fname").alias("fname"))
    points = sizes.select(F.col("size").cast("double").alias("x"), F.struct(F.col("size").cast("double").alias("size"), "fname").alias("task"))
    wishes = hosts.where("want IS NOT NULL").select(F.col("want").cast("double").alias("x")).distinct().withColumn("task", F.lit(None).cast(points.schema["task"].dataType))
    line = points.withColumn("wish", F.lit(False)).unionByName(wishes.withColumn("wish", F.lit(True)))
    found = line.agg(F.percentile_approx("x", [k / cells for k in range(1, cells)], 10 * cells).alias("q")).head().q
    bounds = sorted(set(found or []))
    # Two steps of about the square root of the bounds each find a point's cell.
    wide = max(1, int(len(bounds) ** 0.5))
    heads, groups = bounds[::wide], [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    if bounds:
        group = F.size(F.filter(F.lit(heads), lambda b: b <= F.col("x")))
        inside_group = F.size(F.filter(F.get(F.lit(groups), group - 1), lambda b: b <= F.col("x")))
        line = line.withColumn("cell", F.when(group == 0, 0).otherwise((group - 1) * wide + inside_group))
    else:
        line = line.withColumn("cell", F.lit(0))
    # The last task below each cell and the first above it, over one row per cell.
    ends = line.groupBy("cell").agg(F.max_by("task", F.when(F.col("task").isNotNull(), F.col("x"))).alias("last"), F.min_by("task", F.when(F.col("task").isNotNull(), F.col("x"))).alias("first"))
    over = Window.orderBy("cell")
    ends = ends.select("cell", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
    inside = Window.partitionBy("cell").orderBy("x", "wish")
    line = line.withColumn("low", F.last("task", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("task", True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    met = line.where("wish").join(ends, "cell").select("x", F.coalesce("low", "before").alias("low"), F.coalesce("high", "beyond").alias("high"))
    choice = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull(), F.col("low")).when(F.col("x") - F.col("low.size") <= F.col("high.size") - F.col("x"), F.col("low")).otherwise(F.col("high"))
    best = met.select(F.col("x"), choice.alias("task"))
    return hosts.join(best, hosts.want.cast("double") == best.x).select("hostname", F.col("task.size").alias("size"), F.col("task.fname").alias("fname"))


def overdue(sent: DataFrame, now: Column) -> DataFrame:
    """Tasks to be sent again.  sent: fname, sent_at."""
    return sent.where(F.col("sent_at") < now - F.expr(f"INTERVAL {TIMEOUT_MIN} MINUTES"))
