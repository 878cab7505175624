"""Joins and aggregates over candidates.  All keys carry image_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .superset import Superset, body_bytes, joinable

AT = ["image_id", "addr"]


# ---------------------------------------------------------------- lookups


def lookup(s: Superset, wanted: DataFrame) -> DataFrame:
    """Rows of the map at the wanted (image_id, addr); null where there is none."""
    return wanted.join(s.insn, AT, "left")


def members(s: Superset, wanted: DataFrame) -> DataFrame:
    """The wanted that are vertices of the graph."""
    return wanted.join(s.vertex, AT, "left_semi")


def contained(segment: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted that lie in a segment (image_id, low, high) of their image."""
    of = segment.select(F.col("image_id").alias("of"), "low", "high")
    return wanted.join(of, (F.col("image_id") == F.col("of")) & F.col("addr").between(F.col("low"), F.col("high")), "left_semi")


def connected(s: Superset, pairs: DataFrame) -> DataFrame:
    """The (image_id, src, dst) that are edges."""
    return pairs.join(s.edge, ["image_id", "src", "dst"], "left_semi")


def successors(s: Superset, of: DataFrame) -> DataFrame:
    return s.edge.join(of.withColumnRenamed("addr", "src"), ["image_id", "src"], "left_semi")


def predecessors(s: Superset, of: DataFrame) -> DataFrame:
    return s.edge.join(of.withColumnRenamed("addr", "dst"), ["image_id", "dst"], "left_semi")


def false_branches(s: Superset, truth: DataFrame) -> DataFrame:
    """(image_id, addr, after): branches that are no ground truth, with their fall-through successors."""
    wrong = branches(s).join(truth, AT, "left_anti").withColumnRenamed("addr", "src")
    return fall_through_edges(s).join(wrong, ["image_id", "src"], "left_semi").select("image_id", F.col("src").alias("addr"), F.col("dst").alias("after"))


# ---------------------------------------------------------------- overlaps


def conflicts(insn: DataFrame) -> DataFrame:
    """(image_id, owner, addr): rows of the map inside the body of another."""
    return body_bytes(insn).join(joinable(insn.select("image_id", "addr")), AT).select("image_id", "owner", "addr")


def conflict_set(s: Superset, of: DataFrame | None = None) -> DataFrame:
    """(image_id, addr): instructions with vertices in their bodies, and those vertices."""
    insn = s.insn if of is None else s.insn.join(of, AT, "left_semi")
    met = body_bytes(insn).join(s.vertex, AT)
    return met.select("image_id", F.explode(F.array("owner", "addr")).alias("addr")).distinct()


def parent_conflicts(s: Superset) -> DataFrame:
    """(image_id, parent, addr): parents share a successor with addr and have it in their bodies.

    The overlap is tested first, on body bytes, as it is by far the more selective of the two."""
    over = body_bytes(s.insn).withColumnRenamed("owner", "parent").join(s.vertex, AT)
    mine = s.edge.select("image_id", F.col("src").alias("addr"), "dst")
    theirs = s.edge.select("image_id", F.col("src").alias("parent"), "dst")
    return over.join(mine, AT).join(theirs, ["image_id", "parent", "dst"]).select("image_id", "parent", "addr").distinct()


def free_insns(s: Superset) -> DataFrame:
    return s.insn.select("image_id", "addr").join(conflict_set(s), AT, "left_anti")


# ---------------------------------------------------------------- fall-through


def with_fall(edge: DataFrame, insn: DataFrame) -> DataFrame:
    """Edges with the address after their source; a source without a row is followed by itself."""
    lengths = joinable(insn.select("image_id", F.col("addr").alias("src"), F.col("len")))
    return edge.join(lengths, ["image_id", "src"], "left").withColumn("after", F.col("src") + F.coalesce("len", F.lit(0))).drop("len")


def fall_through_edges(s: Superset) -> DataFrame:
    return with_fall(s.edge, s.insn).where("after = dst").select("image_id", "src", "dst")


def non_fall_through_edges(s: Superset, compat: bool = False) -> DataFrame:
    """The edges that are no fall-through.  compat: those that are, the last source for each target."""
    if compat:
        return fall_through_edges(s).groupBy("image_id", "dst").agg(F.max("src").alias("src"))
    return with_fall(s.edge, s.insn).where("after <> dst").select("image_id", "src", "dst")


def callers(s: Superset) -> DataFrame:
    """(image_id, addr, caller): predecessors that do not fall through."""
    return with_fall(s.edge, s.insn).where("after <> dst").select("image_id", F.col("dst").alias("addr"), F.col("src").alias("caller"))


def edges_with_fall(insn: DataFrame) -> DataFrame:
    """Edges with the kind of their source and the address after it, read off the rows without a join, where the
    edges are just those of the rows."""
    targets = F.array_compact(F.array("fall", F.when(~F.col("jump").eqNullSafe(F.col("fall")), F.col("jump"))))
    return insn.select("image_id", F.col("addr").alias("src"), "kind", (F.col("addr") + F.col("len")).alias("after"), F.explode(targets).alias("dst"))


def callers_of_rows(insn: DataFrame) -> DataFrame:
    """As ``callers``, without a join."""
    return insn.where("jump <> addr + len").select("image_id", F.col("jump").alias("addr"), F.col("addr").alias("caller"))


def callsites(calls: DataFrame, threshold: int = 6) -> DataFrame:
    """Nodes with more than ``threshold`` callers."""
    return calls.groupBy(AT).agg(F.count(F.lit(1)).alias("callers")).where(F.col("callers") > threshold)


def discard_edges(s: Superset) -> DataFrame:
    """Edges but those that leave a call other than by falling through."""
    calls = s.insn.where("kind = 'call'").select("image_id", F.col("addr").alias("src"), (F.col("addr") + F.col("len")).alias("after"))
    left = s.edge.alias("e").join(calls.alias("c"), (F.col("e.image_id") == F.col("c.image_id")) & (F.col("e.src") == F.col("c.src")) & (F.col("dst") != F.col("after")), "left_anti")
    return left.select("image_id", "src", "dst")


# ---------------------------------------------------------------- degrees


def degrees(s: Superset) -> DataFrame:
    """(image_id, addr, into, out) of nodes that have an edge."""
    ends = s.edge.select("image_id", F.explode(F.array(F.struct(F.col("src").alias("addr"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("addr"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("image_id", F.col("e.addr").alias("addr")).agg(F.sum("e.i").alias("into"), F.sum("e.o").alias("out"))


def entries(s: Superset) -> DataFrame:
    return degrees(s).where("out = 0 AND into > 0").select(AT)


def fronds(s: Superset) -> DataFrame:
    return degrees(s).where("into = 0 AND out > 0").select(AT)


def mergers(s: Superset) -> DataFrame:
    return s.edge.groupBy("image_id", F.col("dst").alias("addr")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(AT)


def branches(s: Superset) -> DataFrame:
    return s.edge.groupBy("image_id", F.col("src").alias("addr")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(AT)


def isolated(s: Superset) -> DataFrame:
    return s.vertex.join(degrees(s), AT, "left_anti")


def edge_list(s: Superset) -> DataFrame:
    """Edges, and (v, v) for vertices without any."""
    return s.edge.unionByName(isolated(s).select("image_id", F.col("addr").alias("src"), F.col("addr").alias("dst")))


def transpose(s: Superset) -> DataFrame:
    return s.edge.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edge: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between the kept vertices."""
    for end in ("src", "dst"):
        edge = edge.join(keep.withColumnRenamed("addr", end), ["image_id", end], "left_semi")
    return edge.select("image_id", "src", "dst")


# ---------------------------------------------------------------- consistency


def unbalanced(s: Superset) -> DataFrame:
    """(image_id, addr, side): in the map but not in the graph, or the reverse."""
    rows = s.insn.select(AT)
    only_map = rows.join(s.vertex, AT, "left_anti").withColumn("side", F.lit("map"))
    return only_map.unionByName(s.vertex.join(rows, AT, "left_anti").withColumn("side", F.lit("graph")))


def rebalance(s: Superset, segment: DataFrame) -> Superset:
    """Marks mapped vertices without a row; drops rows that are not in the graph.  segment: image_id, low, high."""
    within = joinable(segment.select("image_id", "low", "high"))
    lost = s.vertex.join(joinable(s.insn.select(AT)), AT, "left_anti").join(within, "image_id").where("addr BETWEEN low AND high").select(AT)
    insn = s.insn.join(s.vertex, AT, "left_semi")
    # What is lost is a vertex already.
    return Superset(insn, s.edge, s.vertex, s.bad.unionByName(lost).distinct())


def cross_section(s: Superset, segment: DataFrame) -> DataFrame:
    """Fall-through edges either way whose ends share no segment; for each source the last.

    The segments are met first, by image, as few edges leave theirs; a row of the map is then looked up for either
    end in one join.  An end without a row is followed by itself."""
    within = joinable(segment.groupBy("image_id").agg(F.collect_list(F.struct("seg_id", "low", "high")).alias("segments")))

    def of(end: str) -> Column:
        return F.filter(F.coalesce("segments", F.array()), lambda x: F.col(end).between(x.low, x.high))

    apart = F.exists("src_in", lambda a: F.exists("dst_in", lambda b: F.coalesce(a.seg_id != b.seg_id, F.lit(True))))
    e = s.edge.join(within, "image_id", "left").select("image_id", "src", "dst", of("src").alias("src_in"), of("dst").alias("dst_in"))
    e = e.where((F.size("src_in") == 0) | (F.size("dst_in") == 0) | apart)
    ends = F.array(F.struct(F.col("src").alias("addr"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("addr"), F.col("src").alias("to")))
    ends = e.select("image_id", "src", "dst", F.explode(ends).alias("end")).select("image_id", "src", "dst", "end.*")
    met = ends.join(s.insn.select(*AT, "len"), AT, "left").where(F.col("addr") + F.coalesce("len", F.lit(0)) == F.col("to"))
    return met.groupBy("image_id", "src").agg(F.max("dst").alias("dst"))


# ---------------------------------------------------------------- constants, loops


def constants(s: Superset, memory: DataFrame) -> DataFrame:
    """(image_id, addr, value): words anywhere in memory that are addresses of vertices.  memory: rows of every
    offset, whether trimmed or not."""
    values = memory.where("word BETWEEN 1 AND n").select("image_id", F.col("addr").alias("at"), F.col("word").alias("addr"))
    return values.join(s.vertex, AT, "left_semi").select("image_id", F.col("at").alias("addr"), F.col("addr").alias("value"))


def parents_outside(edge: DataFrame, component: DataFrame) -> DataFrame:
    """Predecessors of a set that are not in it."""
    into = edge.join(component.withColumnRenamed("addr", "dst"), ["image_id", "dst"], "left_semi").select("image_id", F.col("src").alias("addr")).distinct()
    return into.join(component, AT, "left_anti")


def loop_sizes(loops: DataFrame) -> DataFrame:
    """loops: image_id, addr, loop.  Adds the number of members."""
    return loops.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("image_id", "loop")))


def stats(insn: DataFrame) -> DataFrame:
    """Per image: rows, least address, total length, undecodable rows, bytes."""
    return insn.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("addr").alias("base"), F.sum("len").alias("len_sum"), F.count_if(~F.col("valid")).alias("n_invalid"), F.max("n").alias("total_bytes"))
