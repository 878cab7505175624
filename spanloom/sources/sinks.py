"""Text, graph and cache forms of results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import graph
from spanloom.functions.graph import Graph
from spanloom.functions.heuristics import Options
from spanloom.operators.relations import isolated
from spanloom.operators.superset import Superset, per_image


def graph_lines(s: Superset) -> DataFrame:
    """(image_id, line): ``src-dst`` for each edge and the bare address of each isolated vertex."""
    edges = s.edge.select("image_id", F.concat_ws("-", "src", "dst").alias("line"))
    return edges.unionByName(isolated(s).select("image_id", F.col("addr").cast("string").alias("line")))


def dot_lines(s: Superset, colours: dict[str, DataFrame] | None = None) -> DataFrame:
    """(image_id, line): Graphviz nodes and edges.  Of several colours the last in the order given wins."""
    nodes = s.vertex.join(s.insn.select("image_id", "addr", "len"), ["image_id", "addr"], "left").withColumn("colour", F.lit("#660000"))
    for name, of in (colours or {}).items():
        marked = of.select("image_id", "addr").distinct().withColumn("hit", F.lit(name))
        nodes = nodes.join(marked, ["image_id", "addr"], "left").withColumn("colour", F.coalesce("hit", "colour")).drop("hit")
    node = F.format_string('"%d" [shape=box, height=%d, color="%s"];', "addr", F.coalesce("len", F.lit(0)), "colour")
    edge = F.format_string('"%d" -> "%d";', "src", "dst")
    return nodes.select("image_id", node.alias("line")).unionByName(s.edge.select("image_id", edge.alias("line")))


#: Colours of addresses by how they were judged.
JUDGED_COLOURS = {"false negatives": "red", "true positives": "green", "false positives": "yellow"}


def judged_dot_lines(s: Superset, truth: DataFrame) -> DataFrame:
    """The graph with its nodes coloured by ground truth."""
    wrong = s.insn.select("image_id", "addr").join(truth, ["image_id", "addr"], "left_anti")
    lost = truth.join(s.insn, ["image_id", "addr"], "left_anti")
    return dot_lines(s, {JUDGED_COLOURS["true positives"]: truth, JUDGED_COLOURS["false positives"]: wrong, JUDGED_COLOURS["false negatives"]: lost})


def image_dot_lines(images: DataFrame, truth: Callable[[Graph], np.ndarray] | None = None, decoder: str = "t8") -> DataFrame:
    """The lines of the trimmed graphs of images, coloured as above by the ground truth (a mask of the whole graph) if
    there is one.  Numbers leave Python, nodes and edges at once, and nothing is shuffled."""
    palette = ["#660000", *(JUDGED_COLOURS[k] for k in ("true positives", "false positives", "false negatives"))]

    def step(g: Graph) -> dict[str, object]:
        true = None if truth is None else truth(g)
        g = graph.tag(g).trim()
        colour = np.zeros(g.n, np.int8)
        if true is not None:
            colour[true & g.row], colour[g.row & ~true], colour[true & ~g.row] = 1, 2, 3
        at = np.flatnonzero(g.vertex)
        node = np.arange(len(at) + len(g.src)) < len(at)
        shade = pa.array(np.append(colour[at], np.zeros(len(g.src), np.int8)), mask=~node)
        return {
            "image": np.append(g.image[at], g.image[g.src]),
            "a": np.append(g.addr[at], g.addr[g.src]),
            "b": np.append(np.where(g.row, g.length, 0)[at], g.addr[g.dst]),
            "colour": pa.DictionaryArray.from_arrays(shade, pa.array(palette)).cast(pa.string()),
        }

    rows = per_image(images, step, "a long, b long, colour string", decoder)
    node = F.concat(F.lit('"'), "a", F.lit('" [shape=box, height='), "b", F.lit(', color="'), "colour", F.lit('"];'))
    edge = F.concat(F.lit('"'), "a", F.lit('" -> "'), "b", F.lit('";'))
    return rows.select("image_id", F.when(F.col("colour").isNull(), edge).otherwise(node).alias("line"))


def digests(images: DataFrame, options: Options | None = None) -> DataFrame:
    """(image_id, digest): of the bytes and the loader; with options, of all that shapes the result."""
    if options is None:
        return images.select("image_id", F.concat(F.md5("bytes"), F.lit(Options().loader)).alias("digest"))
    shaped = ";".join(f"{k}={v}" for k, v in sorted(asdict(options).items()))
    return images.select("image_id", F.sha2(F.concat(F.md5("bytes"), F.lit(shaped)), 256).alias("digest"))


def format_metrics(metrics: DataFrame, template: str, names: list[str]) -> DataFrame:
    """(image_id, text): ``%1`` to ``%n`` replaced by metrics; a missing value reads ``unknown``.  Later numbers
    go first, so that ``%10`` is not taken for ``%1`` and a zero."""
    unknown = [n for n in names if n not in metrics.columns]
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    text: Column = F.lit(template)
    for k in range(len(names), 0, -1):
        text = F.replace(text, F.lit(f"%{k}"), F.coalesce(F.col(names[k - 1]).cast("string"), F.lit("unknown")))
    return metrics.select("image_id", text.alias("text"))


class Cache:
    """Results by digest, as Parquet folders below a shared path, with a table of what is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, results: DataFrame) -> None:
        """results carry a digest column; those of the same digest are replaced."""
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def missing(self, name: str, wanted: DataFrame) -> DataFrame:
        """The wanted (digest) that are not there."""
        return wanted.join(self.load(name).select("digest").distinct(), "digest", "left_anti")

    def reset(self, name: str) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def scatter(metrics: DataFrame, x: str, y: str) -> DataFrame:
    """Points to plot, of images that have both metrics."""
    return metrics.select("image_id", F.col(x).alias("x"), F.col(y).alias("y")).dropna()


def corpus_rollup(metrics: DataFrame, compat: bool = False) -> DataFrame:
    """Totals over images that have every metric.  compat: the mean occlusive space sums false negatives."""
    whole = metrics.dropna()
    space = "false_negatives" if compat else "occlusive_space"
    return whole.agg(F.sum("false_negatives").alias("total_false_negatives"), (F.sum(space) / F.count(F.lit(1))).alias("mean_occlusive_space"), F.count(F.lit(1)).alias("images"))
