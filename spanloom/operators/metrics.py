"""Evidence and metrics per image, against ground truth."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import graph, heuristics, walks
from spanloom.functions.graph import Graph
from spanloom.functions.heuristics import DEFAULT_WEIGHT, WEIGHTS, Options

from .relations import AT, conflicts
from .superset import per_image

# ---------------------------------------------------------------- evidence


def evidence(features: dict[str, DataFrame]) -> DataFrame:
    """(image_id, addr, weight, feature) of feature sets."""
    sets = [s.select("image_id", "addr", F.lit(WEIGHTS.get(f, DEFAULT_WEIGHT)).alias("weight"), F.lit(f).alias("feature")) for f, s in features.items()]
    return reduce(DataFrame.unionByName, sets)


def totals(rows: DataFrame, threshold: int) -> DataFrame:
    """Addresses whose evidence exceeds the threshold."""
    return rows.groupBy(AT).agg(F.sum("weight").alias("total")).where(F.col("total") > threshold)


def distributions(rows: DataFrame, truth: DataFrame, threshold: int) -> DataFrame:
    """(feature, bucket, tp, fp): addresses by their points for a feature, at most the threshold."""
    points = rows.groupBy("image_id", "addr", "feature").agg(F.least(F.sum("weight"), F.lit(threshold)).alias("bucket"))
    judged = points.join(truth.select(*AT, F.lit(True).alias("t")).distinct(), AT, "left")
    return judged.groupBy("feature", "bucket").agg(F.count_if(F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))


def deviation(values: DataFrame, mean: float) -> DataFrame:
    """Sample deviation of a value column around a given mean."""
    return values.agg(F.sqrt(F.sum(F.pow(F.col("value") - mean, F.lit(2.0))) / (F.count(F.lit(1)) - 1)).alias("deviation"))


def image_evidence(images: DataFrame, features: tuple[str, ...], decoder: str = "t8") -> DataFrame:
    """``evidence`` of trimmed graphs by features of the registry, gathered where images are decoded."""

    def step(g: Graph) -> dict[str, object]:
        rows = heuristics.evidence_rows(graph.tag(g).trim(), features)
        at = [np.flatnonzero(mask) for _, _, mask in rows]
        of, node = np.repeat(np.arange(len(rows)), [len(x) for x in at]), np.concatenate(at)
        names = pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int8)), pa.array([r[0] for r in rows])).cast(pa.string())
        return {"image": g.image[node], "addr": g.addr[node], "weight": np.array([r[1] for r in rows], np.int32)[of], "feature": names}

    return per_image(images, step, "addr long, weight int, feature string", decoder)


def image_totals(images: DataFrame, features: tuple[str, ...], threshold: int, decoder: str = "t8") -> DataFrame:
    """``totals`` of that evidence, summed where images are decoded."""

    def step(g: Graph) -> dict[str, np.ndarray]:
        total = heuristics.evidence_total(graph.tag(g).trim(), features)
        at = np.flatnonzero(total > threshold)
        return {"image": g.image[at], "addr": g.addr[at], "total": total[at]}

    return per_image(images, step, "addr long, total long", decoder)


def image_distributions(images: DataFrame, features: tuple[str, ...], threshold: int, decoder: str = "t8") -> DataFrame:
    """``distributions`` of trimmed graphs by features of the registry, counted for each image where it is decoded;
    the ground truth is what entrances reach before anything is removed."""

    def step(g: Graph) -> dict[str, object]:
        truth = g.close(entrances_of(g), forward=True)
        g = graph.tag(g).trim()
        images = np.unique(g.image)
        k = int(images.max()) + 1 if len(images) else 0
        rows = heuristics.evidence_rows(g, features)
        per = lambda keep: np.concatenate([np.bincount(g.image[mask & keep], minlength=k)[images] for _, _, mask in rows])
        of = np.repeat(np.arange(len(rows)), len(images))
        tp, fp = per(truth), per(~truth)
        met = tp + fp > 0
        names, buckets = np.array([r[0] for r in rows]), np.array([min(r[1], threshold) for r in rows], np.int64)
        return {"image": np.tile(images, len(rows))[met], "feature": pa.array(names[of[met]], pa.string()), "bucket": buckets[of[met]], "tp": tp[met], "fp": fp[met]}

    counted = per_image(images, step, "feature string, bucket long, tp long, fp long", decoder)
    return counted.groupBy("feature", "bucket").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


# ---------------------------------------------------------------- metrics of any superset


def truth_counts(insn: DataFrame, vertex: DataFrame, truth: DataFrame) -> DataFrame:
    """Per image: ground truth in the graph, not in the graph, and rows that are not ground truth."""
    # One shuffle: each address with what it is.
    sides = [df.select(*AT, *(F.lit(k == i).alias(name) for k, name in enumerate(("t", "v", "r")))) for i, df in enumerate((truth, vertex, insn))]
    met = reduce(DataFrame.unionByName, sides).groupBy(*AT).agg(*(F.bool_or(c).alias(c) for c in ("t", "v", "r")))
    return met.groupBy("image_id").agg(F.count_if(F.col("t") & F.col("v")).alias("true_positives"), F.count_if(F.col("t") & ~F.col("v")).alias("false_negatives"), F.count_if(F.col("r") & ~F.col("t")).alias("false_positives"))


def occlusion(insn: DataFrame, truth: DataFrame) -> DataFrame:
    """Per image: bytes of ground-truth instructions, and conflicts in them."""
    space = truth.join(insn.select(*AT, "len"), AT, "left").groupBy("image_id").agg(F.sum(F.coalesce("len", F.lit(0))).alias("occlusive_space"))
    met = conflicts(insn).join(truth.select("image_id", F.col("addr").alias("owner")), ["image_id", "owner"], "left_semi")
    return space.join(met.groupBy("image_id").agg(F.count(F.lit(1)).alias("reduced_occlusion")), "image_id", "left").fillna(0, ["reduced_occlusion"])


def occluded_entrances(insn: DataFrame, entrances: DataFrame, reach: int = 19) -> DataFrame:
    """Entrances inside an instruction that starts at most ``reach`` bytes before."""
    over = conflicts(insn).where(F.col("addr") - F.col("owner") <= reach).select(AT)
    return entrances.join(over, AT, "left_semi")


# ---------------------------------------------------------------- the whole run


def entrances_of(g: Graph) -> np.ndarray:
    """Ground truth of the synthetic images, as nodes."""
    start = g.row & (g.addr == 1)
    line = np.flatnonzero(g.row & (g.word == 10) & (g.addr < g.size))
    start[g.find(g.image[line], g.addr[line] + 1)] = True
    return start


def summary(options: Options):
    """A row of metrics for each image: the ground truth is what entrances reach before anything is removed."""

    def step(g: Graph) -> dict:
        images = np.unique(g.image)
        starts = entrances_of(g)
        tagged = graph.tag(g, options.invariants)
        truth = tagged.close(starts, forward=True)
        pre, post = heuristics.run(g, options)
        end = post
        owner, node = end.body_nodes(end.row)
        k = int(images.max()) + 1 if len(images) else 0
        per = lambda mask: np.bincount(g.image[mask], minlength=k)[images]
        over = np.zeros(g.n, bool)
        near = end.addr[node] - end.addr[owner] <= 19
        over[node[near]] = True
        if options.compat:
            clean = starts & walks.last_visited_clean(end, starts)
        else:
            dirty = end.close(end.mask(owner), forward=False)
            clean = starts & ~dirty
        inside = truth[owner] & end.row[node]
        return {
            "image": images,
            "n_entrances": per(starts),
            "size": g.size[np.searchsorted(g.image, images)],
            "occlusive_space": np.bincount(g.image[truth], weights=np.where(end.row, g.length, 0)[truth], minlength=k)[images].astype(np.int64),
            "reduced_occlusion": np.bincount(g.image[owner[inside]], minlength=k)[images],
            "n_clean": per(clean),
            "n_occluded": per(starts & over),
            "true_positives": per(truth & end.vertex),
            "false_negatives": per(truth & ~end.vertex),
            "false_positives": per(end.row & ~truth),
            "survivors": per((pre if options.compat else post).vertex),
        }

    return step


SUMMARY = "n_entrances long, size long, occlusive_space long, reduced_occlusion long, n_clean long, n_occluded long, true_positives long, false_negatives long, false_positives long, survivors long"


def run_summary(images: DataFrame, options: Options) -> DataFrame:
    return per_image(images, summary(options), SUMMARY, options.isa)


def survivors(images: DataFrame, options: Options) -> DataFrame:
    """(image_id, addr) published by a run: after convergence, or with compat after the rounds."""

    def step(g: Graph) -> dict:
        pre, post = heuristics.run(g, options)
        at = np.flatnonzero((pre if options.compat else post).vertex)
        return {"image": g.image[at], "addr": g.addr[at]}

    return per_image(images, step, "addr long", options.isa)


def node_sets(images: DataFrame, of, decoder: str = "t8", prepared: bool = True) -> DataFrame:
    """(image_id, addr) of any function from a graph, trimmed first, to a mask."""

    def step(g: Graph) -> dict:
        if prepared:
            g = graph.tag(g).trim()
        at = np.flatnonzero(of(g))
        return {"image": g.image[at], "addr": g.addr[at]}

    return per_image(images, step, "addr long", decoder)


def node_pairs(images: DataFrame, of, decoder: str = "t8") -> DataFrame:
    """(image_id, addr, other) of a function from a trimmed graph to a dict between nodes."""

    def step(g: Graph) -> dict:
        pairs = of(graph.tag(g).trim())
        a, b = (np.fromiter(x, np.int64, len(pairs)) for x in (pairs.keys(), pairs.values()))
        return {"image": g.image[a], "addr": g.addr[a], "other": g.addr[b]}

    return per_image(images, step, "addr long, other long", decoder)


def live_rows(images: DataFrame, decoder: str = "t8") -> DataFrame:
    """(image_id, addr, var): registers live before each trimmed instruction."""

    def step(g: Graph) -> dict:
        g = graph.tag(g).trim()
        live = g.live_in()
        node, bit = np.nonzero((live[:, None] >> np.arange(8)[None, :] & 1).astype(bool) & g.vertex[:, None])
        return {"image": g.image[node], "addr": g.addr[node], "var": pa.DictionaryArray.from_arrays(pa.array(bit.astype(np.int8)), pa.array([f"r{i}" for i in range(8)])).cast(pa.string())}

    return per_image(images, step, "addr long, var string", decoder)


def loops(images: DataFrame, min_size: int = 0, decoder: str = "t8") -> DataFrame:
    """(image_id, addr, loop): members of components with more than min_size nodes, by their least address."""

    def step(g: Graph) -> dict:
        g = graph.tag(g).trim()
        label, inside = g.loops(min_size)
        at = np.flatnonzero(inside)
        return {"image": g.image[at], "addr": g.addr[at], "loop": g.addr[label[at]]}

    return per_image(images, step, "addr long, loop long", decoder)
