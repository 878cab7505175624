"""Invariants as predicates over insn and edge: which addresses they mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .superset import Superset, outside


def _targets(s: Superset) -> DataFrame:
    return s.insn.select("image_id", "n", F.col("addr").alias("src"), "len", F.explode(F.array_compact(F.array("fall", "jump"))).alias("dst"))


def non_insn(s: Superset) -> DataFrame:
    return s.insn.where("NOT valid").select("image_id", "addr")


def target_not_in_mem(s: Superset) -> DataFrame:
    """The targets."""
    return _targets(s).where(outside(F.col("dst"), F.col("n"))).select("image_id", F.col("dst").alias("addr")).distinct()


def target_is_null(s: Superset) -> DataFrame:
    return _targets(s).where("dst = 0").select("image_id", F.col("dst").alias("addr")).distinct()


def target_in_body(s: Superset) -> DataFrame:
    """The sources."""
    return _targets(s).where("dst > src AND dst < src + len").select("image_id", F.col("src").alias("addr")).distinct()


REGISTRY = {
    "Tag non insn": non_insn,
    "Tag target not in mem": target_not_in_mem,
    "Tag target is bad": target_is_null,
    "Tag target in body": target_in_body,
}


def tagged(s: Superset, names=tuple(REGISTRY)) -> Superset:
    for name in names:
        if name in REGISTRY:
            s = s.vertex_bad(REGISTRY[name](s))
    return s
