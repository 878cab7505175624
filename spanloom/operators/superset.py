"""The superset of candidate instructions as DataFrames.

``images`` has (image_id, bytes).  Decoding is local to an image, so ``decode`` and ``per_image`` run in one
stage without a shuffle; what follows is joins and aggregates on (image_id, addr).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import graph, isa
from spanloom.functions.graph import Graph
from spanloom.runtime import ship

#: Bytes of images handled at once; a larger image is handled alone.
PIECE_BYTES = 1 << 19
ROW = "image_id long, addr long, len int, valid boolean, kind string, fall long, jump long, n long, word long, defs int, uses int"


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """(rows, bytes, where each image starts), a piece at a time; null images are passed over."""
    batch = batch.filter(batch.column("bytes").is_valid())
    size = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + PIECE_BYTES, side="right")))
        part = batch.slice(at, end - at)
        yield part, b"".join(part.column("bytes").to_pylist()), np.append(0, size[at:end] - base)
        at = end


def per_image(images: DataFrame, step: Callable[..., dict[str, np.ndarray]], schema: str, decoder: str = "t8", beside: str | None = None) -> DataFrame:
    """Runs a step over the graphs of many images at once.  The step's columns are returned with image_id, from
    its ``image`` entry, first.  beside: a further column of images, which the step is given too."""
    ship(images.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ = isa.ISAS[decoder]
        for batch in batches:
            for part, data, first in _pieces(batch):
                g = graph.build(decode_(data, first))
                out = step(g) if beside is None else step(g, part.column(beside))
                columns = [part.column("image_id").take(pa.array(out["image"])), *(v if isinstance(v, pa.Array) else pa.array(v) for v in (out[n] for n in names))]
                made = pa.RecordBatch.from_arrays(columns, ["image_id", *names])
                for k in range(0, made.num_rows, 1 << 16):
                    yield made.slice(k, 1 << 16)

    return images.select(F.col("image_id").cast("long"), F.col("bytes").cast("binary"), *([beside] if beside else [])).mapInArrow(run, f"image_id long, {schema}")


_ROW_FIELDS = ROW.removeprefix("image_id long, ")
_FALLS, _JUMPS = np.isin(range(len(isa.KINDS)), (isa.COND, isa.CALL, isa.SEQ)), np.isin(range(len(isa.KINDS)), (isa.JMP, isa.COND, isa.CALL))

#: How each field of a row is read off the nodes at some places.
_FIELDS: dict[str, Callable[[Graph, np.ndarray], object]] = {
    "addr": lambda g, at: g.addr[at],
    "len": lambda g, at: g.length[at].astype(np.int32),
    "valid": lambda g, at: g.valid[at],
    "kind": lambda g, at: pa.DictionaryArray.from_arrays(pa.array(g.kind[at].astype(np.int8)), pa.array(isa.KINDS)).cast(pa.string()),
    "fall": lambda g, at: pa.array(g.addr[at] + g.length[at], mask=~_FALLS[g.kind[at]]),
    "jump": lambda g, at: pa.array(g.jump[at], mask=~_JUMPS[g.kind[at]]),
    "n": lambda g, at: g.size[at],
    "word": lambda g, at: g.word[at],
    "defs": lambda g, at: g.defs[at].astype(np.int32),
    "uses": lambda g, at: g.uses[at].astype(np.int32),
}


def rows_of(g: Graph, fields: tuple[str, ...] = tuple(_FIELDS)) -> dict[str, object]:
    """The instruction map as columns."""
    at = np.flatnonzero(g.row)
    return {"image": g.image[at], **{f: _FIELDS[f](g, at) for f in fields}}


@dataclass(frozen=True)
class Superset:
    """insn: the map of candidates; edge: (image_id, src, dst) along control flow; vertex: (image_id, addr); bad."""

    insn: DataFrame
    edge: DataFrame
    vertex: DataFrame
    bad: DataFrame

    def vertex_bad(self, marks: DataFrame) -> Superset:
        """More marks; only vertices can be marked."""
        more = marks.select("image_id", "addr").join(self.vertex, ["image_id", "addr"], "left_semi")
        return Superset(self.insn, self.edge, self.vertex, self.bad.unionByName(more).distinct())

    def clear_all_bad(self) -> Superset:
        return Superset(self.insn, self.edge, self.vertex, self.bad.limit(0))

    def clear_bad(self, marks: DataFrame) -> Superset:
        return Superset(self.insn, self.edge, self.vertex, self.bad.join(marks, ["image_id", "addr"], "left_anti"))

    def remove(self, gone: DataFrame) -> Superset:
        """Without some addresses: their rows, vertices, edges and marks."""
        gone = gone.select("image_id", "addr").distinct()
        drop = lambda df, c: df.join(gone.withColumnRenamed("addr", c), ["image_id", c], "left_anti")
        return Superset(drop(self.insn, "addr"), drop(drop(self.edge, "src"), "dst").select("image_id", "src", "dst"), drop(self.vertex, "addr"), drop(self.bad, "addr"))

    def add(self, rows: DataFrame) -> Superset:
        """Upserts rows of the map and their vertices."""
        kept = self.insn.join(rows.select("image_id", "addr"), ["image_id", "addr"], "left_anti")
        return Superset(kept.unionByName(rows), self.edge, self.vertex.unionByName(rows.select("image_id", "addr")).distinct(), self.bad)

    def link(self, edges: DataFrame) -> Superset:
        ends = edges.select("image_id", F.col("src").alias("addr")).unionByName(edges.select("image_id", F.col("dst").alias("addr")))
        return Superset(self.insn, self.edge.unionByName(edges).distinct(), self.vertex.unionByName(ends).distinct(), self.bad)

    def unlink(self, edges: DataFrame) -> Superset:
        return Superset(self.insn, self.edge.join(edges, ["image_id", "src", "dst"], "left_anti"), self.vertex, self.bad)


def empty(spark) -> Superset:
    """No images: every membership test is false."""
    none = spark.createDataFrame([], "image_id long, addr long")
    return Superset(spark.createDataFrame([], ROW), spark.createDataFrame([], "image_id long, src long, dst long"), none, none)


def next_chunk(images: DataFrame, addr: int) -> DataFrame:
    """What is left of each image after an address."""
    return images.select("image_id", F.substring("bytes", addr + 1, 1 << 30).alias("bytes")).where(F.octet_length("bytes") > 0)


def edges_of(insn: DataFrame) -> DataFrame:
    """Each known target once; a jump to the fall-through is one edge."""
    targets = F.array_compact(F.array("fall", F.when(~F.col("jump").eqNullSafe(F.col("fall")), F.col("jump"))))
    return insn.select("image_id", F.col("addr").alias("src"), F.explode(targets).alias("dst"))


def joinable(df: DataFrame) -> DataFrame:
    """For joins of what Python returns.  Spark takes it for no larger than the images, though it has rows for every
    byte of them, and would send it through the driver to all executors; such joins are to sort and merge."""
    return df.hint("merge")


def outside(dst: Column, n: Column) -> Column:
    return (dst < 1) | (dst > n)


def vertices_of(insn: DataFrame) -> DataFrame:
    """Every offset, and targets outside the image; the rest are offsets already."""
    targets = insn.select("image_id", "n", F.explode(F.array_compact(F.array("fall", "jump"))).alias("addr")).where(outside(F.col("addr"), F.col("n")))
    return insn.select("image_id", "addr").unionByName(targets.select("image_id", "addr").distinct())


def decode(images: DataFrame, decoder: str = "t8", skip_first: bool = False) -> DataFrame:
    """A row for every offset; skip_first leaves out the first offset of each image."""
    insn = per_image(images, rows_of, _ROW_FIELDS, decoder)
    return insn.where("addr > 1") if skip_first else insn


#: Addresses that one bitmap of a packed set covers, as a power of two.
BITMAP = 12


def packed(addrs: DataFrame) -> DataFrame:
    """(image_id, block, bits): (image_id, addr) as bitmaps, without zeros at their ends.  A block comes once for each
    batch that has some of it.  So a set of most addresses is dealt at a bit each, not a row."""
    ship(addrs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, addr = (batch.column(c).to_numpy() for c in ("image_id", "addr"))
            block = addr >> BITMAP
            order = np.lexsort((block, image))
            image, block, addr = image[order], block[order], addr[order]
            new = np.ones(len(addr), bool)
            new[1:] = (image[1:] != image[:-1]) | (block[1:] != block[:-1])
            at, bits = np.flatnonzero(new), []
            for part in np.split(addr, at[1:]):
                held = np.zeros(1 << BITMAP, bool)
                held[part & (1 << BITMAP) - 1] = True
                bits.append(np.packbits(held, bitorder="little").tobytes().rstrip(b"\0"))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(image[at]), pa.array(block[at]), pa.array(bits, pa.binary())], ["image_id", "block", "bits"])

    known = addrs.select(F.col("image_id").cast("long"), F.col("addr").cast("long")).where("image_id IS NOT NULL AND addr IS NOT NULL")
    return known.mapInArrow(run, "image_id long, block long, bits binary")


def decode_at(images: DataFrame, addrs: DataFrame, decoder: str = "t8", fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """Only the given (image_id, addr), as when a cached graph is read again; unmapped ones are passed over.  The
    addresses are sent to their images as bitmaps, and no other row leaves Python."""
    of = {f.split()[0]: f for f in _ROW_FIELDS.split(", ")}
    wanted = packed(addrs).groupBy("image_id").agg(F.collect_list(F.struct("block", "bits")).alias("wanted"))

    def step(g: Graph, wanted: pa.Array) -> dict[str, object]:
        held = wanted.flatten()
        image = np.repeat(np.arange(len(wanted)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
        addr = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (block << BITMAP) for block, bits in zip(held.field("block").to_pylist(), held.field("bits").to_pylist())]
        node = g.find(np.repeat(image, [len(x) for x in addr]), np.concatenate([np.zeros(0, np.int64), *addr]))
        keep = g.mask(node[node >= 0])
        return rows_of(g.with_(row=g.row & keep), fields)

    return per_image(images.join(joinable(wanted), "image_id"), step, ", ".join(of[f] for f in fields), decoder, "wanted")


def _prepared(invariants: tuple[str, ...] | None) -> Callable[[Graph], Graph]:
    return (lambda g: g) if invariants is None else lambda g: graph.tag(g, invariants).trim()


def edge_rows(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] | None = None, among: Callable[[Graph], np.ndarray] | None = None) -> DataFrame:
    """(image_id, src, dst), made where the images are: no other column leaves Python.  invariants: trim by these first;
    among: of what is left, only edges between the nodes of this mask."""
    ready = _prepared(invariants)

    def step(g: Graph) -> dict[str, np.ndarray]:
        g = ready(g)
        g = g if among is None else g.keep(among(g))
        return {"image": g.image[g.src], "src": g.addr[g.src], "dst": g.addr[g.dst]}

    return per_image(images, step, "src long, dst long", decoder)


def vertex_rows(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] | None = None) -> DataFrame:
    ready = _prepared(invariants)

    def step(g: Graph) -> dict[str, np.ndarray]:
        g = ready(g)
        at = np.flatnonzero(g.vertex)
        return {"image": g.image[at], "addr": g.addr[at]}

    return per_image(images, step, "addr long", decoder)


def conflict_rows(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] | None = None) -> DataFrame:
    """(image_id, owner, addr): vertices inside the instructions of the map, found without a shuffle."""
    ready = _prepared(invariants)

    def step(g: Graph) -> dict[str, np.ndarray]:
        g = ready(g)
        owner, node = g.body_nodes(g.row)
        return {"image": g.image[owner], "owner": g.addr[owner], "addr": g.addr[node]}

    return per_image(images, step, "owner long, addr long", decoder)


def parent_conflict_rows(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] | None = None) -> DataFrame:
    """(image_id, parent, addr): parents share a successor with addr and have it in their bodies, found without a shuffle."""
    ready = _prepared(invariants)

    def step(g: Graph) -> dict[str, np.ndarray]:
        g = ready(g)
        parent, node = g.parent_conflicts()
        return {"image": g.image[parent], "parent": g.addr[parent], "addr": g.addr[node]}

    return per_image(images, step, "parent long, addr long", decoder)


def unbalanced_rows(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] | None = None) -> DataFrame:
    """(image_id, addr, side): in the map but not in the graph, or the reverse, found without a shuffle."""
    ready = _prepared(invariants)

    def step(g: Graph) -> dict[str, object]:
        g = ready(g)
        at = np.flatnonzero(g.row != g.vertex)
        return {"image": g.image[at], "addr": g.addr[at], "side": pa.array(np.where(g.row[at], "map", "graph"), pa.string())}

    return per_image(images, step, "addr long, side string", decoder)


def scan(images: DataFrame, decoder: str = "t8") -> Superset:
    vertex = joinable(vertex_rows(images, decoder))
    return Superset(joinable(decode(images, decoder)), joinable(edge_rows(images, decoder)), vertex, vertex.limit(0))


def trimmed_rows(images: DataFrame, fields: tuple[str, ...], decoder: str = "t8", invariants: tuple[str, ...] = tuple(graph.INVARIANTS)) -> DataFrame:
    """The map after trimming, with only the fields asked for: columns are pruned before they leave Python."""
    of = {f.split()[0]: f for f in _ROW_FIELDS.split(", ")}
    return per_image(images, lambda g: rows_of(graph.tag(g, invariants).trim(), fields), ", ".join(of[f] for f in fields), decoder)


def _trimmed(invariants: tuple[str, ...]) -> Callable[[Graph], dict[str, np.ndarray]]:
    return lambda g: rows_of(graph.tag(g, invariants).trim())


def trimmed(images: DataFrame, decoder: str = "t8", invariants: tuple[str, ...] = tuple(graph.INVARIANTS)) -> Superset:
    """Tagged and trimmed in the scan's own stage.  What survives has only surviving successors, and is in the
    map and in the graph."""
    vertex = joinable(vertex_rows(images, decoder, invariants))
    return Superset(joinable(per_image(images, _trimmed(invariants), _ROW_FIELDS, decoder)), joinable(edge_rows(images, decoder, invariants)), vertex, vertex.limit(0))


def body_bytes(insn: DataFrame) -> DataFrame:
    """(image_id, owner, addr): bytes after the first of each instruction."""
    longer = insn.where("len > 1")
    return longer.select("image_id", F.col("addr").alias("owner"), F.explode(F.sequence(F.col("addr") + 1, F.col("addr") + F.col("len") - 1)).alias("addr"))
