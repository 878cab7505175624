"""Registries of extractors, markers and analyses, and the rounds that apply them.

An extractor names a set of addresses; a marker marks what contradicts it; an analysis does so once, before
the rounds.  Names that a registry does not know are passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import isa, walks
from .graph import INVARIANTS, Graph, tag

#: A large loop has more members than this; a callsite more callers.
LOOP_SIZE = 20
CALLSITE_THRESHOLD = 6

Extractor = Callable[[Graph], np.ndarray]
Marker = Callable[[Graph], Graph]


def main_entry(g: Graph) -> np.ndarray:
    return g.vertex & (g.addr == 1) & (g.size > 0)


def exitless(g: Graph) -> np.ndarray:
    """Rows that can reach no terminating instruction."""
    return g.row & ~g.close(g.entries(), forward=False)


def constants(g: Graph) -> np.ndarray:
    """Vertices whose address is stored as a word somewhere in the image."""
    at = np.flatnonzero((g.word >= 1) & (g.word <= g.size))
    node = g.find(g.image[at], g.word[at])
    return g.mask(node[(node >= 0) & g.vertex[node]])


def loops_with_break(g: Graph) -> np.ndarray:
    """Members of loops from which control can leave the loop."""
    label, inside = g.loops(1)
    leaves = inside[g.src] & (label[g.src] != label[g.dst])
    out = np.zeros(g.n, bool)
    out[label[g.src[leaves]]] = True
    return inside & out[label]


def liveness(g: Graph) -> np.ndarray:
    return g.vertex & (g.live_in() != 0)


#: The names by which users choose heuristics, here and below.
EXTRACTORS: dict[str, Extractor] = {
    "FixpointGrammar": lambda g: g.branches(),
    "Liveness": liveness,
    "LinearGrammar": walks.branch_sweep,
    "UnfilteredGrammar": lambda g: g.branches(),
    "ClassicGrammar": walks.identify_branches,
    "Callsites3": lambda g: g.callsites(CALLSITE_THRESHOLD),
    "Clamped": lambda g: g.free(),
    "RestrictedClamped": walks.restricted_clamp,
    "ExtendedClamped": walks.extended_clamp,
    "UnfilteredSCC": lambda g: g.loops(1)[1],
    "LoopsWithBreak": loops_with_break,
    "SCC": lambda g: g.loops(LOOP_SIZE)[1],
    "NoExit": exitless,
    "Constant": constants,
    "ImgEntry": main_entry,
}

#: Points of evidence by feature.
WEIGHTS = {"FixpointGrammar": 1, "Liveness": 1}
#: Weights and threshold of the older generation.
OLD_WEIGHTS, OLD_THRESHOLD = {"FixpointGrammar": 5, "FixpointFreevarSSA": 3}, 50
DEFAULT_WEIGHT = 2


def trim_clamped(g: Graph) -> Graph:
    """Marks what overlaps the lineage of free instructions, but not the lineage itself."""
    free = g.free()
    lineage = g.close(free, forward=True)
    marked = g.mark_bodies(free)
    return marked.with_(bad=marked.bad & ~lineage & ~free)


def trim_limited_clamped(g: Graph) -> Graph:
    """As above from a clean slate, sparing the lineage of callsites."""
    spared = g.close(g.callsites(0), forward=True)
    marked = trim_clamped(g.with_(bad=np.zeros(g.n, bool)))
    return marked.with_(bad=marked.bad & ~spared)


def mark_lineage_bodies(g: Graph, seeds: np.ndarray, always: bool = False) -> Graph:
    """From a clean slate, marks the bodies of what seeds lead to, and spares what seeds or callsites lead to.
    The lineage of callsites is not walked; always: the seeds in it still have their own bodies marked."""
    spared = g.close(g.callsites(0), forward=True)
    lineage = g.close(seeds, forward=True)
    walked = lineage & ~spared | (seeds & g.vertex if always else False)
    marked = g.with_(bad=np.zeros(g.n, bool)).mark(g.mask(g.body_nodes(walked)[1]))
    return marked.with_(bad=marked.bad & ~lineage & ~spared)


def trim_descendant_features(g: Graph, extract: Extractor, depth: int) -> Graph:
    """The older generation's markers: by features that others lead to, depth times over."""
    return mark_lineage_bodies(g, walks.descendant_features(g, extract(g), depth))


def discard_edges(g: Graph) -> Graph:
    """Without the edges that leave a call other than by falling through."""
    kept = (g.kind[g.src] != isa.CALL) | g.is_fall_edge()
    return g.with_(src=g.src[kept], dst=g.dst[kept], _next=None, _prev=None)


MARKERS: dict[str, Marker] = {
    "Callsites3": lambda g: g.with_(bad=np.zeros(g.n, bool)),
    "ImgEntry": lambda g: g.mark_bodies(main_entry(g)),
    "NoExit": lambda g: g.mark(exitless(g)),
    "TrimLimitedClamped": trim_limited_clamped,
}


#: Names and depths of the older generation.  Those that rest on predicates without a definition
#: (layer and branch violations, filtered and loop grammar, tails) are not known.
OLD_EXTRACTORS: dict[str, Extractor] = {**{name: f for name, f in EXTRACTORS.items() if name != "Liveness"}, "FixpointFreevarSSA": walks.definers}
OLD_MAPS: dict[str, Callable[[Graph], dict[int, int]]] = {"SSA": walks.def_use, "FreeVarSSA": walks.def_use}
OLD_MARKERS: dict[str, Marker] = {
    **MARKERS,
    "DiscardEdges": discard_edges,
    "TrimFixpointGrammar": lambda g: trim_descendant_features(g, lambda x: x.branches(), 10),
    "TrimFixpointSSA": lambda g: trim_descendant_features(g, walks.definers, 6),
    "TrimFixpointFreevarSSA": lambda g: trim_descendant_features(g, walks.definers, 6),
}


def apply_old_features(g: Graph, features: tuple[str, ...], threshold: int = OLD_THRESHOLD) -> Graph:
    """Weighs features by the older generation's points and marks the bodies of what the nodes over the threshold
    lead to; nothing is removed yet."""
    total = walks.running_evidence(g, evidence_total(g, features, OLD_EXTRACTORS, OLD_WEIGHTS))
    return mark_lineage_bodies(g, total > threshold, always=True)


def loop_contradictions(g: Graph, min_size: int = LOOP_SIZE) -> Graph:
    """Marks what runs into a large loop and overlaps it."""
    _, keep = g.loops(min_size)
    parents = g.mask(g.src[keep[g.dst] & ~keep[g.src]])
    return g.mark(g.conflicts(keep) & parents & ~keep)


#: Features that are listed for users; not all that are known.
ALL_FEATURES = ("RestrictedClamped", "ExtendedClamped", "UnfilteredSCC", "SCC", "NoExit", "LoopsWithBreak", "Constant", "ImgEntry", "Clamped", "Callsites3", "LinearGrammar", "ClassicGrammar", "UnfilteredGrammar", "FixpointGrammar", "Liveness")

ANALYSES: dict[str, Marker] = {
    "Strongly Connected Component Data": loop_contradictions,
    "Grammar convergent": walks.grammar_convergent,
}


@dataclass(frozen=True)
class Options:
    """What a run does.  compat publishes the survivors before convergence, as they stand after the rounds."""

    heuristics: tuple[str, ...] = ("Callsites3", "TrimLimitedClamped", "BranchViolations", "ImgEntry")
    invariants: tuple[str, ...] = tuple(INVARIANTS)
    analyses: tuple[str, ...] = ("Strongly Connected Component Data",)
    rounds: int = 2
    tp_threshold: float = 0.99
    converge: bool = True
    protect: bool = True
    compat: bool = False
    isa: str = "t8"
    loader: str = "text"

    def __post_init__(self) -> None:
        if self.rounds < 1:
            raise ValueError("rounds must be at least 1")

    @property
    def threshold(self) -> int:
        """Points that evidence must exceed; truncated, so that 0.99 gives 99."""
        return int(1.0 / (1.0 - self.tp_threshold))


def iterate(rounds: int, step: Marker, g: Graph) -> Graph:
    g = step(g)
    for _ in range(rounds - 1):
        g = step(g).trim()
    return g


def evidence_rows(g: Graph, heuristics: tuple[str, ...], extractors: dict[str, Extractor] = EXTRACTORS, weights: dict[str, int] = WEIGHTS) -> list[tuple[str, int, np.ndarray]]:
    """(feature, weight, nodes) of each known heuristic."""
    return [(h, weights.get(h, DEFAULT_WEIGHT), extractors[h](g)) for h in heuristics if h in extractors]


def evidence_total(g: Graph, heuristics: tuple[str, ...], extractors: dict[str, Extractor] = EXTRACTORS, weights: dict[str, int] = WEIGHTS) -> np.ndarray:
    total = np.zeros(g.n, np.int64)
    for _, weight, nodes in evidence_rows(g, heuristics, extractors, weights):
        total[nodes] += weight
    return total


def protect(g: Graph, step: Marker) -> Graph:
    """Applies a step but spares what callsites lead to."""
    spared = g.close(g.callsites(0), forward=True)
    after = step(g)
    return after.with_(bad=after.bad & ~spared).trim()


def converge(g: Graph, known: np.ndarray) -> Graph:
    return g.trim().mark_bodies(known)


def prepare(g: Graph, options: Options) -> Graph:
    """Invariants, trim, analyses."""
    g = tag(g, options.invariants).trim()
    for name in options.analyses:
        if name in ANALYSES:
            g = ANALYSES[name](g)
    return g.trim()


def one_round(g: Graph, heuristics: tuple[str, ...], markers: dict[str, Marker] = MARKERS) -> Graph:
    for name in heuristics:
        if name in markers:
            g = markers[name](g).trim()
    return g


def run(g: Graph, options: Options) -> tuple[Graph, Graph]:
    """(after the rounds, after convergence)."""
    g = iterate(options.rounds, lambda x: one_round(x, options.heuristics), prepare(g, options))
    if not options.converge:
        return g, g
    total = walks.running_evidence(g, evidence_total(g, options.heuristics))
    known = total > options.threshold

    def step(x: Graph) -> Graph:
        return (protect(x, lambda y: converge(y, known)) if options.protect else converge(x, known)).trim()

    return g, iterate(options.rounds, step, g)
