"""Operators that depend on the order of a depth-first walk.

All walk against control flow unless they say otherwise, take roots and neighbours by ascending address
and report a node when it is entered and when it is left.  Images of a batch never touch, so one walk
covers them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .graph import Graph


class Walker:
    def __init__(self, g: Graph, forward: bool = False) -> None:
        first, near = g.succ if forward else g.pred
        self.first, self.near = first.tolist(), near.tolist()
        self.vertex = g.vertex

    def walk(self, roots: Iterable[int], seen: set[int] | None = None) -> Iterator[tuple[bool, int]]:
        """(entered, node) events.  A node in ``seen`` is not entered again."""
        seen = set() if seen is None else seen
        for root in roots:
            if root in seen or not self.vertex[root]:
                continue
            seen.add(root)
            yield True, root
            open_ = [(root, self.first[root])]
            while open_:
                node, at = open_.pop()
                end = self.first[node + 1]
                while at < end and self.near[at] in seen:
                    at += 1
                if at == end:
                    yield False, node
                    continue
                to = self.near[at]
                open_.append((node, at + 1))
                seen.add(to)
                yield True, to
                open_.append((to, self.first[to]))

    def spread(self, root: int) -> Iterator[int]:
        """Nodes by an explicit stack: neighbours are put on it ascending and taken from its top."""
        seen, stack = {root}, [root]
        while stack:
            node = stack.pop()
            yield node
            for to in self.near[self.first[node] : self.first[node + 1]]:
                if to not in seen:
                    seen.add(to)
                    stack.append(to)


def _indices(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(mask).tolist()


def restricted_clamp(g: Graph) -> np.ndarray:
    """From each entry, what is entered before the first overlapping instruction; the entry is left out."""
    clash = g.conflicts(g.row)
    walker, out = Walker(g), np.zeros(g.n, bool)
    for entry in _indices(g.entries()):
        for entered, node in walker.walk([entry]):
            if not entered or node == entry:
                continue
            if clash[node]:
                break
            out[node] = True
    return out


def extended_clamp(g: Graph) -> np.ndarray:
    """From each free instruction, what is met before the first one with a vertex in its body."""
    owner, _ = g.body_nodes(g.row)
    occupied = g.mask(owner)
    free = g.free()
    walker, out = Walker(g), free.copy()
    for root in _indices(free & g.vertex):
        for node in walker.spread(root):
            if occupied[node]:
                break
            out[node] = True
    return out


def identify_branches(g: Graph) -> np.ndarray:
    """Branches both of whose arms lie on one open path: the tops of diamonds."""
    roots, branch = _indices(g.entries()), g.branches()
    first, near = g.succ
    after = g.find(g.image, g.fall())
    walker, path, waiting = Walker(g), set(), {}
    for entered, node in walker.walk(roots):
        if not entered:
            path.discard(node)
            continue
        path.add(node)
        if branch[node]:
            for child in near[first[node] : first[node + 1]].tolist():
                if child in path and child != node and child != after[node] and after[node] >= 0:
                    waiting[int(after[node])] = child, node
    out = np.zeros(g.n, bool)
    path.clear()
    for entered, node in walker.walk(roots):
        if not entered:
            path.discard(node)
            continue
        path.add(node)
        if node in waiting and waiting[node][0] in path:
            out[waiting[node][1]] = True
    return out


def grammar_convergent(g: Graph, threshold: int = 8) -> Graph:
    """Clears the marks of all that runs into an entry; with more than ``threshold`` branches on a path, the
    branch that many steps up is a convergent point, whose descendants' bodies are marked if it lies
    outside what was visited (it never does)."""
    branch, seen, path, points = g.branches(), set(), [], set()
    for entered, node in Walker(g).walk(_indices(g.entries()), seen):
        if not branch[node]:
            continue
        if not entered:
            path.pop()
            continue
        path.append(node)
        if len(path) > threshold:
            points.add(path[-1 - threshold])
    outside = sorted(points - seen)
    if outside:
        g = g.mark_bodies(g.mask(np.array(outside)))
        seen |= set(_indices(g.close(g.mask(np.array(outside)), forward=True)))
    return g.with_(bad=g.bad & ~g.mask(np.array(sorted(seen), np.int64)))


def branch_sweep(g: Graph) -> np.ndarray:
    """Branches met exactly twice when jump edges out of branches are taken away.

    How often a node is met does not depend on the order: once for each edge into the visited region, and
    once if it is where a walk starts."""
    back = (g.branches()[g.src]) & (g.fall()[g.dst] != g.addr[g.src])
    # One branch for each jump target: the one with the highest address.
    order = np.lexsort((g.src[back], g.dst[back]))
    child, top = g.dst[back][order], g.src[back][order]
    last = np.append(child[1:] != child[:-1], True) if len(child) else np.zeros(0, bool)
    owner = np.full(g.n, -1)
    owner[child[last]] = top[last]
    cut = owner[g.dst] == g.src
    rest = g.with_(src=g.src[~cut], dst=g.dst[~cut], _next=None, _prev=None)
    roots = rest.entries()
    visited = rest.close(roots, forward=False)
    met = np.bincount(rest.src[visited[rest.dst]], minlength=g.n) + roots
    hits = np.where(g.mask(top), met, 0)
    np.add.at(hits, owner[owner >= 0], met[owner >= 0])
    return hits == 2


def running_evidence(g: Graph, weight: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Evidence summed up along forward walks from fronds: a node with evidence gets all that its walk has met."""
    out = weight.copy()
    seen: set[int] = set()
    # What leads to no evidence neither gives nor gets any, and need not be walked.
    useful = g.close(weight > 0, forward=False)
    inside = useful[g.src] & useful[g.dst]
    walker = Walker(g.with_(src=g.src[inside], dst=g.dst[inside], _next=None, _prev=None), forward=True)
    for root in _indices((g.fronds() if roots is None else roots) & useful):
        total = 0
        for entered, node in walker.walk([root], seen):
            if entered and weight[node]:
                total += int(weight[node])
                out[node] = total
    return out


def descendant_features(g: Graph, feature: np.ndarray, depth: int) -> np.ndarray:
    """depth times: the features met on walks from the others, and those an earlier walk had visited."""
    for _ in range(depth):
        seen: set[int] = set()
        kept, walker = np.zeros(g.n, bool), Walker(g, forward=True)
        for root in _indices(feature):
            if root in seen:
                kept[root] = True
                continue
            for entered, node in walker.walk([root], seen):
                if entered and feature[node] and node != root:
                    kept[node] = True
        feature = kept
    return feature


def def_use(g: Graph) -> dict[int, int]:
    """Node that uses a register -> node that defines it, the last one met.

    A walk up from each entry notes the latest user of each register when a node is entered; a node that is left
    forgets the registers it uses and then defines those still asked for.  Nodes that use what they define ask for
    themselves and are passed over, so pairs of expressions and pairs of free variables are one and the same over
    sets of registers."""
    uses, defs = g.uses.tolist(), g.defs.tolist()
    bits = {m: [v for v in range(m.bit_length()) if m >> v & 1] for m in np.union1d(g.uses, g.defs).tolist()}
    walker, out = Walker(g), {}
    for entry in _indices(g.entries()):
        user: dict[int, int] = {}
        for entered, node in walker.walk([entry]):
            for v in bits[uses[node]]:
                if entered:
                    user[v] = node
                else:
                    user.pop(v, None)
            if not entered and user:
                for v in bits[defs[node]]:
                    if v in user:
                        out[user.pop(v)] = node
    return out


def definers(g: Graph) -> np.ndarray:
    """Nodes that define what another uses."""
    return g.mask(np.array(sorted(set(def_use(g).values())), np.int64))


def last_visited_clean(g: Graph, starts: np.ndarray) -> np.ndarray:
    """Starts whose walk along control flow ends on a node without a vertex in its body."""
    owner, _ = g.body_nodes(g.row)
    occupied, out, walker = g.mask(owner), np.zeros(g.n, bool), Walker(g, forward=True)
    for root in _indices(starts):
        last = None
        for entered, node in walker.walk([root]):
            if entered:
                last = node
        out[root] = last is None or not occupied[last]
    return out


def linear_sweep(g: Graph) -> np.ndarray:
    """What a disassembler meets that starts at the first address and always goes on after each instruction."""
    at = np.flatnonzero(g.row)
    after = g.find(g.image[at], g.addr[at] + g.length[at])
    kept = (after >= 0) & g.row[after]
    chain = g.with_(src=at[kept], dst=after[kept], vertex=g.row, _next=None, _prev=None)
    return chain.close(g.row & (g.addr == 1), forward=True)


def topological(g: Graph) -> list[int]:
    """Vertices along control flow, each once; those on cycles come last."""
    first, near = g.succ
    waits = g.in_degree()
    ready = _indices(g.vertex & (waits == 0))[::-1]
    out: list[int] = []
    while ready:
        node = ready.pop()
        out.append(node)
        for to in near[first[node] : first[node + 1]][::-1].tolist():
            waits[to] -= 1
            if waits[to] == 0:
                ready.append(to)
    done = set(out)
    return out + [v for v in _indices(g.vertex) if v not in done]
