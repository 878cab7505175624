"""Graphs of candidate instructions as arrays, many images at a time.

A ``Graph`` is the disjoint union of the images of one batch, so every set operation runs over all of them
at once.  Edges point the way control flows.  Operators that depend on visiting order walk one image at a
time and take neighbours by ascending address.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .isa import Decoded


#: Addresses are kept as positive numbers of 40 bits; relative jumps of 32 bits cannot leave that range.
ADDRESS_BASE = 1 << 33


def csr(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists: those of node i are list[first[i]:first[i + 1]], ascending."""
    order = np.lexsort((b, a))
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def once(nodes: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each node once.  scratch: room for a number by node; what it holds does not matter."""
    order = np.arange(len(nodes))
    scratch[nodes] = order
    return nodes[scratch[nodes] == order]


@dataclass
class Graph:
    image: np.ndarray
    addr: np.ndarray
    length: np.ndarray  # 0 where there is no instruction
    valid: np.ndarray
    row: np.ndarray  # in the instruction map
    vertex: np.ndarray  # in the graph
    src: np.ndarray
    dst: np.ndarray
    bad: np.ndarray
    defs: np.ndarray
    uses: np.ndarray
    size: np.ndarray  # bytes of the node's image
    kind: np.ndarray
    word: np.ndarray
    jump: np.ndarray  # 0 where there is none
    _next: tuple | None = field(default=None, repr=False)
    _prev: tuple | None = field(default=None, repr=False)

    @property
    def n(self) -> int:
        return len(self.addr)

    # -- lookups

    def find(self, image: np.ndarray, addr: np.ndarray) -> np.ndarray:
        """Index of each (image, address), or -1."""
        if not self.n:
            return np.full(len(addr), -1)
        key, want = self._key(self.image, self.addr), self._key(image, addr)
        at = np.minimum(np.searchsorted(key, want), self.n - 1)
        return np.where(key[at] == want, at, -1)

    @staticmethod
    def _key(image: np.ndarray, addr: np.ndarray) -> np.ndarray:
        return image.astype(np.int64) << 40 | addr.astype(np.int64) + ADDRESS_BASE

    @property
    def succ(self) -> tuple[np.ndarray, np.ndarray]:
        if self._next is None:
            self._next = csr(self.n, self.src, self.dst)
        return self._next

    @property
    def pred(self) -> tuple[np.ndarray, np.ndarray]:
        if self._prev is None:
            self._prev = csr(self.n, self.dst, self.src)
        return self._prev

    def mask(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[nodes] = True
        return out

    def mapped(self, addr: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (addr >= 1) & (addr <= self.size[node])

    def fall(self) -> np.ndarray:
        """Address after each node; its own where it has no instruction."""
        return self.addr + self.length

    def is_fall_edge(self) -> np.ndarray:
        return self.fall()[self.src] == self.addr[self.dst]

    # -- closures

    def close(self, seeds: np.ndarray, forward: bool) -> np.ndarray:
        """seeds (a mask) and all that they reach (forward) or that reaches them, within the graph."""
        first, near = self.succ if forward else self.pred
        found = seeds & self.vertex
        edge, scratch = np.flatnonzero(found), np.empty(self.n, np.int64)
        while len(edge):
            n = first[edge + 1] - first[edge]
            total = int(n.sum())
            if not total:
                break
            at = np.repeat(first[edge] - (np.cumsum(n) - n), n) + np.arange(total)
            new = near[at]
            new = new[~found[new]]
            found[new] = True
            edge = once(new, scratch)
        return found

    def keep(self, stay: np.ndarray) -> Graph:
        """Without the other vertices, their edges and rows; marks are cleared."""
        edges = stay[self.src] & stay[self.dst]
        return self.with_(vertex=self.vertex & stay, row=self.row & stay, src=self.src[edges], dst=self.dst[edges], bad=np.zeros(self.n, bool), _next=None, _prev=None)

    def with_(self, **changes) -> Graph:
        return Graph(**{**self.__dict__, **changes})

    def trim(self) -> Graph:
        """Removes all that can run into a marked node."""
        if not self.bad.any():
            return self
        return self.keep(~self.close(self.bad, forward=False))

    def mark(self, where: np.ndarray) -> Graph:
        return self.with_(bad=self.bad | (where & self.vertex))

    # -- overlaps

    def bodies(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, address) of the bytes after the first of each instruction in a mask."""
        own = np.flatnonzero(of & (self.length > 1))
        n = self.length[own] - 1
        owner = np.repeat(own, n)
        return owner, self.addr[owner] + 1 + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)

    def body_nodes(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, node): vertices inside the instructions of a mask."""
        owner, addr = self.bodies(of)
        node = self.find(self.image[owner], addr)
        kept = (node >= 0) & self.vertex[node]
        return owner[kept], node[kept]

    def conflicts(self, of: np.ndarray) -> np.ndarray:
        """The instructions of a mask that have vertices in their bodies, and those vertices."""
        owner, node = self.body_nodes(of & self.row)
        return self.mask(owner) | self.mask(node)

    def parent_conflicts(self) -> tuple[np.ndarray, np.ndarray]:
        """(parent, node): vertices inside an instruction that share a successor with it."""
        parent, node = self.body_nodes(self.row)
        first, near = self.succ
        n = first[parent + 1] - first[parent]
        pair = np.repeat(np.arange(len(parent)), n)
        dst = near[np.repeat(first[parent] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
        edges, want = np.sort(self.src * self.n + self.dst), node[pair] * self.n + dst
        at = np.minimum(np.searchsorted(edges, want), max(len(edges) - 1, 0))
        shared = np.unique(pair[edges[at] == want])
        return parent[shared], node[shared]

    def free(self) -> np.ndarray:
        """Instructions that overlap no other."""
        return self.row & ~self.conflicts(self.row)

    def mark_bodies(self, seeds: np.ndarray) -> Graph:
        """Marks every vertex inside an instruction that the seeds reach."""
        return self.mark(self.mask(self.body_nodes(self.close(seeds, forward=True))[1]))

    # -- degrees

    def out_degree(self) -> np.ndarray:
        return np.bincount(self.src, minlength=self.n)

    def in_degree(self) -> np.ndarray:
        return np.bincount(self.dst, minlength=self.n)

    def entries(self) -> np.ndarray:
        """Nodes without successors that something runs into."""
        return (self.out_degree() == 0) & (self.in_degree() > 0)

    def fronds(self) -> np.ndarray:
        return (self.in_degree() == 0) & (self.out_degree() > 0)

    def branches(self) -> np.ndarray:
        return self.out_degree() >= 2

    def callsites(self, threshold: int) -> np.ndarray:
        """Nodes with more than ``threshold`` predecessors that do not fall through to them."""
        return self.vertex & (np.bincount(self.dst[~self.is_fall_edge()], minlength=self.n) > threshold)

    # -- strongly connected components

    def components(self) -> np.ndarray:
        """For each vertex on a cycle, or alone: the least node of its component."""
        label = np.arange(self.n)
        # Peel off what lies on no cycle before walking: first what leads nowhere, then what nothing leads to.
        live = self._peeled(self.vertex, self.src, self.pred)
        inside = live[self.src] & live[self.dst]
        live = self._peeled(live, self.dst[inside], csr(self.n, self.src[inside], self.dst[inside]))
        inside = live[self.src] & live[self.dst]
        first, near = csr(self.n, self.src[inside], self.dst[inside])
        order, low, on, stack, count = {}, {}, set(), [], 0
        first, near = first.tolist(), near.tolist()
        for root in np.flatnonzero(live).tolist():
            if root in order:
                continue
            work = [(root, first[root])]
            order[root] = low[root] = count
            count += 1
            stack.append(root)
            on.add(root)
            while work:
                node, at = work.pop()
                if at < first[node + 1]:
                    work.append((node, at + 1))
                    to = near[at]
                    if to not in order:
                        order[to] = low[to] = count
                        count += 1
                        stack.append(to)
                        on.add(to)
                        work.append((to, first[to]))
                    elif to in on:
                        low[node] = min(low[node], order[to])
                    continue
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    label[members] = min(members)
        return label

    @staticmethod
    def _peeled(live: np.ndarray, ends: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Without nodes that have no edge left, counted in ``ends``, when those before them are gone; lists: whose
        edges a node takes along when it goes."""
        first, near = lists
        left = np.bincount(ends, minlength=len(live))
        now = np.flatnonzero(live & (left == 0))
        live, scratch = live.copy(), np.empty(len(live), np.int64)
        while len(now):
            live[now] = False
            n = first[now + 1] - first[now]
            at = np.repeat(first[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            touched = near[at]
            np.subtract.at(left, touched, 1)
            now = once(touched[live[touched] & (left[touched] == 0)], scratch)
        return live

    def loops(self, min_size: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(label, mask): components with more than ``min_size`` members."""
        label = self.components()
        size = np.bincount(label[self.vertex], minlength=self.n)
        return label, self.vertex & (size[label] > min_size)

    # -- liveness

    def live_in(self) -> np.ndarray:
        """Registers live before each node: uses, and what is live after it less what it defines."""
        live = self.uses.copy()
        live[~self.vertex] = 0
        edge = np.ones(len(self.src), bool)
        while edge.any():
            flow = live[self.dst[edge]] & ~self.defs[self.src[edge]]
            before = live.copy()
            np.bitwise_or.at(live, self.src[edge], flow)
            changed = live != before
            edge = changed[self.dst]
        return live


def build(decoded: Decoded) -> Graph:
    """Graph of all candidates: every offset and every known target is a vertex."""
    d = decoded
    inner = Graph._key(d.image, d.addr)
    # A jump to the fall-through is no second edge.
    has_jump = d.has_jump & ~(d.has_fall & (d.jump == d.fall))
    sides = [(np.flatnonzero(has), target[has]) for has, target in ((d.has_fall, d.fall), (has_jump, d.jump))]
    beyond = [(to < 1) | (to > d.size[at]) for at, to in sides]
    outer = np.unique(np.concatenate([Graph._key(d.image[at][far], to[far]) for (at, to), far in zip(sides, beyond)]))
    # Offsets are in order already; the few targets outside are put between them.
    at = np.arange(len(inner)) + np.searchsorted(outer, inner)
    out_at = np.searchsorted(inner, outer) + np.arange(len(outer))
    n = len(inner) + len(outer)
    key = np.empty(n, np.int64)
    key[at], key[out_at] = inner, outer
    image, addr = key >> 40, (key & (1 << 40) - 1) - ADDRESS_BASE
    row = np.zeros(n, bool)
    row[at] = True

    def spread(values: np.ndarray, fill=0) -> np.ndarray:
        out = np.full(n, fill, values.dtype)
        out[at] = values
        return out

    ends = []
    for (own, to), far in zip(sides, beyond):
        node = np.empty(len(own), np.int64)
        node[~far] = at[(own + to - d.addr[own])[~far]]
        node[far] = out_at[np.searchsorted(outer, Graph._key(d.image[own][far], to[far]))]
        ends.append((at[own], node))
    src, dst = (np.concatenate(x) for x in zip(*ends))
    sizes = np.zeros(int(image.max()) + 1 if n else 0, np.int64)
    sizes[d.image] = d.size
    return Graph(image, addr, spread(d.length), spread(d.valid, False), row, np.ones(n, bool), src, dst, np.zeros(n, bool), spread(d.defs), spread(d.uses), sizes[image] if n else addr, spread(d.kind, 4), spread(d.word, -1), spread(d.jump))


def fixpoint(g: Graph, start: np.ndarray, transfer, merge=np.maximum, forward: bool = True, rounds: int | None = None) -> np.ndarray:
    """A generic dataflow solver: values flow along edges (or against them), changed by transfer(values, nodes)
    on leaving a node and merged on arrival by a ufunc, until nothing changes or ``rounds`` have passed."""
    a, b = (g.src, g.dst) if forward else (g.dst, g.src)
    now = start.copy()
    while rounds is None or rounds > 0:
        new = now.copy()
        merge.at(new, b, transfer(now[a], a))
        if (new == now).all():
            break
        now, rounds = new, None if rounds is None else rounds - 1
    return now


# ---------------------------------------------------------------- invariants


def non_insn(g: Graph) -> np.ndarray:
    return g.row & ~g.valid


def target_not_in_mem(g: Graph) -> np.ndarray:
    """Marks the targets."""
    return g.mask(g.dst[~g.mapped(g.addr[g.dst], g.src)])


def target_is_null(g: Graph) -> np.ndarray:
    return g.mask(g.dst[g.addr[g.dst] == 0])


def target_in_body(g: Graph) -> np.ndarray:
    a, b = g.addr[g.src], g.addr[g.dst]
    return g.mask(g.src[(b > a) & (b < a + g.length[g.src])])


#: The names by which users choose invariants.
INVARIANTS = {
    "Tag non insn": non_insn,
    "Tag target not in mem": target_not_in_mem,
    "Tag target is bad": target_is_null,
    "Tag target in body": target_in_body,
}


def tag(g: Graph, names=tuple(INVARIANTS)) -> Graph:
    """Names that are not known are passed over."""
    for name in names:
        if name in INVARIANTS:
            g = g.mark(INVARIANTS[name](g))
    return g
