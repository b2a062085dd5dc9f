"""Louvain and Leiden one node after another, as published: what the rounds of the library are held against."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np


class Net:
    """An undirected graph of nodes 0 to n - 1; an edge from a node to itself counts twice in its strength."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.n = n
        self.near: list[dict[int, float]] = [{} for _ in range(n)]
        self.loop = [0.0] * n
        for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
            if a == b:
                self.loop[a] += w
            else:
                self.near[a][b] = self.near[a].get(b, 0.0) + w
                self.near[b][a] = self.near[b].get(a, 0.0) + w
        self.k = [sum(x.values()) + 2 * loop for x, loop in zip(self.near, self.loop)]
        self.twice = sum(self.k) or 1.0

    def contracted(self, part: list[int]) -> Net:
        """The graph whose nodes are the numbers of ``part``."""
        total: dict[tuple[int, int], float] = defaultdict(float)
        for a, near in enumerate(self.near):
            total[part[a], part[a]] += self.loop[a]
            for b, w in near.items():
                if a < b:
                    total[min(part[a], part[b]), max(part[a], part[b])] += w
        ends = np.array(list(total), np.int64).reshape(-1, 2)
        return Net(max(part) + 1 if part else 0, ends[:, 0], ends[:, 1], np.array(list(total.values())))


def numbered(part: list[int]) -> list[int]:
    """The same partition with numbers from 0, in order of first use."""
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in part]


def settle(net: Net, part: list[int], resolution: float) -> bool:
    """Move single nodes, in place, until no move raises modularity; whether any moved."""
    total: dict[int, float] = defaultdict(float)
    for v, c in enumerate(part):
        total[c] += net.k[v]
    free = max(part, default=-1) + 1
    queue, waits, moved = deque(range(net.n)), [True] * net.n, False
    while queue:
        v = queue.popleft()
        waits[v] = False
        own, pull = part[v], net.k[v] * resolution / net.twice
        total[own] -= net.k[v]
        to: dict[int, float] = defaultdict(float)
        to[own] = 0.0
        for u, w in net.near[v].items():
            to[part[u]] += w
        best, most = own, to[own] - pull * total[own]
        for c in sorted(to):
            if (gain := to[c] - pull * total[c]) > most + 1e-12:
                best, most = c, gain
        if most < -1e-12:  # better alone
            best, free = free, free + 1
        total[best] += net.k[v]
        if best != own:
            part[v], moved = best, True
            for u in net.near[v]:
                if not waits[u] and part[u] != best:
                    waits[u] = True
                    queue.append(u)
    return moved


def refined(net: Net, part: list[int], resolution: float) -> list[int]:
    """Parts of the communities: nodes start alone and join the best well-connected part inside."""
    whole: dict[int, float] = defaultdict(float)
    for v, c in enumerate(part):
        whole[c] += net.k[v]
    inside = [sum(w for u, w in net.near[v].items() if part[u] == part[v]) for v in range(net.n)]
    sub, size, weight, out = list(range(net.n)), [1] * net.n, list(net.k), list(inside)
    scale = resolution / net.twice
    for v in range(net.n):
        c = part[v]
        if size[sub[v]] > 1 or inside[v] < scale * net.k[v] * (whole[c] - net.k[v]) - 1e-12:
            continue
        to: dict[int, float] = defaultdict(float)
        for u, w in net.near[v].items():
            if part[u] == c:
                to[sub[u]] += w
        best, most = sub[v], 1e-12
        for s in sorted(to):
            if s != sub[v] and out[s] >= scale * weight[s] * (whole[c] - weight[s]) - 1e-12 and (gain := to[s] - scale * net.k[v] * weight[s]) > most:
                best, most = s, gain
        if best != sub[v]:
            size[sub[v]] -= 1
            weight[sub[v]] -= net.k[v]
            size[best] += 1
            weight[best] += net.k[v]
            out[best] += inside[v] - 2 * to[best]
            sub[v] = best
    return numbered(sub)


def communities(net: Net, resolution: float = 1.0, refine: bool = False) -> list[int]:
    """The community of each node when neither a move, nor contraction, nor a new try from the nodes helps."""
    part = list(range(net.n))
    while True:
        changed = settle(net, part, resolution)
        level, names = net, list(range(net.n))  # the level's node of each node
        held = numbered(part)
        while True:
            inner = refined(level, held, resolution) if refine else held
            if max(inner, default=-1) + 1 == level.n:
                break
            first = {}
            for v, c in enumerate(inner):
                first.setdefault(c, held[v])
            level, names = level.contracted(inner), [inner[x] for x in names]
            held = [first[c] for c in range(level.n)]
            if not settle(level, held, resolution) and not refine:
                break
            held = numbered(held)
        after = numbered([held[x] for x in names])
        if not changed and after == numbered(part):
            return after
        part = after
