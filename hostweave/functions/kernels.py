"""Vectorised graph measures for a batch of small window graphs.

A batch is one disjoint union of window graphs, so one numpy pass serves all
of its windows. Callers bound the batch; nothing here touches Spark.
"""

import numpy as np


class Batch:
    """Nodes numbered so that each window owns a contiguous range."""

    def __init__(self, node_window: np.ndarray, source: np.ndarray, target: np.ndarray):
        self.window = node_window
        self.n = len(node_window)
        self.windows = int(node_window[-1]) + 1 if self.n else 0
        self.size = np.bincount(node_window, minlength=self.windows)
        self.base = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        order = np.argsort(source, kind="stable")
        self.source, self.target = source[order], target[order]
        self.out = np.bincount(source, minlength=self.n)
        self.start = np.concatenate(([0], np.cumsum(self.out)[:-1])).astype(np.int64)
        self.node_size = self.size[node_window]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the integer ranges start..start+length."""
    total = int(lengths.sum())
    shift = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - shift + np.repeat(starts, lengths)


class Twins:
    """Nodes with the same neighbours on the side they have any, found exactly.

    Lists are compared by length and a sum of mixed numbers first, then with the list
    of the first node of each candidate group, so equal sums alone merge nothing.
    """

    def __init__(self, nodes: np.ndarray, start: np.ndarray, degree: np.ndarray, neighbour: np.ndarray, size: int):
        self.first = np.arange(size)
        self.times = np.ones(size, dtype=np.int64)
        if not len(nodes):
            return
        at = _ranges(start[nodes], degree[nodes])
        heads = np.cumsum(degree[nodes]) - degree[nodes]
        mixed = (neighbour[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        _, group = np.unique(
            np.stack([np.add.reduceat(mixed, heads), degree[nodes].astype(np.uint64)]), axis=1, return_inverse=True)
        lead = np.full(group.max() + 1, len(nodes))
        np.minimum.at(lead, group, np.arange(len(nodes)))
        first = nodes[lead[group]]
        same = np.logical_and.reduceat(neighbour[at] == neighbour[_ranges(start[first], degree[nodes])], heads)
        self.first[nodes[same]] = first[same]
        self.times = np.bincount(self.first, minlength=size)


class Reduced:
    """A batch without what cannot lie on a path between others.

    Pairs of a node with itself are left out. A sink with one predecessor becomes a
    number at it (``leaves``), a source with one successor a number at that
    (``tails``). Sinks with the same predecessors, and sources with the same
    successors, become one with a weight (``times``). Only nodes that something
    reaches get a column in the search. Weights of roots count the nodes in ``mine`` alone.
    """

    def __init__(self, batch: Batch, mine: np.ndarray):
        n = batch.n
        loop = batch.source == batch.target
        source, target = batch.source[~loop], batch.target[~loop]
        out, into = np.bincount(source, minlength=n), np.bincount(target, minlength=n)
        leaf_edge = (out[target] == 0) & (into[target] == 1)
        tail_edge = (into[source] == 0) & (out[source] == 1) & ~leaf_edge
        self.leaf, self.leaf_of = target[leaf_edge], source[leaf_edge]
        self.leaves = np.bincount(self.leaf_of, minlength=n)
        self.tails = np.bincount(target[tail_edge & mine[source]], minlength=n)

        def sides(key, other, degree):
            order = np.argsort(key * np.int64(n) + other, kind="stable")
            return np.cumsum(degree) - degree, other[order]

        self.sinks = Twins(np.flatnonzero((out == 0) & (into > 1)), *_swap(sides(target, source, into), into), n)
        sources = Twins(np.flatnonzero((into == 0) & (out > 1)), *_swap(sides(source, target, out), out), n)
        own = np.arange(n)
        kept = ~leaf_edge & ~tail_edge & (self.sinks.first[target] == target) & (sources.first[source] == source)
        source, target = source[kept], target[kept]
        order = np.argsort(source, kind="stable")
        self.out = np.bincount(source, minlength=n)
        self.start = np.cumsum(self.out) - self.out
        column = (into > 0) & (self.sinks.first == own)
        column[self.leaf] = False
        self.number = np.cumsum(column) - 1
        self.column = column
        self.node = np.flatnonzero(column)
        self.target = self.number[target[order]]
        windows = batch.window[self.node]
        self.width = np.bincount(windows, minlength=batch.windows)
        self.base = np.cumsum(self.width) - self.width
        self.weight = self.sinks.times[self.node]
        self.root_times = np.bincount(sources.first[mine], minlength=n)
        self.root = (sources.first == own) & (
            (self.tails > 0) | (self.root_times > 0) & ((self.out > 0) | (self.leaves > 0)))


def _swap(sides, degree):
    start, neighbour = sides
    return start, degree, neighbour


def path_sums(batch: Batch, sources: np.ndarray, cells: int = 4_000_000):
    """Per node: pair dependencies, number of sources reaching it, sum of their distances.

    Sums over ``sources`` only; a source that stands for its twins and tails counts
    for all of them that are among ``sources``. All sources together, in any split, give
    the whole graph's sums; a part may lack the links of other parts' sources that
    nothing reaches.
    """
    mine = np.zeros(batch.n, dtype=bool)
    mine[sources] = True
    small = Reduced(batch, mine)
    sums = (np.zeros(batch.n), np.zeros(batch.n, dtype=np.int64), np.zeros(batch.n, dtype=np.int64))
    dependency, reached, distance = sums
    roots = np.flatnonzero(small.root)
    edges = np.bincount(batch.window, weights=small.out, minlength=batch.windows).astype(np.int64)
    cost = (small.width + edges + 1)[batch.window[roots]]
    room = np.cumsum(cost)
    cut = 0
    while cut < len(roots):
        used = room[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(room, used + cells, side="right")))
        _path_sums_block(batch, small, roots[cut:end], *sums)
        cut = end
    reached[small.leaf] = reached[small.leaf_of] + mine[small.leaf_of]
    distance[small.leaf] = distance[small.leaf_of] + reached[small.leaf]
    return dependency, reached[small.sinks.first], distance[small.sinks.first]


def _path_sums_block(batch, small, roots, dependency, reached, distance):
    window = batch.window[roots]
    width = small.width[window]
    # Cell of (root r, column v) is shift[r] + v.
    shift = np.cumsum(width) - width - small.base[window]
    total = int(width.sum())
    cell_column = _ranges(small.base[window], width)
    cell_root = np.repeat(np.arange(len(roots)), width)
    depth = np.full(total, -1, dtype=np.int32)
    paths = np.zeros(total)
    inside = small.column[roots]
    here = (shift + small.number[roots])[inside]
    depth[here] = 0
    # the first step goes along distinct pairs: one path each
    fan = small.out[roots]
    front_root = np.repeat(np.arange(len(roots)), fan)
    front_column = small.target[_ranges(small.start[roots], fan)]
    front_cell = shift[front_root] + front_column
    depth[front_cell] = 1
    paths[front_cell] = 1.0
    levels, level = [], 1
    mark = np.zeros(total, dtype=np.int64)
    while len(front_cell):
        node = small.node[front_column]
        fan = small.out[node]
        parent = np.repeat(np.arange(len(front_cell)), fan)
        child_column = small.target[_ranges(small.start[node], fan)]
        child_root = front_root[parent]
        child = shift[child_root] + child_column
        fresh = depth[child] < 0
        parent, child = front_cell[parent[fresh]], child[fresh]
        child_root, child_column = child_root[fresh], child_column[fresh]
        if not len(child):
            break
        level += 1
        depth[child] = level
        np.add.at(paths, child, paths[parent])
        levels.append((parent, child))
        mark[child] = np.arange(len(child))
        single = mark[child] == np.arange(len(child))
        front_root, front_column, front_cell = child_root[single], child_column[single], child[single]
    far = depth > 0
    leaves = small.leaves[small.node[cell_column]]
    weight = small.weight[cell_column]
    credit = np.where(far, leaves, 0).astype(float)
    for parent, child in reversed(levels):
        np.add.at(credit, parent, paths[parent] * (weight[child] + credit[child]) / paths[child])
    credit[here] = 0.0
    times, tails = small.root_times[roots], small.tails[roots]
    both = (times + tails)[cell_root]
    size = len(small.node)
    dependency[small.node] += np.bincount(cell_column, weights=credit * both, minlength=size)
    beyond = np.bincount(cell_root[far], weights=(weight + leaves)[far], minlength=len(roots)) + small.leaves[roots]
    dependency[roots] += tails * beyond
    reached[small.node] += np.bincount(cell_column[far], weights=both[far], minlength=size).astype(np.int64)
    distance[small.node] += np.bincount(
        cell_column[far], weights=(depth * both + tails[cell_root])[far], minlength=size).astype(np.int64)
    reached[roots] += tails
    distance[roots] += tails


def pagerank(batch: Batch, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100):
    """Power iteration per window; a window stops once its L1 change is below n·tolerance."""
    size = batch.node_size.astype(float)
    rank = 1.0 / size
    dangling = batch.out == 0
    out = np.where(dangling, 1, batch.out)
    active = np.ones(batch.windows, dtype=bool)
    if not batch.n:
        return rank
    for _ in range(rounds):
        spread = np.bincount(
            batch.target, weights=(rank / out)[batch.source], minlength=batch.n)
        loose = np.bincount(
            batch.window[dangling], weights=rank[dangling], minlength=batch.windows)
        fresh = damping * (spread + loose[batch.window] / size) + (1 - damping) / size
        change = np.bincount(
            batch.window, weights=np.abs(fresh - rank), minlength=batch.windows)
        rank = np.where(active[batch.window], fresh, rank)
        active &= change >= batch.size * tolerance
        if not active.any():
            return rank
    raise ArithmeticError(f"PageRank has not converged after {rounds} rounds")


def clustering(batch: Batch, chunk: int = 4_000_000):
    """Share of a node's neighbour pairs that are neighbours of each other."""
    low, high = np.minimum(batch.source, batch.target), np.maximum(batch.source, batch.target)
    keep = low != high
    pair = np.unique(low[keep] * np.int64(batch.n) + high[keep])
    low, high = pair // batch.n, pair % batch.n
    degree = np.bincount(low, minlength=batch.n) + np.bincount(high, minlength=batch.n)
    # Pairs point from the lower to the higher degree, which keeps fans short.
    swap = (degree[low] > degree[high]) | ((degree[low] == degree[high]) & (low > high))
    tail, head = np.where(swap, high, low), np.where(swap, low, high)
    order = np.argsort(tail, kind="stable")
    tail, head = tail[order], head[order]
    fan = np.bincount(tail, minlength=batch.n)
    start = np.concatenate(([0], np.cumsum(fan)[:-1])).astype(np.int64)
    triangles = np.zeros(batch.n, dtype=np.int64)
    # For the pair (t, h) look at every other head x of t and ask whether h-x is a pair.
    cost = np.cumsum(fan[tail])
    cut = 0
    while cut < len(tail):
        used = cost[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(cost, used + chunk, side="right")))
        t, h = tail[cut:end], head[cut:end]
        other = head[_ranges(start[t], fan[t])]
        t, h = np.repeat(t, fan[t]), np.repeat(h, fan[t])
        once = h < other
        t, h, other = t[once], h[once], other[once]
        key = h * np.int64(batch.n) + other
        at = np.searchsorted(pair, key)
        hit = (at < len(pair)) & (pair[np.minimum(at, len(pair) - 1)] == key)
        for corner in (t[hit], h[hit], other[hit]):
            triangles += np.bincount(corner, minlength=batch.n)
        cut = end
    possible = degree * (degree - 1)
    return np.where(possible > 0, 2.0 * triangles / np.maximum(possible, 1), 0.0)
