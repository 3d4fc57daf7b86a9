"""Plain-Python models of the graph semantics, used to check the Spark results."""

import math
from collections import deque


def window_graph(events):
    """(roles, edges) of one window; ``events`` are (ts, type, subject, object) in order."""
    roles, edges = {}, {}
    for ts, kind, subject, target in events:
        roles[subject] = "subject"
        if target:
            roles[target] = "object"
            edges[subject, target] = (kind, ts)
    return roles, edges


def distances(adjacency, start):
    depth, paths, order = {start: 0}, {start: 1}, []
    queue = deque([start])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in adjacency[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                queue.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] = paths.get(w, 0) + paths[v]
    return depth, paths


def centralities(nodes, edges):
    out = {v: [t for s, t in edges if s == v] for v in nodes}
    n = len(nodes)
    reach = {v: distances(out, v) for v in nodes}
    close, between = {}, {}
    for v in nodes:
        far = [reach[s][0][v] for s in nodes if s != v and v in reach[s][0]]
        close[v] = len(far) / sum(far) * len(far) / (n - 1) if far else 0.0
        total = 0.0
        for s in nodes:
            for t in nodes:
                ds, ps = reach[s]
                dv, pv = reach[v]
                if len({s, t, v}) == 3 and v in ds and t in dv and ds[v] + dv[t] == ds[t]:
                    total += ps[v] * pv[t] / ps[t]
        between[v] = total / ((n - 1) * (n - 2)) if n > 2 else 0.0
    rank = {v: 1 / n for v in nodes}
    for _ in range(100):
        loose = sum(rank[v] for v in nodes if not out[v])
        fresh = {v: 0.15 / n + 0.85 * loose / n for v in nodes}
        for v in nodes:
            for w in out[v]:
                fresh[w] += 0.85 * rank[v] / len(out[v])
        change = sum(abs(fresh[v] - rank[v]) for v in nodes)
        rank = fresh
        if change < n * 1e-6:
            break
    near = {v: set() for v in nodes}
    for s, t in edges:
        if s != t:
            near[s].add(t)
            near[t].add(s)
    cluster = {}
    for v in nodes:
        k = len(near[v])
        links = sum(1 for a in near[v] for b in near[v] if a < b and b in near[a])
        cluster[v] = 2 * links / (k * (k - 1)) if k > 1 else 0.0
    return {v: (close[v], between[v], rank[v], cluster[v]) for v in nodes}


def temporal(stamps, start_of_day, run=6, within=0.2):
    """(var, gap, span, burst, entropy, sin, cos) of out-edge times in seconds."""
    stamps = sorted(stamps)
    if not stamps:
        return 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0
    n = len(stamps)
    mean = sum(stamps) / n
    var = sum((s - mean) ** 2 for s in stamps) / n if n > 1 else 0.0
    span = stamps[-1] - stamps[0]
    gap = span / (n - 1) if n > 1 else 0.0
    burst = int(any(
        round((stamps[i + run - 1] - stamps[i]) * 1e6) < within * 1e6
        for i in range(n - run + 1)))
    entropy = 0.0
    if span > 0:
        shares = [(b - a) / span for a, b in zip(stamps, stamps[1:])]
        entropy = -sum(p * math.log(p + 1e-9) for p in shares)
    angle = 2 * math.pi * int((stamps[0] - start_of_day) % 86400) / 86400
    return var, gap, span, burst, entropy, math.sin(angle), math.cos(angle)
