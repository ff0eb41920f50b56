"""Array kernels on one graph in memory, for searches whose steps depend on each other.

They run inside Arrow tasks on a broadcast graph; ``collect`` checks its size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .rng import coin_of

#: Oriented edges that a broadcast graph may have (about 24 bytes each).
MAX_ARCS = 20_000_000


@dataclass
class Csr:
    """Rows of a symmetric matrix: neighbours of place i are dst[start[i]:start[i + 1]]."""

    ids: np.ndarray
    start: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    degree: np.ndarray = field(init=False)
    strength: np.ndarray = field(init=False)

    def __post_init__(self):
        self.degree = np.diff(self.start)
        self.src = np.repeat(np.arange(self.n), self.degree)
        self.strength = np.bincount(self.src, weights=self.w, minlength=self.n)

    @property
    def n(self) -> int:
        return len(self.ids)

    @property
    def two_w(self) -> float:
        return float(self.w.sum())

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def row(self, i: int) -> slice:
        return slice(self.start[i], self.start[i + 1])


def csr_of(ids, src, dst, w) -> Csr:
    """From ids and one row per edge."""
    ids = np.sort(np.asarray(ids, dtype=np.int64))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    s, d, x = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)).astype(float)
    order = np.lexsort((d, s))
    return Csr(ids, np.concatenate(([0], np.cumsum(np.bincount(s, minlength=len(ids))))), d[order], x[order])


def collect(graph, most: int = MAX_ARCS) -> Csr:
    """The graph as arrays on the driver; raises if it is too large for a broadcast."""
    if 2 * graph.edges.count() > most:
        raise ValueError(f"the graph has more than {most} arcs; use the DataFrame operators")
    nodes = graph.nodes.select("id").toArrow()
    edges = graph.edges.select("src", "dst", "w").toArrow()
    return csr_of(nodes.column("id").to_numpy(), *(edges.column(c).to_numpy() for c in ("src", "dst", "w")))


def power_iteration(src: np.ndarray, dst: np.ndarray, n: int, max_iter: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Unshifted, unweighted, from equal values, scaled to the greatest; sum 1. Without edges 1 / sqrt(n)."""
    x = np.full(n, 1 / np.sqrt(max(n, 1)))
    if not len(src):
        return x
    for _ in range(max_iter):
        y = np.bincount(src, weights=x[dst], minlength=n)
        y /= max(y.max(), 1e-300)
        moved = np.abs(y - x).sum()
        x = y
        if moved < tol:
            break
    return x / x.sum()


def central(g: Csr, name: str, inside: np.ndarray | None = None) -> np.ndarray:
    """Scores of all places; ``inside`` restricts to the induced subgraph (others get 0)."""
    keep = np.ones(len(g.src), dtype=bool) if inside is None else inside[g.src] & inside[g.dst]
    if name == "eigen":
        members = np.arange(g.n) if inside is None else np.flatnonzero(inside)
        at = np.full(g.n, -1)
        at[members] = np.arange(len(members))
        out = np.zeros(g.n)
        out[members] = power_iteration(at[g.src[keep]], at[g.dst[keep]], len(members))
        return out
    if name == "degree":
        return np.bincount(g.src[keep], minlength=g.n).astype(float)
    sub = g if inside is None else Csr(g.ids, np.concatenate(([0], np.cumsum(np.bincount(g.src[keep], minlength=g.n)))), g.dst[keep], g.w[keep])
    if name == "betweenness":
        return dependencies(sub, np.arange(g.n)) / 2
    if name == "closeness":
        near, far, reached = distances(sub, np.arange(g.n))
        n = g.n if inside is None else int(inside.sum())
        return (n - 1) / np.maximum(far, 1e-300) if (reached == n).all() else near / max(1, n - 1)
    raise ValueError(f"unknown centrality {name!r}")


def dependencies(g: Csr, sources: np.ndarray) -> np.ndarray:
    """Summed pair dependencies on every node, by levels of a breadth-first search from each source."""
    total = np.zeros(g.n)
    for s in sources.tolist():
        depth, paths = np.full(g.n, -1), np.zeros(g.n)
        depth[s], paths[s] = 0, 1
        level, arcs = np.array([s]), []
        while len(level):
            out = np.concatenate([np.arange(g.start[i], g.start[i + 1]) for i in level.tolist()]) if len(level) else np.zeros(0, dtype=int)
            fresh = depth[g.dst[out]] == -1
            depth[g.dst[out][fresh]] = depth[level[0]] + 1
            down = out[depth[g.dst[out]] == depth[level[0]] + 1]
            np.add.at(paths, g.dst[down], paths[g.src[down]])
            arcs.append(down)
            level = np.unique(g.dst[out][fresh])
        gain = np.zeros(g.n)
        for down in reversed(arcs):
            np.add.at(gain, g.src[down], paths[g.src[down]] / paths[g.dst[down]] * (1 + gain[g.dst[down]]))
        gain[s] = 0
        total += gain
    return total


def distances(g: Csr, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per source: sum of inverse distances, sum of distances, nodes reached (itself included)."""
    near, far, reached = np.zeros(len(sources)), np.zeros(len(sources)), np.ones(len(sources), dtype=np.int64)
    for k, s in enumerate(sources.tolist()):
        seen = np.zeros(g.n, dtype=bool)
        seen[s] = True
        level, d = np.array([s]), 0
        while len(level):
            d += 1
            hit = np.unique(np.concatenate([g.dst[g.row(i)] for i in level.tolist()]))
            level = hit[~seen[hit]]
            seen[level] = True
            near[k] += len(level) / d
            far[k] += len(level) * d
            reached[k] += len(level)
    return near, far, reached


def similarities(g: Csr, leader: int, pool: np.ndarray, kind: str) -> np.ndarray:
    """Similarity of the pool's nodes to the leader on the whole graph, by a walk of two steps."""
    shared = np.zeros(g.n)
    for i in g.dst[g.row(leader)].tolist():
        shared[g.dst[g.row(i)]] += 1
    c, a, b = shared[pool], g.degree[leader], g.degree[pool]
    below = {"hpi": np.minimum(a, b), "dice": a + b, "jaccard": a + b - c}[kind]
    out = np.where(below > 0, (2 if kind == "dice" else 1) * c / np.maximum(below, 1), 0.0)
    out[pool == leader] = 1.0
    return out


def construct(g: Csr, alpha_c: float, alpha_s: float, seed: int, it: int, kind: str = "hpi", centrality: str = "eigen", score: np.ndarray | None = None, each_round: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(community of each place, leaders): a leader is drawn among the most central nodes left and takes those similar enough to it.

    With ``each_round`` the centrality is that of the subgraph of the nodes left.
    """
    left = np.ones(g.n, dtype=bool)
    community, leaders = np.full(g.n, -1), []
    if score is None and not each_round:
        score = central(g, centrality)
    while left.any():
        pool = np.flatnonzero(left)
        s = (central(g, centrality, left) if each_round else score)[pool]
        fine = np.isfinite(s)
        s = np.where(fine, s, s[fine].min() if fine.any() else 0.0)
        near_top = pool[s >= s.max() - alpha_c * (s.max() - s.min())]
        leader = int(near_top[coin_of(seed, it, len(leaders)) * len(near_top) >> 32])
        sim = similarities(g, leader, pool, kind)
        others = sim[pool != leader]
        taken = pool
        if len(others):
            floor = others.min() + alpha_s * (others.max() - others.min())
            taken = pool[(sim >= floor) | (pool == leader)]
        community[taken] = len(leaders)
        leaders.append(leader)
        left[taken] = False
    return community, np.array(leaders)


def repair(g: Csr, community: np.ndarray, centrality: str = "eigen") -> np.ndarray:
    """Leader of each community: most central in its own subgraph, first of equals."""
    out = []
    order = np.argsort(community, kind="stable")
    bounds = np.searchsorted(community[order], np.arange(community.max() + 2))
    same = community[g.src] == community[g.dst]
    src, dst = g.src[same], g.dst[same]
    by = np.argsort(community[src], kind="stable")
    src, dst = src[by], dst[by]
    cuts = np.searchsorted(community[src], np.arange(community.max() + 2))
    for c in range(len(bounds) - 1):
        members = order[bounds[c] : bounds[c + 1]]
        if not len(members):
            continue
        if len(members) == 1:
            out.append(int(members[0]))
            continue
        if centrality in ("eigen", "degree"):
            a, b = np.searchsorted(members, src[cuts[c] : cuts[c + 1]]), np.searchsorted(members, dst[cuts[c] : cuts[c + 1]])
            s = power_iteration(a, b, len(members)) if centrality == "eigen" else np.bincount(a, minlength=len(members))
        else:
            inside = np.zeros(g.n, dtype=bool)
            inside[members] = True
            s = central(g, centrality, inside)[members]
        out.append(int(members[int(np.argmax(s))]))
    return np.array(out)


def modularity(g: Csr, community: np.ndarray) -> float:
    if g.two_w <= 0:
        return 0.0
    intra = g.w[community[g.src] == community[g.dst]].sum()
    vol = np.bincount(community, weights=g.strength)
    return float(intra / g.two_w - (vol**2).sum() / g.two_w**2)


def affinities(g: Csr, community: np.ndarray, d: int) -> np.ndarray:
    """Dense (n, d): weight into each community less its expectation."""
    into = np.bincount(g.src * d + community[g.dst], weights=g.w, minlength=g.n * d).reshape(g.n, d)
    vol = np.bincount(community, weights=g.strength, minlength=d)
    return into - np.outer(g.strength, vol) / g.two_w


def gains(g: Csr, s: np.ndarray, community: np.ndarray) -> np.ndarray:
    """Dense (n, d) changes of modularity; 0 for the own community."""
    at = np.arange(g.n)
    out = (s - (s[at, community] + g.strength**2 / g.two_w)[:, None]) / (g.two_w / 2)
    out[at, community] = 0.0
    return out


def first_improvement(g: Csr, community: np.ndarray, tol: float = 1e-12, max_iter: int = 1_000_000) -> np.ndarray:
    """The first node in order that gains goes to its best community; then the scan starts anew."""
    community = community.copy()
    if g.two_w <= 0:
        return community
    d = int(community.max()) + 1
    s = affinities(g, community, d)
    for _ in range(max_iter):
        gain = gains(g, s, community)
        able = np.flatnonzero(gain.max(axis=1) > tol)
        if not len(able):
            break
        v = int(able[0])
        move(g, s, community, v, int(np.argmax(gain[v])))
    return community


def move(g: Csr, s: np.ndarray, community: np.ndarray, v: int, target: int) -> None:
    """Moves a node and updates the affinities in place."""
    old = community[v]
    near = g.row(v)
    s[g.dst[near], old] -= g.w[near]
    s[g.dst[near], target] += g.w[near]
    shift = g.strength * g.strength[v] / g.two_w
    s[:, old] += shift
    s[:, target] -= shift
    community[v] = target


def batch_search(g: Csr, community: np.ndarray, sample: np.ndarray, eps: float = 1e-4, max_passes: int = 200, guard: bool = False) -> np.ndarray:
    """Each pass scores the sampled nodes and moves all that gain at once; ``guard`` returns the best pass.

    Moves made together may undo each other, so a pass can lower the modularity.
    """
    community = community.copy()
    if g.two_w <= 0:
        return community
    d = int(community.max()) + 1
    best, top = community.copy(), modularity(g, community)
    for _ in range(max_passes):
        gain = gains(g, affinities(g, community, d), community)[sample]
        go = gain.max(axis=1) > eps
        if not go.any():
            break
        community[sample[go]] = np.argmax(gain[go], axis=1)
        if guard and (q := modularity(g, community)) > top:
            best, top = community.copy(), q
    return best if guard else community


def dense(community: np.ndarray) -> np.ndarray:
    return np.unique(community, return_inverse=True)[1]


def local_search(g: Csr, community: np.ndarray, seed: int, it: int, threshold: int = 300, sample: int = 300, eps: float = 1e-4, guard: bool = False) -> np.ndarray:
    """First improvement up to ``threshold`` nodes, batches on a sample drawn once beyond."""
    if g.n <= threshold:
        return dense(first_improvement(g, community))
    order = sorted(range(g.n), key=lambda i: (coin_of(seed, it, "v", int(g.ids[i])), i))
    return dense(batch_search(g, community, np.sort(np.array(order[:sample])), eps, guard=guard))


def node_entropy(k: np.ndarray, n: int) -> np.ndarray:
    p = k / n
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    return np.where(inside, -(q * np.log2(q) + (1 - q) * np.log2(1 - q)), (1 + np.log2(n)) / n)


def louvain(g: Csr, tol: float = 1e-9) -> np.ndarray:
    """Weighted multilevel clustering: nodes move to the best neighbouring community in id order until none gains, then communities become nodes.

    Each move gains more than ``tol`` of an edge's weight and each level has fewer nodes, so it ends.
    """
    place = np.arange(g.n)
    src, dst, w = g.src, g.dst, g.w
    if g.two_w <= 0:
        return place
    n, two_w = g.n, g.two_w
    while True:
        order = np.argsort(src, kind="stable")
        s, d, x = src[order], dst[order], w[order]
        start = np.searchsorted(s, np.arange(n + 1))
        k = np.bincount(s, weights=x, minlength=n)
        com, vol = np.arange(n), k.copy()
        moved_any = True
        while moved_any:
            moved_any = False
            for v in range(n):
                near, wt = d[start[v] : start[v + 1]], x[start[v] : start[v + 1]]
                other = near != v
                c, at = np.unique(com[near[other]], return_inverse=True)
                if not len(c):
                    continue
                into = np.bincount(at, weights=wt[other])
                old = com[v]
                vol[old] -= k[v]
                value = into - vol[c] * k[v] / two_w
                home = c == old
                stay = (into[home][0] if home.any() else 0.0) - vol[old] * k[v] / two_w
                b = int(np.argmax(value))
                target = int(c[b]) if value[b] > stay + tol else old
                vol[target] += k[v]
                if target != old:
                    com[v], moved_any = target, True
        com = dense(com)
        if com.max() + 1 == n:
            break
        place = com[place]
        key = com[src] * (com.max() + 1) + com[dst]
        ids, at = np.unique(key, return_inverse=True)
        n = int(com.max()) + 1
        src, dst, w = ids // n, ids % n, np.bincount(at, weights=w)
    # ids in the order of first appearance
    _, first, inverse = np.unique(place, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]
