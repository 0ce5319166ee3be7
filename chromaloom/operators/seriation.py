"""Putting items in order by a similarity matrix: small, driver-side NumPy (n is a number of cells)."""

from __future__ import annotations

import numpy as np


def laplacian(s: np.ndarray, normed: bool = False) -> np.ndarray:
    """D - S, or I - D^-1/2 S D^-1/2 (rows without neighbours stay 0)."""
    d = s.sum(1)
    if not normed:
        return np.diag(d) - s
    with np.errstate(divide="ignore"):
        root = np.where(d > 0, 1 / np.sqrt(d), 0)
    return np.diag((d > 0).astype(float)) - root[:, None] * s * root[None, :]


def embedding(s: np.ndarray, k: int = 2, normed: bool = False) -> np.ndarray:
    """The eigenvectors of the Laplacian behind the constant one."""
    _, v = np.linalg.eigh(laplacian(s, normed))
    return v[:, 1 : k + 1]


def parts(s: np.ndarray) -> np.ndarray:
    """Connected part of each item."""
    label = np.full(len(s), -1)
    for start in range(len(s)):
        if label[start] < 0:
            todo, label[start] = [start], start
            while todo:
                new = np.flatnonzero((s[todo.pop()] > 0) & (label < 0))
                label[new] = start
                todo += new.tolist()
    return label


def baseline(s: np.ndarray, circular: bool = False) -> np.ndarray:
    """Linear order by the Fiedler vector, circular by the angle of the first two; parts follow each other by size."""
    label = parts(s)
    names, sizes = np.unique(label, return_counts=True)
    out = []
    for p in names[np.argsort(-sizes, kind="stable")]:
        items = np.flatnonzero(label == p)
        if len(items) < 3:
            out += items.tolist()
            continue
        e = embedding(s[np.ix_(items, items)], 2)
        key = np.arctan2(e[:, 1], e[:, 0]) if circular and e.shape[1] > 1 else e[:, 0]
        out += items[np.argsort(key, kind="stable")].tolist()
    return np.array(out, np.int64)


def local_similarity(e: np.ndarray, k: int) -> np.ndarray:
    """Similarity along lines fitted to the ``k`` nearest items of each in an embedding."""
    n = len(e)
    k = min(k, n)
    s, times = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        near = np.argsort(((e - e[i]) ** 2).sum(1), kind="stable")[:k]
        x = e[near] - e[near].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        d = np.abs(along[:, None] - along[None])
        s[np.ix_(near, near)] += d.max() - d
        times[np.ix_(near, near)] += 1
    out = np.divide(s, times, out=np.zeros_like(s), where=times > 0)
    np.fill_diagonal(out, 0)
    return (out + out.T) / 2


def order(s: np.ndarray, k: int = 10, dim: int = 6, circular: bool = False) -> np.ndarray:
    """Order by the Fiedler vector of the similarity along local lines of the embedding; parts that fall apart are joined at their closest tips."""
    n = len(s)
    if n < 4:
        return baseline(s, circular)
    new = local_similarity(embedding(s, min(dim, n - 1), True), k)
    label = parts(new)
    chains = []
    for p in np.unique(label):
        items = np.flatnonzero(label == p)
        sub = baseline(new[np.ix_(items, items)], circular and len(np.unique(label)) == 1)
        chains.append(items[sub].tolist())
    return np.array(merge_chains(chains, s), np.int64)


def merge_chains(chains: list[list[int]], s: np.ndarray, reach: int = 5) -> list[int]:
    """Chains joined one by one at the tips that are most similar."""
    chains = sorted(chains, key=len, reverse=True)
    whole = chains.pop(0)
    while chains:
        best = None
        for c, chain in enumerate(chains):
            for turned in (chain, chain[::-1]):
                for front in (False, True):
                    tip, other = (whole[:reach], turned[-reach:]) if front else (whole[-reach:], turned[:reach])
                    value = s[np.ix_(tip, other)].mean()
                    if best is None or value > best[0]:
                        best = (value, c, turned, front)
        _, c, turned, front = best
        chains.pop(c)
        whole = turned + whole if front else whole + turned
    return whole


def eta_trick(s: np.ndarray, rounds: int = 20, floor: float = 0.1) -> np.ndarray:
    """Order of small one-sum: similarities are divided by the distances in the last order, then ordered again; the best seen is kept."""
    best = now = baseline(s)
    for _ in range(rounds):
        place = np.empty(len(s))
        place[now] = np.arange(len(s))
        now = baseline(s / np.maximum(np.abs(place[:, None] - place[None]), floor))
        if one_sum(s, now) < one_sum(s, best):
            best = now
    return best


def p_sum(s: np.ndarray, perm: np.ndarray, p: float = 2.0) -> float:
    """Sum of similarities times the p-th power of the distances in the order."""
    place = np.empty(len(perm))
    place[perm] = np.arange(len(perm))
    return float((s * np.abs(place[:, None] - place[None]) ** p).sum())


def one_sum(s: np.ndarray, perm: np.ndarray) -> float:
    return p_sum(s, perm, 1.0)


def kendall(perm: np.ndarray, truth: np.ndarray) -> float:
    """Kendall's tau of two orders of the same items, up to their direction."""
    a, b = np.argsort(perm), np.argsort(truth)
    i, j = np.triu_indices(len(a), 1)
    return abs(float(np.mean(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]))))


def kendall_circular(perm: np.ndarray, truth: np.ndarray) -> float:
    """The greatest tau over all rotations of the order."""
    return max(kendall(np.roll(perm, k), truth) for k in range(len(perm)))


def toeplitz(n: int, seed: int = 0, circular: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A similarity that falls with the distance in a hidden order, and that order."""
    perm = np.random.default_rng(seed).permutation(n)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    d = np.minimum(d, n - d) if circular else d
    s = np.zeros((n, n))
    s[np.ix_(perm, perm)] = np.exp(-d / (n / 10))
    np.fill_diagonal(s, 0)
    return s, perm


def profile_similarity(profiles: np.ndarray, components: int = 5) -> np.ndarray:
    """exp(-distance / components) of standardised profiles in their principal axes."""
    spread = profiles.std(0)
    z = np.divide(profiles - profiles.mean(0), spread, out=np.zeros_like(profiles, dtype=float), where=spread > 0)
    u, sv, _ = np.linalg.svd(z, full_matrices=False)
    x = (u * sv)[:, :components]
    return np.exp(-np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) / components)


def tour(points: np.ndarray, seed: int = 0, rounds: int = 4000) -> np.ndarray:
    """A short round trip: nearest neighbours, then seeded annealing by reversals."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    n = len(d)
    path, left = [0], set(range(1, n))
    while left:
        path.append(min(left, key=lambda j: (d[path[-1], j], j)))
        left.discard(path[-1])
    rng = np.random.default_rng(seed)
    for t in range(rounds if n > 3 else 0):
        i, j = sorted(rng.choice(n, 2, replace=False))
        a, b, c, e = path[i - 1], path[i], path[j], path[(j + 1) % n]
        if i == 0 and j == n - 1:
            continue
        gain = d[a, b] + d[c, e] - d[a, c] - d[b, e]
        if gain > 0 or rng.random() < np.exp(gain / max(1e-9, d.mean() * 0.1 * (1 - t / rounds))):
            path[i : j + 1] = path[i : j + 1][::-1]
    return np.array(path)


def align(a: np.ndarray, b: np.ndarray, points: int = 50) -> tuple[list[tuple[int, int]], float]:
    """Dynamic time warping of two trajectories (rows in order), brought to ``points`` rows each: the path and its cost."""
    fit = lambda m: np.column_stack([np.interp(np.linspace(0, 1, points), np.linspace(0, 1, len(m)), c) for c in m.T])
    x, y = fit(np.asarray(a, float)), fit(np.asarray(b, float))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    total = np.full((points + 1, points + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, points + 1):
        for j in range(1, points + 1):
            total[i, j] = d[i - 1, j - 1] + min(total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
    i = j = points
    path = []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda q: total[q])
    return path[::-1], float(total[points, points])
