"""Special functions and statistics in NumPy, for distributions that Spark lacks."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def beta_inc_many(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``beta_inc`` of arrays; NaN where an argument is."""
    a, b, x = (np.asarray(v, float).copy() for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a[swap], b[swap], x[swap] = b[swap], a[swap], 1 - x[swap]
    out = np.where(np.isnan(a + b + x), np.nan, np.where(x <= 0, 0.0, 1.0))
    at = np.flatnonzero((x > 0) & (x < 1))
    a1, b1, x1, tiny = a[at], b[at], x[at], 1e-300
    # log gammas by value: degrees of freedom repeat
    log_gamma = lambda v: (lambda u, i: np.array([math.lgamma(t) for t in u])[i])(*np.unique(v, return_inverse=True))
    held = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    front = np.exp(log_gamma(a1 + b1) - log_gamma(a1) - log_gamma(b1) + a1 * np.log(x1) + b1 * np.log1p(-x1)) / a1
    c, d = np.ones(len(at)), 1 / held(1.0 - (a1 + b1) * x1 / (a1 + 1))
    f = d.copy()
    for m in range(1, 500):
        for top in (m * (b1 - m) * x1 / ((a1 + 2 * m - 1) * (a1 + 2 * m)), -(a1 + m) * (a1 + b1 + m) * x1 / ((a1 + 2 * m) * (a1 + 2 * m + 1))):
            d = 1 / held(1 + top * d)
            c = held(1 + top / c)
            f *= c * d
        if not len(at) or np.abs(c * d - 1).max() < 1e-15:
            break
    out[at] = front * f
    return np.where(swap, 1 - out, out)


def t_two_sided_many(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``t_two_sided`` of arrays."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    bad = np.isnan(t) | np.isnan(df) | (df <= 0)
    far = np.isinf(t) & ~bad
    n, v = np.where(bad, 1.0, df), np.where(bad | far, 0.0, t)
    return np.where(bad, np.nan, np.where(far, 0.0, beta_inc_many(n / 2, 0.5, n / (n + v * v))))


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + top / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_inc_upper(df / 2, x / 2)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: the sum of all tables at most as likely."""
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    log = lambda k: -sum(math.lgamma(v + 1) for v in (k, row - k, col - k, n - row - col + k))
    logs = np.array([log(k) for k in range(low, high + 1)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


def kabsch(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotation that moves centered ``p`` onto centered ``q`` best, without reflection, and the RMSD."""
    p, q = p - p.mean(0), q - q.mean(0)
    return kabsch_from(p.T @ q, float((p * p).sum() + (q * q).sum()), len(p))


def kabsch_from(cross: np.ndarray, squares: float, n: int) -> tuple[np.ndarray, float]:
    """The same from the 3x3 cross products and the sum of all squares."""
    u, s, vt = np.linalg.svd(cross)
    sign = np.sign(np.linalg.det(u @ vt))
    fix = np.diag([1.0, 1.0, sign])
    return u @ fix @ vt, math.sqrt(max(0.0, (squares - 2 * (s * np.diag(fix)).sum()) / n))


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull of points in space, built face by face; 0 for flat sets."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 4:
        return 0.0
    scale = float(np.abs(pts - pts.mean(0)).max()) or 1.0
    eps = 1e-10 * scale
    first = pts[pts[:, 0].argmin()]
    second = pts[((pts - first) ** 2).sum(1).argmax()]
    line = second - first
    away = np.linalg.norm(np.cross(pts - first, line), axis=1)
    third = pts[away.argmax()]
    normal = np.cross(line, third - first)
    height = (pts - first) @ normal
    fourth = pts[np.abs(height).argmax()]
    if away.max() <= eps * scale or np.abs(height).max() <= eps * max(1e-300, np.linalg.norm(normal)):
        return 0.0
    inner = (first + second + third + fourth) / 4
    faces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    planes: list[tuple[np.ndarray, float]] = []
    outside: list[np.ndarray] = []

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray, candidates: np.ndarray) -> None:
        n = np.cross(b - a, c - a)
        length = np.linalg.norm(n)
        if length == 0:
            return
        n = n / length
        if n @ (inner - a) > 0:
            b, c, n = c, b, -n
        faces.append((a, b, c))
        planes.append((n, float(n @ a)))
        outside.append(candidates[candidates @ n - n @ a > eps] if len(candidates) else candidates)

    for tri in ((first, second, third), (first, second, fourth), (first, third, fourth), (second, third, fourth)):
        add(*tri, pts)
    while True:
        at = next((i for i, o in enumerate(outside) if len(o)), None)
        if at is None:
            break
        n, d = planes[at]
        apex = outside[at][(outside[at] @ n - d).argmax()]
        seen = [i for i, (n, d) in enumerate(planes) if apex @ n - d > eps]
        edges: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for i in seen:
            a, b, c = faces[i]
            for u, v in ((a, b), (b, c), (c, a)):
                key = (v.tobytes(), u.tobytes())
                if edges.pop(key, None) is None:
                    edges[(u.tobytes(), v.tobytes())] = (u, v)
        candidates = np.unique(np.concatenate([outside[i] for i in seen]), axis=0)
        gone = set(seen)
        faces[:] = [f for i, f in enumerate(faces) if i not in gone]
        planes[:] = [p for i, p in enumerate(planes) if i not in gone]
        outside[:] = [o for i, o in enumerate(outside) if i not in gone]
        for u, v in edges.values():
            add(u, v, apex, candidates)
    return float(sum(abs(np.dot(a - inner, np.cross(b - inner, c - inner))) for a, b, c in faces) / 6)


def library_size(read_pairs: int, unique_pairs: int) -> int | None:
    """Molecules in a library of which ``unique_pairs`` of ``read_pairs`` reads differ; None where that cannot be.

    Solves 1 / x = 1 - exp(-r / x) for x, the size in units of the unique pairs
    (r reads for each of them), by halving the stretch that holds it 40 times.
    """
    if not 0 < unique_pairs < read_pairs:
        return None
    r = read_pairs / unique_pairs
    excess = lambda x: 1 / x + math.expm1(-r / x)  # noqa: E731  positive below the solution
    top = next(x for x in (10.0**i for i in range(2, 300)) if excess(x) <= 0)
    low, width = 1.0, top - 1.0
    for _ in range(40):
        width /= 2
        if excess(low + width) > 0:
            low += width
    return int(unique_pairs * (low + width / 2))
