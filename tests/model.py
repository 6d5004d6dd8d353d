"""The engine's semantics as plain loops, for small clouds. Points are (x, y, z, intensity), whole numbers."""

import math


def distance(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[:3], q[:3], strict=True))


def new_intensity(own, found, m):
    every = [*found, own]
    cdf, least = sum(v <= own for v in every), every.count(min(every))
    return own if m == least else (cdf - least) * 255 // (m - least)


def exact(points, k):
    out = []
    for i, p in enumerate(points):
        order = sorted((distance(p, q), *q[:3], j) for j, q in enumerate(points) if j != i)[:k]
        out.append(new_intensity(p[3], [points[o[-1]][3] for o in order], k + 1))
    return out


def trunc_div(a, b):
    return abs(a) // b * (1 if a >= 0 else -1)


def voxel(points):
    spans = [max(p[c] for p in points) - min(p[c] for p in points) for c in range(3)]
    volume = math.prod(spans)
    return 1 if volume <= 0 else max(1, int((16 / (27 * (len(points) / volume))) ** (1 / 3)))


def approx(points, k, home=False, size=None):
    size = size or voxel(points)
    cells = [tuple(trunc_div(c, size) for c in p[:3]) for p in points]
    out = []
    for i, p in enumerate(points):
        rings = {}
        for j, c in enumerate(cells):
            ring = max(abs(a - b) for a, b in zip(c, cells[i], strict=True))
            if ring <= 50 and (ring or home):
                rings.setdefault(ring, []).append(j)
        seen, stop = 0, 50
        for ring in sorted(rings):
            seen += len(rings[ring])
            if seen >= k:
                stop = min(2 * max(ring, 1), 50)
                break
        order = sorted((distance(p, points[j]), *points[j][:3], j) for r, js in rings.items() if r <= stop for j in js if j != i)[:k]
        out.append(new_intensity(p[3], [points[o[-1]][3] for o in order], k + 1) if order else p[3])
    return out


def kmeans(points, k, rounds):
    labels, centroids = [0] * len(points), [p[:3] for p in points[:k]]
    for _ in range(rounds):
        labels = [min((distance(p, c), *c, j) for j, c in enumerate(centroids))[-1] for p in points]
        for j in range(k):
            own = [p for p, a in zip(points, labels, strict=True) if a == j]
            if own:
                centroids[j] = tuple(trunc_div(sum(p[c] for p in own), len(own)) for c in range(3))
    out = []
    for p, a in zip(points, labels, strict=True):
        own = [q[3] for q, b in zip(points, labels, strict=True) if b == a]
        least = own.count(min(own))
        out.append(p[3] if len(own) == least else (sum(v <= p[3] for v in own) - least) * 255 // (len(own) - least))
    return labels, out
