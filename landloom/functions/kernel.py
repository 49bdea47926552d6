"""General polygon algebra without a geometry library, by numpy: area of overlays, repair of crossed rings, buffers.

Polygons are lists of rings ((n, 2) arrays, even-odd rule, first point not repeated). Overlays cut the plane
into horizontal slabs at every vertex and crossing; within a slab no edges cross, so the covered parts are
trapezoids between edges and any boolean operation is a choice among them. Null or degenerate input gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np

ARC = 8  # segments of a quarter circle in buffers


def edges_of(rings: Iterable[np.ndarray]) -> np.ndarray:
    """(m, 4) x0, y0, x1, y1 with y0 < y1; horizontal edges bound no trapezoid and are left out."""
    out = []
    for r in rings:
        r = np.asarray(r, float)
        if len(r) >= 3:
            e = np.hstack([r, np.roll(r, -1, axis=0)])
            e = e[e[:, 1] != e[:, 3]]
            up = e[:, 1] > e[:, 3]
            e[up] = e[up][:, [2, 3, 0, 1]]
            out.append(e)
    return np.vstack(out) if out else np.zeros((0, 4))


def crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    if len(e) < 2:
        return np.zeros(0)
    i, j = np.triu_indices(len(e), 1)
    a, b = e[i], e[j]
    near = (np.maximum(a[:, 1], b[:, 1]) < np.minimum(a[:, 3], b[:, 3])) & (np.maximum(np.minimum(a[:, 0], a[:, 2]), np.minimum(b[:, 0], b[:, 2])) <= np.minimum(np.maximum(a[:, 0], a[:, 2]), np.maximum(b[:, 0], b[:, 2])))
    a, b = a[near], b[near]
    sa, sb = (a[:, 2] - a[:, 0]) / (a[:, 3] - a[:, 1]), (b[:, 2] - b[:, 0]) / (b[:, 3] - b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (b[:, 0] - sb * b[:, 1] - a[:, 0] + sa * a[:, 1]) / (sa - sb)
    low, high = np.maximum(a[:, 1], b[:, 1]), np.minimum(a[:, 3], b[:, 3])
    return y[np.isfinite(y) & (y > low) & (y < high)]


def trapezoids(a: Iterable[np.ndarray], b: Iterable[np.ndarray], keep: Callable[[bool, bool], bool]) -> list[tuple[float, ...]]:
    """(y0, y1, left at y0, right at y0, left at y1, right at y1) of the parts that keep(in a, in b) chooses."""
    ea, eb = edges_of(a), edges_of(b)
    e = np.vstack([ea, eb])
    if not len(e):
        return []
    whose = np.r_[np.zeros(len(ea), int), np.ones(len(eb), int)]
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], crossings(e)]))
    out = []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        on = (e[:, 1] <= y0) & (e[:, 3] >= y1)
        if not on.any() or y1 - y0 <= 0:
            continue
        own, side = e[on], whose[on]
        slope = (own[:, 2] - own[:, 0]) / (own[:, 3] - own[:, 1])
        x0, x1 = own[:, 0] + slope * (y0 - own[:, 1]), own[:, 0] + slope * (y1 - own[:, 1])
        order = np.lexsort((x1 - x0, (x0 + x1) / 2))
        inside = [False, False]
        start = None
        for k in order:
            was = keep(*inside)
            inside[side[k]] = not inside[side[k]]
            now = keep(*inside)
            if now and not was:
                start = k
            elif was and not now and start is not None:
                out.append((float(y0), float(y1), float(x0[start]), float(x0[k]), float(x1[start]), float(x1[k])))
                start = None
    return out


def area_of(parts: list[tuple[float, ...]]) -> float:
    return sum((y1 - y0) * ((r0 - l0) + (r1 - l1)) / 2 for y0, y1, l0, r0, l1, r1 in parts)


def rings_of(parts: list[tuple[float, ...]]) -> list[np.ndarray]:
    """Trapezoids as rings, counter-clockwise; neighbours that continue each other are joined upwards."""
    out: list[list] = []
    open_: dict[tuple[float, float, float], list] = {}
    for y0, y1, l0, r0, l1, r1 in sorted(parts):
        ring = open_.pop((y0, round(l0, 9), round(r0, 9)), None)
        if ring is None:
            ring = [[(l0, y0)], [(r0, y0)]]
            out.append(ring)
        ring[0].append((l1, y1))
        ring[1].append((r1, y1))
        open_[(y1, round(l1, 9), round(r1, 9))] = ring
    done = []
    for left, right in out:
        pts = [p for i, p in enumerate([*right, *left[::-1]]) if i == 0 or p != [*right, *left[::-1]][i - 1]]
        if pts[0] == pts[-1]:
            pts.pop()
        if len(pts) >= 3:
            done.append(np.array(pts))
    return done


def intersection(a, b) -> list[np.ndarray]:
    return rings_of(trapezoids(a, b, lambda p, q: p and q))


def union(a, b) -> list[np.ndarray]:
    return rings_of(trapezoids(a, b, lambda p, q: p or q))


def difference(a, b) -> list[np.ndarray]:
    return rings_of(trapezoids(a, b, lambda p, q: p and not q))


def symmetric_difference(a, b) -> list[np.ndarray]:
    return rings_of(trapezoids(a, b, lambda p, q: p != q))


def area(a) -> float:
    return area_of(trapezoids(a, [], lambda p, _: p))


def overlap_area(a, b) -> float:
    return area_of(trapezoids(a, b, lambda p, q: p and q))


def iou(a, b) -> float:
    common = overlap_area(a, b)
    whole = area(a) + area(b) - common
    return min(1.0, max(0.0, common / whole)) if whole > 0 else 0.0


def is_valid(ring: np.ndarray) -> bool:
    """No two edges of a ring cross, and it has area."""
    ring = np.asarray(ring, float)
    if len(ring) < 3:
        return False
    x, y = (ring - ring[0]).T  # near the origin products keep their last digits
    shoelace = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    return bool(shoelace > 0 and math.isclose(shoelace, area([ring]), rel_tol=1e-9, abs_tol=1e-12))


def make_valid(ring: np.ndarray) -> list[np.ndarray]:
    """The even-odd parts of a ring: a bow tie becomes two triangles."""
    return rings_of(trapezoids([ring], [], lambda p, _: p))


def buffer_line(points: np.ndarray, distance: float) -> list[np.ndarray]:
    """A line's surroundings, with round caps and joins: the union of capsules around its segments."""
    out: list[np.ndarray] = []
    points = np.asarray(points, float)
    for p, q in zip(points, points[1:], strict=False):
        t = math.atan2(q[1] - p[1], q[0] - p[0])
        turn = np.linspace(-math.pi / 2, math.pi / 2, 2 * ARC + 1)
        cap = [(q[0] + distance * math.cos(t + u), q[1] + distance * math.sin(t + u)) for u in turn] + [(p[0] + distance * math.cos(t + math.pi + u), p[1] + distance * math.sin(t + math.pi + u)) for u in turn]
        out = union(out, [np.array(cap)]) if out else [np.array(cap)]
    return out


def shrink_convex(ring: np.ndarray, distance: float) -> list[np.ndarray]:
    """A convex, counter-clockwise ring moved inwards; empty where it collapses."""
    out = np.asarray(ring, float)
    for p, q in zip(np.asarray(ring, float), np.roll(np.asarray(ring, float), -1, axis=0), strict=True):
        d = q - p
        n = np.array([-d[1], d[0]]) / (np.hypot(*d) or 1.0)
        s = (out - p - n * distance) @ n
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if s[i] >= 0:
                kept.append(out[i])
            if (s[i] > 0) != (s[j] > 0) and s[i] != s[j]:
                kept.append(out[i] + (out[j] - out[i]) * s[i] / (s[i] - s[j]))
        out = np.array(kept)
        if len(out) < 3:
            return []
    return [out] if abs(area([out])) > 1e-12 else []


def snap(ring: np.ndarray, grid: float) -> np.ndarray:
    """Vertices on a grid, repeated ones dropped; the ring as it was if that makes it invalid."""
    r = np.floor(np.asarray(ring, float) / grid + 0.5) * grid
    r = r[np.any(r != np.roll(r, 1, axis=0), axis=1)] if len(r) else r
    return r if is_valid(r) else np.asarray(ring, float)


ROWS = 256  # of a spline's kernel at a time
DENSE = 3000  # tie points up to which a spline's system is solved whole
HELD = 1 << 30  # bytes of patches and of a kernel that are kept from step to step; the rest of the kernel is made anew
LEAF = 128  # tie points of a patch, and as many around it
NEAR = 1e-12  # of the extent of the targets (or some roundings of them), where the iteration ends


def bent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """r^2 log r between two sets of points."""
    d = np.subtract.outer(a[:, 0], b[:, 0]) ** 2
    d += np.subtract.outer(a[:, 1], b[:, 1]) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        k = 0.5 * d * np.log(d)
    k[d == 0] = 0
    return k


def bent_times(p: np.ndarray, s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The kernel between p and s times w, by blocks that fit a processor's cache."""
    out = np.zeros((len(p), w.shape[1]))
    for i in range(0, len(p), ROWS):
        for j in range(0, len(s), ROWS):
            out[i : i + ROWS] += bent(p[i : i + ROWS], s[j : j + ROWS]) @ w[j : j + ROWS]
    return out


def patches(s: np.ndarray) -> list[np.ndarray]:
    """Points halved along their longer side until a part is small, each part with the points nearest to its box."""
    todo, out = [np.arange(len(s))], []
    while todo:
        at = todo.pop()
        low, high = s[at].min(0), s[at].max(0)
        if len(at) > LEAF:
            at = at[np.argsort(s[at, int(np.argmax(high - low))], kind="stable")]
            todo += [at[: len(at) // 2], at[len(at) // 2 :]]
        else:
            away = np.hypot(*np.maximum(np.maximum(low - s, s - high), 0).T)
            away[at] = np.inf
            out.append(np.r_[at, np.argpartition(away, min(LEAF, len(s) - 1))[: min(LEAF, len(s) - len(at))]])
    return out


def answer(s: np.ndarray, smoothing: float) -> np.ndarray:
    """The matrix that gives the weights of a spline through few points: they sum to zero against 1, x and y."""
    flat = np.hstack([np.ones((len(s), 1)), s - s.mean(0)])
    u, size, _ = np.linalg.svd(flat / np.maximum(np.abs(flat).max(0), 1e-300), full_matrices=True)
    z = u[:, int((size > 1e-9 * size[0]).sum()) :]
    return z @ np.linalg.solve(z.T @ bent(s, s) @ z + smoothing * np.eye(z.shape[1]), z.T)


def spread_spline(s: np.ndarray, t: np.ndarray, smoothing: float, rounds: int = 500) -> np.ndarray:
    """thin_plate's weights without its system: conjugate gradients among weights that sum to zero against 1, x and y, each step led by
    the splines of small patches that overlap and of a few points of every patch. Memory grows with the points beyond the part of the kernel
    that is held (the few points, one in 20 to 40, are a system of their own), time of a step with their square."""
    flat = np.hstack([np.ones((len(s), 1)), (s - s.mean(0)) / np.maximum(np.ptp(s, axis=0), 1e-300)])
    q, r = np.linalg.qr(flat)
    if np.abs(np.diag(r)).min() <= 1e-9 * np.abs(np.diag(r)).max():
        raise np.linalg.LinAlgError("points in one line")
    free = lambda v: v - q @ (q.T @ v)
    own = patches(s)
    few = np.unique(np.concatenate([p[: LEAF // 2 + 1 : LEAF // 4] for p in own]))
    local = [(p, answer(s[p], smoothing)) for p in [*own, few]]

    def led(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for p, m in local:
            out[p] += m @ v[p]
        return free(out)

    held: dict[tuple[int, int], np.ndarray] = {}
    room = HELD - sum(m.nbytes for _, m in local)

    def times(w: np.ndarray) -> np.ndarray:
        out = smoothing * w
        for i in range(0, len(s), ROWS):
            for j in range(i, len(s), ROWS):
                k = held.get((i, j))
                if k is None:
                    k = bent(s[i : i + ROWS], s[j : j + ROWS])
                    if 8 * ROWS * ROWS * (len(held) + 1) <= room:
                        held[i, j] = k
                out[i : i + ROWS] += k @ w[j : j + ROWS]
                if i < j:
                    out[j : j + ROWS] += k.T @ w[i : i + ROWS]
        return out

    enough = np.maximum(NEAR * np.ptp(t, axis=0), 64 * np.finfo(float).eps * np.abs(t).max(0))
    w, rest = np.zeros_like(t), free(t)
    step = z = led(rest)
    size = (rest * z).sum(0)
    for _ in range(rounds):
        moved = free(times(step))
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.nan_to_num(size / (step * moved).sum(0))
        w, rest = w + far * step, rest - far * moved
        if (np.abs(rest).max(0) <= enough).all():
            break
        z = led(rest)
        now = (rest * z).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = z + np.nan_to_num(now / size) * step
        size = now
    else:
        raise ArithmeticError(f"a spline of {len(s)} points did not settle in {rounds} rounds")
    plain = np.hstack([np.ones((len(s), 1)), s])
    return np.vstack([w, np.linalg.lstsq(plain, t - times(w), rcond=None)[0]])


def thin_plate(source: np.ndarray, target: np.ndarray, smoothing: float = 0.01) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Weights and warp of a thin-plate spline (r^2 log r and an affine part) through at least four tie points; of many points the system is never held."""
    s, t = np.asarray(source, float), np.asarray(target, float)
    n = len(s)
    if n < 4:
        raise ValueError("a spline needs four tie points")
    flat = np.hstack([np.ones((n, 1)), s])
    if n <= DENSE:
        system = np.zeros((n + 3, n + 3))
        for at in range(0, n, ROWS):  # beside the system only some rows of distances are held
            system[at : min(at + ROWS, n), :n] = bent(s[at : at + ROWS], s)
        system[np.arange(n), np.arange(n)] += smoothing
        system[:n, n:], system[n:, :n] = flat, flat.T
        w = np.linalg.solve(system, np.vstack([t, np.zeros((3, 2))]))
    else:
        w = spread_spline(s, t, smoothing)

    def warp(p: np.ndarray) -> np.ndarray:
        p = np.asarray(p, float)
        return bent_times(p, s, w[:n]) + np.hstack([np.ones((len(p), 1)), p]) @ w[n:]

    return w, warp
