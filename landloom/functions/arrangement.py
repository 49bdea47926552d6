"""Faces and edges of overlapping outlines within one tile: the plane cut at every outline, and what lies on both sides of each cut.

The tile is parted into horizontal slabs at every corner and crossing, so within a slab no two lines cross; between neighbouring
lines lie trapezoids, and trapezoids of equal cover that meet are one face. The border of a tile belongs to no line, so faces end
there; what they show on it is told apart, for the tile beside it to be joined to. Points are the same numbers for all
faces that meet in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from landloom.functions import batch as B

HAIR = 1e-7  # lengths below it are rounding
SIDES = ("x0", "x1", "y0", "y1")


class Sets:
    """Disjoint sets of numbered members."""

    def __init__(self, n: int = 0) -> None:
        self.up: list[int] = list(range(n))

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def crossings(s: np.ndarray) -> np.ndarray:
    """y of the points in which segments (x0, y0, x1, y1) cross each other, in blocks of rows."""
    out = [np.zeros(0)]
    x, y, dx, dy = s[:, 0], s[:, 1], s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    for at in range(0, len(s), 256):
        i = slice(at, at + 256)
        turn = dx[i, None] * dy[None] - dy[i, None] * dx[None]
        ex, ey = x[None] - x[i, None], y[None] - y[i, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (ex * dy[None] - ey * dx[None]) / turn, (ex * dy[i, None] - ey * dx[i, None]) / turn
        hit = (np.abs(turn) > 1e-12) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        row, col = np.nonzero(hit)
        later = col > row + at
        row, col = row[later], col[later]
        out.append(y[row + at] + t[row, col] * dy[row + at])
    return np.concatenate(out)


def merged(values: np.ndarray, gap: float = HAIR) -> np.ndarray:
    """Sorted values, of those closer than a gap the first."""
    v = np.sort(values)
    return v[np.r_[True, np.diff(v) > gap]] if len(v) else v


def arrange(shapes: list[tuple[int, list[np.ndarray]]], x0: float, y0: float, x1: float, y1: float):
    """Faces and edges of shapes (key, rings) within a box.

    Returns faces [(cover: tuple of keys, area)], edges [(left face, right face, ax, ay, bx, by)] (left as seen from a to b) and
    border pieces [(side "x0" "x1" "y0" or "y1", from, to, face)].
    """
    keys, rows, owner = [], [], []
    for key, rings in shapes:
        keys.append(key)
        for r in rings:
            n = np.roll(r, -1, axis=0)
            rows.append(np.column_stack([r, n]))
            owner += [len(keys) - 1] * len(r)
    s = np.concatenate(rows) if rows else np.zeros((0, 4))
    owner = np.array(owner, int)
    near = (np.minimum(s[:, 1], s[:, 3]) <= y1) & (np.maximum(s[:, 1], s[:, 3]) >= y0)
    s, owner = s[near], owner[near]
    # One direction for each line, so that equal lines give equal points; lower end first.
    turn = (s[:, 3] < s[:, 1]) | (s[:, 3] == s[:, 1]) & (s[:, 2] < s[:, 0])
    s[turn] = s[turn][:, [2, 3, 0, 1]]
    inside = s[(np.maximum(s[:, 0], s[:, 2]) >= x0) & (np.minimum(s[:, 0], s[:, 2]) <= x1)]
    span = s[:, 3] - s[:, 1]
    up = span > 0
    steep, owner = s[up], owner[up]
    slope = (steep[:, 2] - steep[:, 0]) / (steep[:, 3] - steep[:, 1])
    ys = [np.array([y0, y1]), inside[:, 1], inside[:, 3], crossings(inside)]
    for border in (x0, x1):
        with np.errstate(divide="ignore", invalid="ignore"):
            ys.append((steep[:, 1] + (border - steep[:, 0]) / slope)[(np.minimum(steep[:, 0], steep[:, 2]) < border) & (np.maximum(steep[:, 0], steep[:, 2]) > border)])
    ys = np.concatenate(ys)
    ys = merged(ys[(ys > y0 + HAIR) & (ys < y1 - HAIR)])
    ys = np.r_[y0, ys, y1]

    def at(lines: np.ndarray, y: float) -> np.ndarray:
        """x of lines at a height, exactly an end's where it is one's."""
        q = steep[lines]
        x = q[:, 0] + (y - q[:, 1]) * slope[lines]
        return np.where(np.abs(y - q[:, 1]) <= HAIR, q[:, 0], np.where(np.abs(y - q[:, 3]) <= HAIR, q[:, 2], x))

    sets, covers, areas = Sets(), [], []
    sloped: dict[tuple[int, int, int], list[list[float]]] = {}
    flat, sides = [], []
    below: list[tuple[float, float, int]] = []
    for k in range(len(ys) - 1):
        lo, hi = ys[k], ys[k + 1]
        mid = (lo + hi) / 2
        lines = np.flatnonzero((steep[:, 1] <= mid) & (steep[:, 3] > mid))  # half open: corners beside the tile are no border of a slab
        x = steep[lines, 0] + (mid - steep[lines, 1]) * slope[lines]
        order = np.argsort(x, kind="stable")
        lines, x = lines[order], x[order]
        xa, xb = at(lines, lo).clip(x0, x1), at(lines, hi).clip(x0, x1)
        who, x = owner[lines].tolist(), x.tolist()
        # Boundaries of the slab: the borders, and lines between them across which the cover changes.
        cells, cover, left = [], 0, (x0, x0, -1)
        i, n = 0, len(x)
        while i < n:
            j, new = i, cover
            while j < n and x[j] - x[i] <= HAIR:
                new ^= 1 << who[j]
                j += 1
            if new != cover:
                if x0 < x[i] < x1 and x[i] > (left[0] + left[1]) / 2 + HAIR:
                    here = (float(xa[i]), float(xb[i]), int(lines[i]))
                    cells.append((left, here, cover))
                    left = here
                cover = new if x[i] < x1 else cover
            i = j
        cells.append((left, (x1, x1, -1), cover))
        own = []
        for a, b, c in cells:
            f = sets.add()
            covers.append(c)
            areas.append((hi - lo) * ((b[0] - a[0]) + (b[1] - a[1])) / 2)
            own.append(f)
        for i in range(len(cells) - 1):
            p, q, line = cells[i][1]
            sloped.setdefault((line, own[i], own[i + 1]), []).append([p, lo, q, hi])
        for (a, b, _), f in zip(cells, own, strict=True):
            if a[2] < 0:
                sides.append(("x0", lo, hi, f))
            if b[2] < 0:
                sides.append(("x1", lo, hi, f))
        foot = [(a[0], b[0], f) for (a, b, _), f in zip(cells, own, strict=True)]
        if k == 0:
            sides += [("y0", p, q, f) for p, q, f in foot if q - p > HAIR]
        i = j = 0
        while i < len(below) and j < len(foot):
            p, q = max(below[i][0], foot[j][0]), min(below[i][1], foot[j][1])
            if q - p > HAIR:
                f, g = below[i][2], foot[j][2]
                if covers[f] == covers[g]:
                    sets.join(f, g)
                else:
                    flat.append((g, f, p, lo, q, lo))
            if below[i][1] < foot[j][1]:
                i += 1
            else:
                j += 1
        below = [(a[1], b[1], f) for (a, b, _), f in zip(cells, own, strict=True)]
    sides += [("y1", p, q, f) for p, q, f in below if q - p > HAIR]

    number: dict[int, int] = {}
    faces: list[list] = []
    for f in range(len(covers)):
        r = sets.find(f)
        if r not in number:
            number[r] = len(faces)
            faces.append([tuple(keys[b] for b in range(covers[f].bit_length()) if covers[f] >> b & 1), 0.0])
        faces[number[r]][1] += areas[f]
    of = lambda f: number[sets.find(f)]
    # Pieces of one line with the same faces on both sides are one edge.
    pieces: dict[tuple[int, int, int], list[list[float]]] = {}
    for (line, f, g), found in sloped.items():
        pieces.setdefault((line, of(f), of(g)), []).extend(found)
    edges = []
    for (_, f, g), found in pieces.items():
        found.sort(key=lambda e: e[1])
        run = found[0]
        for e in found[1:]:
            if e[1] == run[3]:
                run = [run[0], run[1], e[2], e[3]]
            else:
                edges.append((f, g, *run))
                run = e
        edges.append((f, g, *run))
    edges += [(of(f), of(g), *e) for f, g, *e in flat]
    border, last = [], {}
    for side, a, b, f in sorted(sides, key=lambda z: (z[0], z[1])):
        f, run = of(f), last.get(side)
        if run and run[2] == f and abs(run[1] - a) <= HAIR:
            run[1] = b
        else:
            last[side] = run = [a, b, f]
            border.append((side, run))
    return [tuple(f) for f in faces], edges, [(side, a, b, f) for side, (a, b, f) in border]


def walked(edges: np.ndarray, plain: np.ndarray) -> list[np.ndarray]:
    """Rings of directed edges (ax, ay, bx, by) with the shape on their left; at a touching point the sharpest turn to the left.

    plain: edges whose first point joins two edges of the layer only, so it goes where it lies on a straight line.
    """
    start: dict[tuple[float, float], list[int]] = {}
    for i, e in enumerate(edges):
        start.setdefault((e[0], e[1]), []).append(i)
    used, rings = np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        ring, i = [], first
        while not used[i]:
            used[i] = True
            ring.append(i)
            e = edges[i]
            nexts = [j for j in start.get((e[2], e[3]), ()) if not used[j] or j == first]
            if not nexts:
                break
            back = np.arctan2(e[1] - e[3], e[0] - e[2])
            i = min(nexts, key=lambda j: (back - np.arctan2(edges[j][3] - edges[j][1], edges[j][2] - edges[j][0])) % (2 * np.pi) or 7.0)
        points = edges[ring][:, :2]
        loose = plain[ring]
        keep = np.ones(len(ring), bool)
        for k in np.flatnonzero(loose).tolist():
            p, q, r = points[k - 1], points[k], points[(k + 1) % len(ring)]
            u, v = q - p, r - q
            keep[k] = abs(u[0] * v[1] - u[1] * v[0]) > 1e-6 * max(1e-9, np.hypot(*u) + np.hypot(*v)) or u @ v < 0
        if keep.sum() >= 3:
            rings.append(points[keep])
    return rings


@dataclass
class Arranged:
    """What arrange() tells, of many tiles: the tile of each face, its cover (lists: where each starts among the keys) and area; tile, faces and
    ends of the edges; tile, side (a place in SIDES), from, to and face of the pieces of the border. Faces are numbered anew in each tile."""

    tile: np.ndarray
    number: np.ndarray
    cover: np.ndarray
    starts: np.ndarray
    area: np.ndarray
    edges: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    border: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def arranged(shapes: B.Shapes, keys: np.ndarray, tile: np.ndarray, boxes: np.ndarray) -> Iterator[Arranged]:
    """arrange() for the shapes of many tiles (tile: of each shape, ascending; boxes: x0, y0, x1, y1 of each tile), in bounded memory: some tiles in one numpy pass, a crowded one by itself."""
    first = np.searchsorted(tile, np.arange(len(boxes) + 1))
    n = np.diff(shapes.rings[shapes.shapes[first]])
    for lo, hi in B.parted(n * n):
        some = np.arange(first[lo], first[hi])
        own = shapes.take(some)
        if hi - lo == 1 and n[lo] * n[lo] > 4 * B.PAIRS:
            faces, edges, border = arrange(list(zip(keys[some].tolist(), B.unpacked(own), strict=True)), *boxes[lo].tolist())
            e, s = np.array(edges, float).reshape(-1, 6), [SIDES.index(b[0]) for b in border]
            at, ends = np.full(len(e), lo), np.array([b[1:3] for b in border], float).reshape(-1, 2)
            cover = np.array([k for c, _ in faces for k in c], np.int64)
            yield Arranged(np.full(len(faces), lo), np.arange(len(faces)), cover, B.offsets(np.array([len(c) for c, _ in faces], np.int64)), np.array([a for _, a in faces]), (at, e[:, 0].astype(np.int64), e[:, 1].astype(np.int64), e[:, 2:]), (np.full(len(border), lo), np.array(s, np.int64), ends, np.array([b[3] for b in border], np.int64)))
        else:
            yield together(own, keys[some], tile[some], boxes, np.arange(lo, hi))


def met(s: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crossings() of segments sorted by tile, and their tile."""
    count = np.searchsorted(tile, tile, "right") - np.arange(len(tile)) - 1
    left, right, low, high = np.minimum(s[:, 0], s[:, 2]) - 1e-6, np.maximum(s[:, 0], s[:, 2]), s[:, 1] - 1e-6, s[:, 3]
    d = s[:, 2:] - s[:, :2]
    ys, whose = [np.zeros(0)], [np.zeros(0, tile.dtype)]
    for lo, hi in B.parted(count):
        i, j = np.repeat(np.arange(lo, hi), count[lo:hi]), B.spans(np.arange(lo, hi) + 1, count[lo:hi])
        for a, b in ((low, high), (left, right)):
            close = np.flatnonzero((a[i] <= b[j]) & (a[j] <= b[i]))
            i, j = i[close], j[close]
        (dx, dy), (fx, fy), (ex, ey) = d[i].T, d[j].T, (s[j, :2] - s[i, :2]).T
        turn = dx * fy - dy * fx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (ex * fy - ey * fx) / turn, (ex * dy - ey * dx) / turn
        hit = (np.abs(turn) > 1e-12) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(s[i[hit], 1] + t[hit] * dy[hit])
        whose.append(tile[i[hit]])
    return np.concatenate(ys), np.concatenate(whose)


def leading(key: np.ndarray) -> np.ndarray:
    """Whether a sorted key differs from the one before."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the set of each of n members, of which some pairs are joined."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def together(shapes: B.Shapes, keys: np.ndarray, tile: np.ndarray, boxes: np.ndarray, tiles: np.ndarray) -> Arranged:
    """The passes of arrange() over all slabs of some tiles at once."""
    points = np.diff(shapes.rings)
    owner = np.repeat(shapes.owner(), points)
    s, t = np.hstack([shapes.xy, shapes.xy[shapes.after()]]), tile[owner]
    near = (np.minimum(s[:, 1], s[:, 3]) <= boxes[t, 3]) & (np.maximum(s[:, 1], s[:, 3]) >= boxes[t, 1])
    s, owner, t = s[near], owner[near], t[near]
    turn = (s[:, 3] < s[:, 1]) | (s[:, 3] == s[:, 1]) & (s[:, 2] < s[:, 0])
    s[turn] = s[turn][:, [2, 3, 0, 1]]
    within = (np.maximum(s[:, 0], s[:, 2]) >= boxes[t, 0]) & (np.minimum(s[:, 0], s[:, 2]) <= boxes[t, 2])
    up = s[:, 3] - s[:, 1] > 0
    steep, own, st = s[up], owner[up], t[up]
    slope = (steep[:, 2] - steep[:, 0]) / (steep[:, 3] - steep[:, 1])
    cy, ct = met(s[within], t[within])
    ys, whose = [s[within, 1], s[within, 3], cy], [t[within], t[within], ct]
    for k in (0, 2):
        border = boxes[st, k]
        over = np.flatnonzero((np.minimum(steep[:, 0], steep[:, 2]) < border) & (np.maximum(steep[:, 0], steep[:, 2]) > border))
        ys.append(steep[over, 1] + (border[over] - steep[over, 0]) / slope[over])
        whose.append(st[over])
    ys, whose = np.concatenate(ys), np.concatenate(whose)
    inner = (ys > boxes[whose, 1] + HAIR) & (ys < boxes[whose, 3] - HAIR)
    ys, whose = ys[inner], whose[inner]
    turn = np.lexsort((ys, whose))
    ys, whose = ys[turn], whose[turn]
    keep = leading(whose)
    keep[1:] |= np.diff(ys) > HAIR
    ys, whose = np.r_[boxes[tiles, 1], ys[keep], boxes[tiles, 3]], np.r_[tiles, whose[keep], tiles]
    turn = np.argsort(whose, kind="stable")  # the foot of each tile, its heights and its head
    ys, whose = ys[turn], whose[turn]
    k = np.flatnonzero(whose[:-1] == whose[1:])
    lo, hi, home = ys[k], ys[k + 1], whose[k]
    mid, n, m = (lo + hi) / 2, len(k), len(steep)
    x0, x1 = boxes[home, 0], boxes[home, 2]

    # The lines of each slab, from left to right.
    kind = np.r_[np.zeros(2 * m, np.int64), np.ones(n, np.int64)]
    turn = np.lexsort((kind, np.r_[steep[:, 1], steep[:, 3], mid], np.r_[st, st, home]))
    place = np.empty(len(kind), np.int64)
    place[turn] = np.cumsum(kind[turn]) - kind[turn]
    count = place[m : 2 * m] - place[:m]
    line, slab = np.repeat(np.arange(m), count), B.spans(place[:m], count)
    x = steep[line, 0] + (mid[slab] - steep[line, 1]) * slope[line]
    turn = np.lexsort((line, x, slab))
    line, slab, x = line[turn], slab[turn], x[turn]
    start = leading(slab)
    start[1:] |= np.diff(x) > HAIR
    while True:  # lines no farther than a hair from the first of theirs are one
        head = np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))
        far = np.flatnonzero(x - x[head] > HAIR)
        if not len(far):
            break
        start[far[leading(head[far])]] = True

    # Covers as bits, a word for 64 shapes of the tile.
    local = np.arange(len(shapes)) - np.searchsorted(tile, tile)
    words = int(local.max(initial=0)) // 64 + 1
    bits = np.zeros((len(x) + 1, words), np.uint64)
    on = np.flatnonzero(x[head] < x1[slab])
    bit = local[own[line[on]]]
    bits[on + 1, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    bits = np.bitwise_xor.accumulate(bits, axis=0)
    begin = np.searchsorted(slab, np.arange(n + 1))
    heads = np.flatnonzero(start)
    ends = np.r_[heads[1:], len(x)][: len(heads)]
    c = heads[(bits[heads] != bits[ends]).any(1) & (x[heads] > x0[slab[heads]]) & (x[heads] < x1[slab[heads]])]

    def at(lines: np.ndarray, y: np.ndarray) -> np.ndarray:
        q = steep[lines]
        x = q[:, 0] + (y - q[:, 1]) * slope[lines]
        return np.where(np.abs(y - q[:, 1]) <= HAIR, q[:, 0], np.where(np.abs(y - q[:, 3]) <= HAIR, q[:, 2], x))

    xa, xb = (at(line[c], y[slab[c]]).clip(x0[slab[c]], x1[slab[c]]) for y in (lo, hi))
    while True:  # of those that can't be told from the one before, the first of each slab goes
        prior = np.where(leading(slab[c]), x0[slab[c]], np.r_[0.0, (xa + xb)[:-1] / 2][: len(c)])
        bad = np.flatnonzero(~(x[c] > prior + HAIR))
        if not len(bad):
            break
        keep = np.ones(len(c), bool)
        keep[bad[leading(slab[c[bad]])]] = False
        c, xa, xb = c[keep], xa[keep], xb[keep]
    cut = slab[c]

    # Cells: what lies between two such lines of a slab, or a line and the border.
    size = np.bincount(cut, minlength=n) + 1
    of, before = np.repeat(np.arange(n), size), np.arange(len(c)) + cut
    last = np.cumsum(size) - 1
    head = np.r_[0, last[:-1] + 1][:n]
    left, right = np.column_stack([x0[of]] * 2), np.column_stack([x1[of]] * 2)
    left[before + 1] = right[before] = np.column_stack([xa, xb])
    cover = np.empty((len(of), words), np.uint64)
    cover[before], cover[last] = bits[c], bits[begin[1:]]
    cover ^= bits[begin[of]]
    area = (hi - lo)[of] * ((right[:, 0] - left[:, 0]) + (right[:, 1] - left[:, 1])) / 2

    # Cells above each other.
    top, foot = np.flatnonzero(np.r_[home[1:] == home[:-1], False][:n][of]), np.flatnonzero(np.r_[False, home[1:] == home[:-1]][:n][of])
    above, below = of[top] + 1, of[foot]
    rims = []
    for rim, where in ((right[top, 1], above), (right[foot, 0], below)):
        same = ~leading(where)[1:]
        while (back := np.flatnonzero(same & (rim[1:] < rim[:-1]))).size:
            rim[back + 1] = rim[back]
        rims.append(rim)
    kind, where = np.r_[np.ones(len(top), np.int64), np.zeros(len(foot), np.int64)], np.r_[above, below]
    turn = np.lexsort((kind, np.concatenate(rims), where))
    kind, where = kind[turn], where[turn]
    i, j = np.cumsum(kind) - kind, np.cumsum(1 - kind) - (1 - kind)
    some = (i < len(top)) & (j < len(foot))
    i, j, where = i[some], j[some], where[some]
    some = (above[i] == where) & (below[j] == where)
    f, g = top[i[some]], foot[j[some]]
    p, q = np.maximum(left[f, 1], left[g, 0]), np.minimum(right[f, 1], right[g, 0])
    some = q - p > HAIR
    f, g, p, q = f[some], g[some], p[some], q[some]
    alike = (cover[f] == cover[g]).all(1)
    roots, face = np.unique(components(len(of), f[alike], g[alike]), return_inverse=True)
    lies = home[of[roots]]
    number = np.arange(len(roots)) - np.searchsorted(lies, lies)

    # Edges: pieces of one line with the same faces on both sides are one.
    a, b = face[before], face[before + 1]
    turn = np.lexsort((lo[cut], b, a, line[c]))
    a, b, ln = a[turn], b[turn], line[c][turn]
    piece = np.column_stack([xa, lo[cut], xb, hi[cut]])[turn]
    new = leading(a) | leading(b) | leading(ln)
    new[1:] |= piece[1:, 1] != piece[:-1, 3]
    begins = np.flatnonzero(new)
    closes = np.r_[begins[1:], len(new)][: len(begins)] - 1
    sloped = np.hstack([piece[begins, :2], piece[closes, 2:]])
    f, g, p, q = f[~alike], g[~alike], p[~alike], q[~alike]
    level = lo[of[g]]
    one, two = np.r_[a[begins], face[g]], np.r_[b[begins], face[f]]
    edges = (lies[one], number[one], number[two], np.vstack([sloped, np.column_stack([p, level, q, level])]))

    # Pieces of the border: those of one face that meet are one.
    low, high = np.flatnonzero(leading(home)[of]), np.flatnonzero(np.r_[leading(home)[1:], True][:n][of])
    low, high = low[right[low, 0] - left[low, 0] > HAIR], high[right[high, 1] - left[high, 1] > HAIR]
    cell = np.r_[head, last, low, high]
    side = np.repeat(np.arange(4), [n, n, len(low), len(high)])
    span = np.vstack([np.column_stack([lo, hi]), np.column_stack([lo, hi]), np.column_stack([left[low, 0], right[low, 0]]), np.column_stack([left[high, 1], right[high, 1]])])
    turn = np.lexsort((span[:, 0], side, home[of[cell]]))
    cell, side, span = cell[turn], side[turn], span[turn]
    own = face[cell]
    new = leading(home[of[cell]]) | leading(side) | leading(own)
    new[1:] |= np.abs(span[:-1, 1] - span[1:, 0]) > HAIR
    begins = np.flatnonzero(new)
    closes = np.r_[begins[1:], len(new)][: len(begins)] - 1
    border = (lies[own[begins]], side[begins], np.column_stack([span[begins, 0], span[closes, 1]]), number[own[begins]])

    whole = np.bincount(face, weights=area, minlength=len(roots))
    who, bit = np.nonzero(np.unpackbits(cover[roots].astype("<u8").view(np.uint8), axis=1, bitorder="little"))
    covering = keys[np.searchsorted(tile, lies)[who] + bit]
    return Arranged(lies, number, covering, B.offsets(np.bincount(who, minlength=len(roots))), whole, edges, border)


def rings_walked(key: np.ndarray, edges: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, B.Shapes]:
    """walked() for the edges of many shapes, sorted by key and coordinates: the keys and their rings. A shape with a touching point is walked by itself."""
    n = len(edges)
    fresh = leading(key)
    shape = np.cumsum(fresh) - 1
    ends = np.vstack([np.column_stack([shape, edges[:, :2]]), np.column_stack([shape, edges[:, 2:]])])
    order = np.lexsort((np.arange(2 * n), *ends.T[::-1]))  # an edge that begins in a point, then one that ends there
    ends = ends[order]
    new = np.ones(2 * n, bool)
    new[1:] = (ends[1:] != ends[:-1]).any(1)
    paired = (new & (order < n))[0::2] & (~new & (order >= n))[1::2]
    simple = np.ones(int(shape[-1]) + 1 if n else 0, bool)
    simple[shape[order[0::2] % n][~paired]] = simple[shape[order[1::2] % n][~paired]] = False
    on = np.flatnonzero(paired & simple[shape[order[0::2] % n]])
    follow = np.arange(n)
    follow[order[2 * on + 1] - n] = order[2 * on]
    mine = np.flatnonzero(simple[shape]) if n else np.arange(0)
    head, far = np.arange(n), follow
    while (head[far] < head).any() or (head[follow] < head).any():
        head, far = np.minimum(head, head[far]), far[far]
    place = np.zeros(n, np.int64)
    first = mine[head[mine] == mine]
    here, step = follow[first], 0
    while len(here := here[here != head[here]]):
        step += 1
        place[here] = step
        here = follow[here]
    turn = mine[np.lexsort((place[mine], head[mine]))]
    size = np.bincount(np.searchsorted(first, head[mine]), minlength=len(first))
    rings = B.Shapes(edges[turn, :2], B.offsets(size), B.offsets(np.bincount(shape[first], minlength=len(simple))))
    after = rings.after()
    before = np.empty(len(turn), np.int64)
    before[after] = np.arange(len(turn))
    u, v = rings.xy - rings.xy[before], rings.xy[after] - rings.xy
    keep = ~plain[turn] | (np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 1e-6 * np.maximum(1e-9, np.hypot(*u.T) + np.hypot(*v.T))) | ((u * v).sum(1) < 0)
    ring = np.repeat(np.arange(len(size)), size)
    done = B.Shapes(rings.xy[keep], B.offsets(np.bincount(ring[keep], minlength=len(size))), rings.shapes)
    done = B.only(done, np.diff(done.rings) >= 3)
    bounds = np.r_[np.flatnonzero(fresh), n]
    at = np.flatnonzero(~simple)
    if len(at):
        done = done.replaced(at, B.packed([walked(edges[bounds[k] : bounds[k + 1]], plain[bounds[k] : bounds[k + 1]]) for k in at]))
    return key[bounds[:-1]], done
