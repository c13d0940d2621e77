"""Pairwise alignment (L1-L8): affine gaps, global, local and with free ends; a Column function over pairs.

No built-in expresses the recurrence, so pairs go to Python in Arrow batches. Many pairs of like lengths fill their tables together, a cell
of all of them per vector operation, the shorter ones filled up behind their ends; of other pairs a row of the table is one, the gap
along the row a running maximum. A score needs two rows of memory; a path needs the table, at most `CELLS`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..dims import matrix
from ..functions import kernels

#: Cells of a table that a path is traced through.
CELLS = 64_000_000
#: Cells of the tables that pairs fill together where paths are traced; pairs that are scored together.
BATCH_CELLS, BATCH_PAIRS = 48_000_000, 16_384
#: Pairs whose cells cost as much as the calls of a group of their own.
GROUP = 1_000
#: What fills up the first and the second sequence of a pair: alike to no letter, nor to each other.
FILL = "\0\1"
#: Rows and bytes of an Arrow batch of pairs.
ROWS, BYTES = 50_000, 12 << 20
LOW = -(1 << 40)


_SPACE = [np.empty(0, np.uint8)]


def _space(size: int) -> np.ndarray:
    """Bytes for a table that lives until the next one: fresh memory for each costs more than filling it."""
    if len(_SPACE[0]) < size:
        _SPACE[0] = np.empty(size, np.uint8)
    return _SPACE[0][:size]


class Aligner:
    """Integer scores; a gap of n letters costs open + (n - 1) * extend, given as numbers that are not positive."""

    def __init__(self, mode: str = "global", match: int = 1, mismatch: int = 0, open_gap: int = -1, extend_gap: int = -1, end_gap: int | None = None, extend_end_gap: int | None = None, substitution_matrix: str | dict | None = None):
        if mode not in ("global", "local"):
            raise NotImplementedError(f"mode {mode!r}")
        end = open_gap if end_gap is None else end_gap
        extend_end = extend_gap if extend_end_gap is None else extend_end_gap
        for v in (match, mismatch, open_gap, extend_gap, end, extend_end):
            if v != int(v):
                raise NotImplementedError("scores must be whole numbers")
        if max(open_gap, extend_gap, end, extend_end) > 0:
            raise NotImplementedError("gap scores must not be positive")
        self.mode, self.match, self.mismatch, self.open, self.extend = mode, int(match), int(mismatch), int(open_gap), int(extend_gap)
        self.free = mode == "global" and end == 0 and extend_end == 0 and (open_gap, extend_gap) != (0, 0)
        if mode == "global" and not self.free and (end, extend_end) != (open_gap, extend_gap):
            raise NotImplementedError("end gaps must cost nothing or as much as inner gaps")
        self.matrix = matrix(substitution_matrix) if isinstance(substitution_matrix, str) else substitution_matrix

    def _pairs(self, a: str, b: str) -> np.ndarray:
        """Substitution scores of every letter of a against b."""
        if not a or not b:
            raise ValueError("sequence has zero length")
        if max(map(ord, a + b)) > 255:
            raise ValueError("letters above U+00FF")
        if self.matrix is None:
            x = np.frombuffer(a.encode("latin-1"), np.uint8)
            y = np.frombuffer(b.encode("latin-1"), np.uint8)
            return None, x, y
        for c in set(a + b):
            if (c, c) not in self.matrix:
                raise ValueError(f"sequence contains letters not in the alphabet: {c!r}")
        table = np.zeros((256, 256), np.int64)
        for (p, q), v in self.matrix.items():
            if v != int(v):
                raise NotImplementedError("scores must be whole numbers")
            table[ord(p), ord(q)] = int(v)
        return table, np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)

    def _rows(self, a: str, b: str):
        """Yields (h, f, e, g, b) per row: best, ending in a gap of b, in a gap of a, in anything but the former, but the latter."""
        table, x, y = self._pairs(a, b)
        m = len(y)
        j = np.arange(m + 1)
        edge = np.where(j > 0, self.open + (j - 1) * self.extend, 0)
        local = self.mode == "local"
        h = np.zeros(m + 1, np.int64) if local or self.free else edge.astype(np.int64)
        f = np.full(m + 1, LOW, np.int64)
        e = np.where(j > 0, h, LOW)
        g = h
        yield h, f, e, g, np.where(j > 0, LOW if self.mode == "global" and not self.free else 0, 0)
        ramp = j * self.extend
        for i in range(1, len(x) + 1):
            s = table[x[i - 1], y] if table is not None else np.where(y == x[i - 1], self.match, self.mismatch)
            f = np.maximum(g + self.open, f + self.extend)
            diagonal = np.full(m + 1, LOW, np.int64)
            diagonal[1:] = h[:-1] + s
            if local:
                diagonal = np.maximum(diagonal, 0)
            best = np.maximum(diagonal, f)
            best[0] = 0 if local or self.free else self.open + (i - 1) * self.extend
            run = np.maximum.accumulate(best - ramp)
            e = np.full(m + 1, LOW, np.int64)
            e[1:] = run[:-1] + ramp[:-1] + self.open
            h = np.maximum(best, e)
            g = np.maximum(diagonal, e)
            if local or self.free:
                g[0] = 0
            yield h, f, e, g, best

    def score(self, a: str, b: str) -> int:
        """L3: the optimal score."""
        best, last = LOW, None
        for h, *_ in self._rows(a, b):
            last = h
            best = max(best, int(h.max() if self.mode == "local" else h[-1]))
        if self.mode == "local":
            return best
        return max(best, int(last.max())) if self.free else int(last[-1])

    def align(self, a: str, b: str) -> dict:
        """One optimum: score, gapped strings, coordinates and counts."""
        if (len(a) + 1) * (len(b) + 1) > CELLS:
            raise MemoryError(f"a path needs at most {CELLS} cells")
        rows = list(self._rows(a, b))
        h, f, e, g, best = (np.stack([r[k] for r in rows]) for k in range(5))
        n, m = len(a), len(b)
        if self.mode == "local":
            i, j = np.unravel_index(int(h.argmax()), h.shape)
            score = int(h[i, j])
        elif self.free:
            bottom, right = int(h[n].argmax()), int(h[:, m].argmax())
            i, j = (n, bottom) if h[n, bottom] >= h[right, m] else (right, m)
            score = int(h[i, j])
        else:
            i, j, score = n, m, int(h[n, m])
        i, j = int(i), int(j)
        p, q = ([], []) if self.mode == "local" else (list(a[:i - 1 : -1] if i else a[::-1])[: n - i] + ["-"] * (m - j), ["-"] * (n - i) + list(b[:j - 1 : -1] if j else b[::-1])[: m - j])
        ends = (i, j)
        state = "h"
        while i or j:
            if self.mode == "global" and (i == 0 or j == 0):
                p += list(a[:i][::-1]) + ["-"] * j
                q += ["-"] * i + list(b[:j][::-1])
                i = j = 0
                break
            if state in "hgb":
                value = {"h": h, "g": g, "b": best}[state][i, j]
                if self.mode == "local" and value == 0:
                    break
                if state != "g" and value == f[i, j]:
                    state = "f"
                elif state != "b" and value == e[i, j]:
                    state = "e"
                else:
                    p.append(a[i - 1])
                    q.append(b[j - 1])
                    i, j, state = i - 1, j - 1, "h"
            elif state == "f":
                p.append(a[i - 1])
                q.append("-")
                state = "g" if f[i, j] == g[i - 1, j] + self.open else "f"
                i -= 1
            else:
                k = next(k for k in range(j - 1, -1, -1) if e[i, j] == best[i, k] + self.open + (j - k - 1) * self.extend)
                p += ["-"] * (j - k)
                q += list(b[k:j][::-1])
                j, state = k, "b"
        first, second = "".join(p[::-1]), "".join(q[::-1])
        start = (i, j) if self.mode == "local" else (0, 0)
        ends = ends if self.mode == "local" else (n, m)
        same = sum(x == y for x, y in zip(first, second))
        gaps = first.count("-") + second.count("-")
        return {"score": score, "gapped_first": first, "gapped_second": second, "start": start, "end": ends, "identities": same, "mismatches": len(first) - same - gaps, "gaps": gaps}

    def _batch(self, first: list[str], second: list[str], trace: bool):
        """Scores of pairs of like lengths, a cell of all tables at a time; with trace also six choices per cell, as bits.

        The recurrence of `_rows`: f == h, e == h, e == g, f == best, f opens here, e opens here. Cells behind the end of a shorter
        pair are filled too; none before its end depends on them, and in a local table they hold no match.
        """
        n, m, k = max(map(len, first)), max(map(len, second)), len(first)
        try:
            x, y = (np.ascontiguousarray(np.frombuffer("".join([r.ljust(w, c) for r in v]).encode("latin-1"), np.uint8).reshape(k, w).T) for v, w, c in ((first, n, FILL[0]), (second, m, FILL[1])))
        except UnicodeEncodeError as e:
            raise ValueError("letters above U+00FF") from e
        table = None if self.matrix is None else self._pairs("".join(set("".join(first))), "".join(set("".join(second))))[0]
        if self.mode == "local" and table is None and not trace and self.open <= self.extend and 0 <= self.match * min(n, m) <= 100 and max(-self.open, -self.extend, abs(self.mismatch), abs(self.match - self.mismatch)) <= 20:
            return self._small(x, y), None
        top = (n + m + 2) * max(1, *map(abs, (self.match, self.mismatch, self.open, self.extend)), 0 if table is None else int(np.abs(table).max()))
        kind, low = (np.int16, -16_000) if top < 8_000 else (np.int32, -(1 << 29)) if top < 1 << 28 else (np.int64, LOW)
        deep = -2 * self.open - max(n, m) * self.extend + max(0, -self.mismatch) * min(n, m)
        if table is None and self.mode == "global" and not self.free and deep <= 90 and -self.extend <= 15 and max(self.match, self.mismatch, 0) * min(n, m) <= 100 and abs(self.match - self.mismatch) <= 100:
            kind, low = np.int8, -110  # no cell is as low as -90
        full = lambda v: np.full(k, v, kind)
        local, loose, opened, extend = self.mode == "local", self.mode == "local" or self.free, kind(self.open), kind(self.extend)
        step, miss = kind(self.match - self.mismatch), kind(self.mismatch)
        h = [full(0 if loose or j == 0 else self.open + (j - 1) * self.extend) for j in range(m + 1)]
        g, f = [v.copy() for v in h], [full(low) for _ in range(m + 1)]
        bits = _space((n + 1) * (m + 1) * k).reshape(n + 1, m + 1, k) if trace else None
        peak, right, score = full(0 if local else low), h[m].copy(), full(low)
        ends = [{} for _ in range(n + 1)]
        for r, (u, v) in enumerate(zip(map(len, first), map(len, second))):
            ends[u].setdefault(v, []).append(r)
        same, bit = np.empty(k, bool), np.empty(k, np.uint8)
        eq = same.view(np.int8)
        fresh, jump, e, best, d, corner, kept = (full(0) for _ in range(7))
        for i in range(1, n + 1):
            corner[:] = h[0]
            best[:] = 0 if loose else self.open + (i - 1) * self.extend
            h[0][:] = best
            e[:] = low
            for j in range(1, m + 1):
                hj, gj, fj = h[j], g[j], f[j]
                np.add(gj, opened, out=fresh)
                fj += extend
                np.maximum(fresh, fj, out=fj)
                if table is None:
                    np.equal(x[i - 1], y[j - 1], out=same)
                    if step == 1:
                        np.add(corner, eq, out=d)
                    else:
                        np.multiply(eq, step, out=d)
                        d += corner
                    if miss:
                        d += miss
                else:
                    np.add(corner, table[x[i - 1], y[j - 1]].astype(kind), out=d)
                if local:
                    np.maximum(d, 0, out=d)
                np.add(best, opened, out=jump)
                e += extend
                np.maximum(jump, e, out=e)
                np.maximum(d, fj, out=best)
                corner, kept = kept, corner
                corner[:] = hj
                np.maximum(best, e, out=hj)
                np.maximum(d, e, out=gj)
                if local:
                    np.maximum(peak, hj, out=peak)
                if trace:
                    cell = bits[i, j]
                    np.equal(fj, hj, out=cell.view(bool))
                    for at, p, q in ((1, e, hj), (2, e, gj), (3, fj, best), (4, fj, fresh), (5, e, jump)):
                        np.equal(p, q, out=same)
                        np.left_shift(same.view(np.uint8), np.uint8(at), out=bit)
                        np.bitwise_or(cell, bit, out=cell)
            np.maximum(right, h[m], out=right)
            for v, rows in ends[i].items():
                score[rows] = h[v][rows]
        if local:
            return peak, bits
        return (np.maximum(right, np.max(h, axis=0)) if self.free else score), bits

    def _small(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Local scores that fit a byte. A gap costs no more to carry on than to open, so both gaps may begin at the best cell itself."""
        k, kind = x.shape[1], np.int8
        opened, extend, step, miss = kind(self.open), kind(self.extend), kind(self.match - self.mismatch), kind(self.mismatch)
        h, f = ([np.full(k, v, kind) for _ in range(len(y) + 1)] for v in (0, -60))
        start = [np.full(k, opened, kind) for _ in h]  # the best cell with a gap opened behind it
        same, d, e, peak, spare, zero = np.empty(k, bool), *(np.zeros(k, kind) for _ in range(5))
        eq = same.view(kind)
        for xi in x:
            corner, e[:] = h[0], -60
            for j, yj in enumerate(y, 1):
                fj, before = f[j], h[j]
                fj += extend
                np.maximum(fj, start[j], out=fj)
                np.equal(xi, yj, out=same)
                np.multiply(eq, step, out=d)
                d += miss
                d += corner
                e += extend
                np.maximum(e, start[j - 1], out=e)
                np.maximum(d, fj, out=spare)
                np.maximum(spare, e, out=spare)
                np.maximum(spare, zero, out=spare)
                np.maximum(peak, spare, out=peak)
                np.add(spare, opened, out=start[j])
                h[j] = spare
                spare = corner if j > 1 else np.empty(k, kind)
                corner = before
        return peak.astype(np.int64)

    def _paths(self, first: list[str], second: list[str]) -> list[tuple]:
        """Of global pairs of like lengths what `align` finds: score, gapped strings, identities, mismatches, gaps."""
        score, bits = self._batch(first, second, True)
        n, m, k = max(map(len, first)), max(map(len, second)), len(first)
        x, y = (np.frombuffer("".join([r.ljust(w, "-") for r in v]).encode("latin-1"), np.uint8).reshape(k, w) for v, w in ((first, n), (second, m)))
        p, q = (np.full((k, n + m), 45, np.uint8) for _ in range(2))
        i, j = (np.fromiter(map(len, v), np.int64, k) for v in (first, second))
        state, row, at = np.zeros(k, np.int8), np.arange(k), n + m
        length = np.zeros(k, np.int64)
        while len(row):
            at -= 1
            c = bits[i[row], j[row], row]
            edge_i, edge_j = i[row] == 0, j[row] == 0
            s = state[row]  # 0: h, 1: g, 2: best, 3: f, 4: e
            s = np.where((s == 0) & (c & 1 > 0) | (s == 2) & (c & 8 > 0), 3, np.where((s == 0) & (c & 2 > 0) | (s == 1) & (c & 4 > 0), 4, s))
            s = np.where(edge_j, 3, np.where(edge_i, 4, s))
            up, left = s != 4, s != 3
            p[row[up], at] = x[row[up], i[row[up]] - 1]
            q[row[left], at] = y[row[left], j[row[left]] - 1]
            state[row] = np.where(s == 3, np.where(c & 16 > 0, 1, 3), np.where(s == 4, np.where(c & 32 > 0, 2, 4), 0))
            i[row] -= up
            j[row] -= left
            length[row] += 1
            row = row[(i[row] > 0) | (j[row] > 0)]
        out = []
        same = ((p == q) & (p != 45) | (p == 45) & (q == 45)).sum(1) - (n + m - length)
        gaps = ((p == 45).sum(1) + (q == 45).sum(1)) - 2 * (n + m - length)
        for r in range(k):
            z = n + m - int(length[r])
            out.append((int(score[r]), p[r, z:].tobytes().decode("latin-1"), q[r, z:].tobytes().decode("latin-1"), int(same[r]), int(length[r] - same[r] - gaps[r]), int(gaps[r])))
        return out

    def _parts(self, a: list, b: list, trace: bool):
        """Rows in groups that fill their tables together: of one size where a shorter pair cannot be filled up, else of like sizes.

        A group ends when its idle cells cost more than a group of its own would for the pairs that follow. Null and empty are left out.
        """
        mixed = not self.free and (self.mode == "global" or self.matrix is not None or self.mismatch <= 0)
        u, v = (np.fromiter([len(x) if x else 0 for x in c], np.int64, len(c)) for c in (a, b))
        rows = np.flatnonzero((u > 0) & (v > 0))
        rows = rows[np.lexsort((-v[rows], -u[rows]))]
        ends = np.append(np.flatnonzero((np.diff(u[rows]) != 0) | (np.diff(v[rows]) != 0)) + 1, len(rows)).tolist() if len(rows) else []
        at = begin = n = m = used = 0
        for end in ends:
            p, q = int(u[rows[at]]), int(v[rows[at]])
            while at < end:
                if at == begin:
                    n, m, used = p, q, 0
                wide, have = max(m, q), at - begin
                most = max(1, min(BATCH_PAIRS, BATCH_CELLS // ((n + 1) * (wide + 1)) if trace else BATCH_PAIRS)) - have
                if (n, wide) != (p, q) or m != q and have:
                    idle, each = n * wide * have - used, n * wide - p * q
                    most = min(most, max(0, GROUP * p * q - idle) // each if each else most if idle <= GROUP * p * q else 0) if mixed else 0
                if most <= 0:
                    yield rows[begin:at].tolist()
                    begin = at
                    continue
                take = min(end - at, most)
                m, used, at = wide, used + take * p * q, at + take
        if at > begin:
            yield rows[begin:at].tolist()

    def _each(self, a: list, b: list, alone, together, trace: bool = False) -> list:
        """Per pair its result, null where either is null or empty; many pairs of like lengths go together."""
        out: list = [None] * len(a)
        for part in self._parts(a, b, trace):
            p, q = [a[r] for r in part], [b[r] for r in part]
            filled = len(set(map(len, p))) > 1 or len(set(map(len, q))) > 1
            if together and len(part) > max(map(len, q)) // 2 and not (filled and any(c in r for v in (p, q) for r in v for c in FILL)):
                found = together(p, q)
            else:
                found = map(alone, p, q)
            for r, v in zip(part, found):
                out[r] = v
        return out

    def score_column(self, a, b):
        """Score of two sequence columns; null where either is null or empty."""
        @F.arrow_udf("bigint")
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array(self._each(x.to_pylist(), y.to_pylist(), self.score, lambda p, q: self._batch(p, q, False)[0].tolist()), pa.int64())

        kernels.batches(None, ROWS, BYTES)
        return run(a, b)

    def align_column(self, a, b):
        kind = "struct<score:bigint,gapped_first:string,gapped_second:string,identities:int,mismatches:int,gaps:int>"
        names = ("score", "gapped_first", "gapped_second", "identities", "mismatches", "gaps")
        types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

        def alone(x, y):
            r = self.align(x, y)
            return tuple(r[k] for k in names)

        @F.arrow_udf(kind)
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            got = self._each(x.to_pylist(), y.to_pylist(), alone, self._paths if self.mode == "global" and not self.free else None, True)
            parts = [pa.array([None if r is None else r[k] for r in got], t) for k, t in enumerate(types)]
            return pa.StructArray.from_arrays(parts, fields=[pa.field(n, t) for n, t in zip(names, types)], mask=pa.array([r is None for r in got]))

        kernels.batches(None, ROWS, BYTES)
        return run(a, b)
