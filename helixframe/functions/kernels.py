"""Vector kernels behind Column functions whose rule walks over every letter: letters of a batch of sequences are one numpy array.

A step of an expression per letter costs the JVM a few hundred nanoseconds, a vector operation a few. Additions keep the order
of the expressions that they stand for, so doubles are the same to the last bit. Batches are bounded by bytes, see `batches`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of sequences.
ROWS, BYTES = 2_000, 1 << 20


def batches(spark: SparkSession | None = None, rows: int = ROWS, size: int = BYTES) -> None:
    """Bounds the Arrow batches that reach Python by rows and bytes, so that a worker's memory does not follow long sequences."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def letters(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all sequences, those above U+00FE as 255, and the places where each begins, the end last; null is empty."""
    n = len(seqs)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if seqs.null_count:
        seqs = seqs.fill_null("")
    at = np.frombuffer(seqs.buffers()[1], np.int64 if pa.types.is_large_string(seqs.type) else np.int32)[seqs.offset : seqs.offset + n + 1].astype(np.int64)
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if not len(data) or data.max() < 128:
        return data, at - at[0]
    rows = seqs.to_pylist()
    data = np.minimum(np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def table(values: dict[str, float], other: float) -> np.ndarray:
    out = np.full(256, other)
    for a, v in values.items():
        out[ord(a)] = v
    return out


def _row_of(seqs: pa.Array, at: np.ndarray, place: int) -> tuple[str, int]:
    """The sequence that has a place, and the place inside it."""
    r = int(np.searchsorted(at, place, "right")) - 1
    return seqs[r].as_py(), place - int(at[r])


def _lists(full: np.ndarray, at: np.ndarray, less: int) -> pa.Array:
    """Lists of full's values at the places of each row but its last `less`."""
    count = np.maximum(np.diff(at) - less, 0)
    if len(full):
        keep = np.zeros(int(at[-1]) + 1, np.int32)
        some = count > 0
        np.add.at(keep, at[:-1][some], 1)
        np.add.at(keep, at[:-1][some] + count[some], -1)
        full = full[np.cumsum(keep[: len(full)]) > 0]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(full, pa.float64()))


def flexibility(values: dict[str, float], weights: list[float]):
    """Windows of nine of upper-case sequences, as in functions.protein."""
    lut = table(values, np.nan)

    @F.arrow_udf("array<double>")
    def run(seqs: pa.Array) -> pa.Array:
        data, at = letters(seqs)
        v = lut[data]
        bad = np.flatnonzero(np.isnan(v))
        if len(bad):
            long = np.diff(at)[np.searchsorted(at, bad, "right") - 1] > 9
            if long.any():
                s, i = _row_of(seqs, at, int(bad[long][0]))
                raise ValueError(f"unknown residue {s[i]}")
        n = max(0, len(v) - 9)
        score = np.zeros(n)
        for j, w in enumerate(weights):
            score += (v[j : j + n] + v[8 - j : 8 - j + n]) * w
        return _lists((score + v[5 : 5 + n]) / 5.25, at, 9)

    return run


def scale(values: dict[str, float], window: int, weights: list[float]):
    """Weighed sliding means of upper-case sequences, as in functions.protein."""
    lut, half, total = table(values, np.nan), window // 2, sum(weights) * 2 + 1

    @F.arrow_udf("array<double>")
    def run(seqs: pa.Array) -> pa.Array:
        data, at = letters(seqs)
        v = lut[data]
        n = max(0, len(v) - (window - 1))
        score = np.zeros(n)
        for j, w in enumerate(weights):
            k = window - 1 - j
            x = v[j : j + n] * w + v[k : k + n] * w
            score += np.nan_to_num(x, copy=False, nan=0.0)
        if window % 2:
            score += np.nan_to_num(v[half : half + n], nan=0.0)
        return _lists(score / total, at, window - 1)

    return run


def pair_sum(alphabet: str, weights: list[list[float]]):
    """Sums, in order, of the weights of neighbouring letters of upper-case sequences; an unknown letter in a pair fails."""
    index = np.full(256, -1, np.int64)
    index[[ord(a) for a in alphabet]] = np.arange(len(alphabet))
    flat = np.array([float(w) for row in weights for w in row])

    @F.arrow_udf("double")
    def run(seqs: pa.Array) -> pa.Array:
        data, at = letters(seqs)
        i = index[data]
        known = np.minimum(i[:-1], i[1:]) >= 0
        pair = flat[np.where(known, i[:-1] * len(alphabet) + i[1:], 0)]
        bad = np.flatnonzero(~known)
        if len(bad):
            ends = at[np.searchsorted(at, bad, "right")]
            if (inside := bad + 1 < ends).any():
                s, k = _row_of(seqs, at, int(bad[inside][0]))
                raise ValueError(f"unknown dipeptide {s[k : k + 2]}")
        out = [float(np.add.accumulate(pair[a : b - 1])[-1]) if b - a > 1 else 0.0 for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(out, pa.float64())

    return run


# ------------------------------------------------------------------ codons


def _base_index(order: str) -> np.ndarray:
    out = np.full(256, -1, np.int64)
    out[[ord(a) for a in order]] = np.arange(len(order))
    return out


def codon_places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places of the whole codons of all rows, and where each row's codons begin among them."""
    count = np.diff(at) // 3
    first = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(at[:-1] - 3 * first[:-1], count) + 3 * np.arange(int(first[-1])), first


def codon_totals(column: str):
    """For mapInArrow: rows (codon, n) of each batch of upper-case sequences; codons of other letters than A, C, G and T are named too."""
    order = "ACGT"
    index = _base_index(order)
    names = [a + b + c for a in order for b in order for c in order]

    def run(parts):
        for part in parts:
            seqs = part.column(column)
            data, at = letters(seqs)
            p, _ = codon_places(at)
            x, y, z = (index[data[p + k]] for k in range(3))
            known = np.minimum(np.minimum(x, y), z) >= 0
            n = np.bincount((x * 16 + y * 4 + z)[known], minlength=64).tolist()
            found = {c: k for c, k in zip(names, n) if k}
            for q in p[~known].tolist():
                s, i = _row_of(seqs, at, q)
                found[s[i : i + 3]] = found.get(s[i : i + 3], 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["codon", "n"])

    return run


def codon_logs(logs: dict[str, float | None], left_out: list[str]):
    """(sum of logs in order, number) of the codons of upper-case sequences but the left-out ones; one without a log fails."""
    order = "ACGT"
    index = _base_index(order)
    value, used = np.full(64, np.nan), np.ones(64, bool)
    for i, c in enumerate(a + b + c for a in order for b in order for c in order):
        value[i] = np.nan if logs.get(c) is None else logs[c]
        used[i] = c not in left_out

    @F.arrow_udf("struct<s:double,n:int>")
    def run(seqs: pa.Array) -> pa.Array:
        data, at = letters(seqs)
        p, first = codon_places(at)
        x, y, z = (index[data[p + k]] for k in range(3))
        known = np.minimum(np.minimum(x, y), z) >= 0
        code = np.where(known, x * 16 + y * 4 + z, 0)
        take = used[code] | ~known
        v = np.where(known, value[code], np.nan)[take]
        if np.isnan(v).any():
            s, i = _row_of(seqs, at, int(p[take][np.isnan(v)][0]))
            raise ValueError(f"illegal codon in sequence: {s[i : i + 3]}")
        ends = np.concatenate([[0], np.cumsum(take)])[first]
        sums = [float(np.add.accumulate(v[a:b])[-1]) if b > a else 0.0 for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        null = seqs.is_null()
        return pa.StructArray.from_arrays([pa.array(sums, pa.float64()), pa.array(np.diff(ends), pa.int32())], ["s", "n"], mask=null)

    return run


class Reader:
    """Residues of codons by a table over all triples of letters; `spell` reads one sequence that is not plain ASCII."""

    def __init__(self, alphabet: str, residues: dict[str, str], stop: str, swap: dict[str, str] | None = None):
        self.residues, self.stop, self.swap, self.n = residues, stop, str.maketrans(swap or {}), len(alphabet)
        place = {a: i for i, a in enumerate(alphabet)}
        self.plain, self.other = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for c in range(128):
            self.plain[c] = place.get(chr(c).upper().replace("U", "T"), -1)
            self.other[c] = place.get(chr(c).translate(self.swap).upper().replace("U", "T"), -1)
        self.lut = np.array([ord(residues[a + b + c]) for a in alphabet for b in alphabet for c in alphabet] + [0], np.uint8)

    def look_up(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Residue letters of triples of places in the alphabet; 0 where one is not of it."""
        code = (x * self.n + y) * self.n + z
        code[np.minimum(np.minimum(x, y), z) < 0] = len(self.lut) - 1
        return self.lut[code]

    def spell(self, seq: str, to_stop: bool = False) -> str:
        s, out = seq.upper().replace("U", "T"), []
        for i in range(0, len(s) // 3 * 3, 3):
            if s[i : i + 3] not in self.residues:
                raise ValueError(f"Codon '{s[i : i + 3]}' is invalid")
            if to_stop and self.residues[s[i : i + 3]] == "*":
                break
            out.append(self.residues[s[i : i + 3]])
        return "".join(out).replace("*", self.stop)

    def finish(self, text: bytes) -> str:
        return text.decode("latin-1").replace("*", self.stop)


def translated(reader: Reader, to_stop: bool):
    @F.arrow_udf("string")
    def run(seqs: pa.Array) -> pa.Array:
        rows = seqs.to_pylist()
        out: list[str | None] = [None] * len(rows)
        plain = [r is not None and r.isascii() for r in rows]
        data, at = letters(pa.array([r if p else "" for r, p in zip(rows, plain)], pa.string()))
        x = reader.plain[data]
        n = max(0, len(x) - 2)
        full = reader.look_up(x[:n], x[1 : n + 1], x[2 : n + 2])
        for r, (seq, a, b) in enumerate(zip(rows, at[:-1].tolist(), at[1:].tolist())):
            if seq is None:
                continue
            text = full[a : max(a, b - 2) : 3].tobytes() if plain[r] else b""
            cut = text.find(b"*") if to_stop else -1
            text = text if cut < 0 else text[:cut]
            out[r] = reader.finish(text) if plain[r] and b"\0" not in text else reader.spell(seq, to_stop)
        return pa.array(out, pa.string())

    return run


def six_frames(reader: Reader):
    kind = "array<struct<frame:int,protein:string>>"
    frames = [1, 2, 3, -1, -2, -3]

    @F.arrow_udf(kind)
    def run(seqs: pa.Array) -> pa.Array:
        rows = seqs.to_pylist()
        plain = [r is not None and r.isascii() for r in rows]
        data, at = letters(pa.array([r if p else "" for r, p in zip(rows, plain)], pa.string()))
        x, y = reader.plain[data], reader.other[data]
        n = max(0, len(x) - 2)
        ahead = reader.look_up(x[:n], x[1 : n + 1], x[2 : n + 2])
        back = reader.look_up(y[2 : n + 2], y[1 : n + 1], y[:n])
        out: list[str | None] = []
        for seq, p, a, b in zip(rows, plain, at[:-1].tolist(), at[1:].tolist()):
            if seq is None:
                out += [None] * 6
                continue
            own = (ahead[a : max(a, b - 2)], back[a : max(a, b - 2)][::-1])
            if p and all(v.all() for v in own):
                out += [reader.finish(v[i::3].tobytes()) for v in own for i in range(3)]
            else:
                out += [reader.spell(v[i:]) for v in (seq, seq.translate(reader.swap)[::-1]) for i in range(3)]
        items = pa.StructArray.from_arrays([pa.array(frames * len(rows), pa.int32()), pa.array(out, pa.string())], ["frame", "protein"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 6, pa.int32()), items)

    return run


def call(udf, *columns: Column) -> Column:
    """The Column of a kernel, with bounded batches."""
    batches()
    return udf(*columns)
