"""Translation under the genetic codes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import codes
from . import kernels
from .sequence import _FROM, _TO, _c, codons, gc_fraction


_LETTERS = "".join(codes.DNA_CODES)


def _reader(code: codes.Code, stop: str, gap: str | None):
    """codon -> residue by its place in an array of all codons: no search through a map."""
    m = code.codon_map()
    residues = F.array(*[F.lit(stop if m[a + b + c] == "*" else m[a + b + c]) for a in _LETTERS for b in _LETTERS for c in _LETTERS])
    n = len(_LETTERS)

    def read(codon: Column) -> Column:
        p = [F.instr(F.lit(_LETTERS), F.substring(codon, k, 1)) for k in (1, 2, 3)]
        bad = F.raise_error(F.concat(F.lit("Codon '"), codon, F.lit("' is invalid"))).cast("string")
        out = F.when(F.least(*p) > 0, F.element_at(residues, (p[0] - 1) * n * n + (p[1] - 1) * n + p[2])).otherwise(bad)
        return F.when(codon == gap * 3, gap).otherwise(out) if gap else out

    return read


def translate(seq: str | Column, table: int | str = "Standard", stop_symbol: str = "*", to_stop: bool = False, cds: bool = False, gap: str | None = None) -> Column:
    """Residues of the whole codons of seq. U reads as T, ambiguous codons give the letter that covers them, legal ones
    without a letter X; anything else fails the query and is named. A trailing partial codon is left out."""
    code = codes.get(table)
    if gap is not None and len(gap) != 1:
        raise ValueError("Gap character should be a single character")
    if code.dual:
        if to_stop:
            raise ValueError(f"You cannot use 'to_stop=True' with this table as it contains {len(code.dual)} codon(s) which can be both STOP and an amino acid.")
        warnings.warn(f"This table contains {len(code.dual)} codon(s) which code(s) for both STOP and an amino acid (e.g. '{code.dual[0][0]}' -> '{code.dual[0][1]}' or STOP).", stacklevel=2)
    if not cds and gap is None:
        return kernels.call(kernels.translated(kernels.Reader(_LETTERS, code.codon_map(), stop_symbol), to_stop), _c(seq))
    residue = _reader(code, stop_symbol, gap)
    s = F.translate(F.upper(_c(seq)), "U", "T")
    parts = codons(s)
    if cds:
        first, last = F.element_at(parts, 1), F.element_at(parts, -1)
        bad = F.when(F.length(s) % 3 != 0, F.lit("Sequence length is not a multiple of three"))
        bad = bad.when(~F.coalesce(F.array_contains(F.array(*map(F.lit, code.starts)), first), F.lit(False)), F.concat(F.lit("First codon '"), F.coalesce(first, F.lit("")), F.lit("' is not a start codon")))
        bad = bad.when(~F.array_contains(F.array(*map(F.lit, code.stops)), last), F.concat(F.lit("Final codon '"), last, F.lit("' is not a stop codon")))
        bad = bad.when(F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda c: F.array_contains(F.array(*map(F.lit, code.stops)), c)), F.lit("Extra in frame stop codon found."))
        body = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        text = F.concat(F.lit("M"), F.array_join(F.transform(body, residue), ""))
        return F.when(bad.isNull(), text).otherwise(F.raise_error(bad).cast("string"))
    out = F.transform(parts, residue)
    if to_stop:
        stops = F.array(*[F.lit(k) for k, v in code.codon_map().items() if v == "*"])
        cut = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(False).alias("end")), lambda a, c: F.struct((a["n"] + F.when(a["end"] | F.array_contains(stops, c), 0).otherwise(1)).alias("n"), (a["end"] | F.array_contains(stops, c)).alias("end")), lambda a: a["n"])
        out = F.transform(F.slice(parts, F.lit(1), cut), residue)
    return F.array_join(out, "")


def six_frames(seq: str | Column, table: int | str = 1) -> Column:
    """Array of (frame, protein) for frames 1, 2, 3, -1, -2, -3; explode it for a relation."""
    code = codes.get(table)
    if code.dual:
        translate(seq, table)  # its warning
    return kernels.call(kernels.six_frames(kernels.Reader(_LETTERS, code.codon_map(), "*", dict(zip(_FROM, _TO)))), _c(seq))


def six_frame_text(seq: str, table: int | str = 1) -> str:
    """F16: the printed picture of the six frames of one sequence, for reports."""
    swap = str.maketrans("ABCDGHKMRTUVYabcdghkmrtuvy", "TVGHCDMKYAABRtvghcdmkyaabr")
    code = codes.get(table)
    anti = seq.translate(swap)[::-1]
    if "u" in seq.lower():
        anti = anti.replace("T", "U").replace("t", "u")
    m = code.codon_map()

    def read(x: str) -> str:
        x = x.upper().replace("U", "T")
        return "".join(m[x[i : i + 3]] for i in range(0, len(x) // 3 * 3, 3))

    n, comp = len(seq), anti[::-1]
    frame = {i + 1: read(seq[i:]) for i in range(3)} | {-i - 1: read(anti[i : i + 3 * ((n - i) // 3)])[::-1] for i in range(3)}
    gc = 100 * sum(c in "CGScgs" for c in seq) / n if n else 0
    short = seq if n <= 20 else f"{seq[:10]} ... {seq[-10:]}"
    lines = ["GC_Frame:" + "".join(f" {x}:{seq.count(x.upper())}" for x in "atgc"), f"Sequence: {short.lower()}, {n} nt, {gc:0.2f} %GC", "", "", ""]
    for i in range(0, n, 60):
        p = slice(i // 3, i // 3 + 20)
        rows = {k: "  ".join(v[p]) for k, v in frame.items()}
        lines[-1] += f"{i + 1}/{int(i / 3 + 1)}"
        lines += ["  " + rows[3], " " + rows[2], rows[1], f"{seq[i : i + 60].lower()}{int(gc):5d} %", comp[i : i + 60].lower(), rows[-2], " " + rows[-1], "  " + rows[-3], "", ""]
    return "\n".join(lines)


__all__ = ["gc_fraction", "six_frame_text", "six_frames", "translate"]
