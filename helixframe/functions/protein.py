"""Column functions over protein sequences (P1-P11). Sums keep one fixed order, so doubles are reproducible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import load
from . import kernels
from .sequence import _c, bound, count_letters, counted, lookup, molecular_weight

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda a: a != "")


def _upper(seq: str | Column) -> Column:
    return F.upper(_c(seq))


def residue_counts(seq: str | Column) -> Column:
    """A2: map of the 20 residues to their counts, zeros included."""
    return bound(_upper(seq), lambda s: F.create_map(*[x for a in AMINO_ACIDS for x in (F.lit(a), count_letters(s, a))]))


def _share(s: Column, a: str) -> Column:
    return count_letters(s, a).cast("double") * 100.0 / F.length(s).cast("double")


def residue_percent(seq: str | Column) -> Column:
    """Percent of each residue; null for an empty sequence."""
    return bound(_upper(seq), lambda s: F.when(F.length(s) > 0, F.create_map(*[x for a in AMINO_ACIDS for x in (F.lit(a), _share(s, a))])))


def _sum_shares(s: Column, letters: str) -> Column:
    total = F.lit(0.0)
    for a in letters:
        total = total + _share(s, a) / 100.0
    return total


def aromaticity(seq: str | Column) -> Column:
    """Share of Y, W and F."""
    return bound(_upper(seq), lambda s: F.when(F.length(s) > 0, _sum_shares(s, "YWF")))


def secondary_structure(seq: str | Column) -> Column:
    """P10: shares of helix, turn and sheet formers."""
    parts = (("helix", "EMALK"), ("turn", "NPGSD"), ("sheet", "VIYFWLT"))
    return bound(_upper(seq), lambda s: F.when(F.length(s) > 0, F.struct(*[_sum_shares(s, x).alias(n) for n, x in parts])))


def extinction(seq: str | Column) -> Column:
    """Molar extinction coefficients with cysteines reduced and with cystines."""
    s = _upper(seq)
    reduced = count_letters(s, "W") * 5500 + count_letters(s, "Y") * 1490
    return F.struct(reduced.alias("reduced"), (reduced + F.floor(count_letters(s, "C") / 2).cast("int") * 125).alias("cystines"))


def weight(seq: str | Column, monoisotopic: bool = False) -> Column:
    """P2."""
    return molecular_weight(seq, "protein", monoisotopic=monoisotopic)


def scale_values(name: str) -> dict[str, float]:
    """A scale by name."""
    p = load("protein")
    key = p["GRAVY_SCALES"].get(name, name)
    if key not in p["SCALES"]:
        raise ValueError(f"scale: {name} not known")
    return dict(zip(p["AMINO_ACIDS"], p["SCALES"][key]))


def gravy(seq: str | Column, scale: str = "KyteDoolitle", ordered: bool = False) -> Column:
    """Mean of a hydropathy scale, summed by the counts of the residues. With ordered, residue by residue: fractional entries
    with compensation, whole ones plainly, the compensation starting at the first fractional entry; the last digit may differ."""
    values = scale_values(scale)
    if not ordered:
        s = _upper(seq)
        return F.when(F.length(s) > 0, counted(s, values, "unknown residue {}") / F.length(s).cast("double"))
    whole = F.array(*[F.lit(a) for a, v in values.items() if isinstance(v, int)]).cast("array<string>")
    m = lookup(values)
    s = _upper(seq)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"), F.lit(False).alias("on"))

    def step(acc: Column, a: Column) -> Column:
        x = F.coalesce(F.try_element_at(m, a), F.raise_error(F.concat(F.lit("unknown residue "), a)).cast("double"))
        t = acc["s"] + x
        c = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        plain = F.array_contains(whole, a) | ~acc["on"]
        return F.struct(t.alias("s"), F.when(plain, acc["c"]).otherwise(acc["c"] + c).alias("c"), (acc["on"] | ~F.array_contains(whole, a)).alias("on"))

    total = F.aggregate(_letters(s), start, step, lambda z: z["s"] + z["c"])
    return F.when(F.length(s) > 0, total / F.length(s).cast("double"))


def instability(seq: str | Column) -> Column:
    """10 / length times the plain sum of dipeptide weights; an unknown residue fails the query."""
    s = _upper(seq)
    total = kernels.call(kernels.pair_sum(AMINO_ACIDS, load("protein")["DIWV"]), s)
    return F.when(F.length(s) > 0, F.lit(10.0) / F.length(s).cast("double") * total)


def flexibility(seq: str | Column) -> Column:
    """P5: sliding window of nine with the middle weighed from the sixth place; length minus nine windows."""
    values = dict(zip(AMINO_ACIDS, load("protein")["FLEX"]))
    return kernels.call(kernels.flexibility(values, [0.25, 0.4375, 0.625, 0.8125]), _upper(seq))


def protein_scale(seq: str | Column, scale: dict[str, float] | str, window: int, edge: float = 1.0) -> Column:
    """Weighed sliding means of a scale; residues without a value drop out."""
    if window <= 1:
        raise ZeroDivisionError("division by zero")
    values = scale_values(scale) if isinstance(scale, str) else scale
    unit = 2 * (1.0 - edge) / (window - 1)
    return kernels.call(kernels.scale(values, window, [edge + unit * i for i in range(window // 2)]), _upper(seq))


def _content(s: Column) -> Column:
    """What the charge depends on: counts of the charged residues and the constants of the two ends."""
    p = load("protein")

    def end(value: float, at: Column, special: dict) -> Column:
        out = F.lit(float(value))
        for a, v in special.items():
            out = F.when(at == a, F.lit(float(v))).otherwise(out)
        return out

    counts = [count_letters(s, a).cast("double").alias(a) for a in p["CHARGED_AAS"]]
    return F.struct(*counts, end(p["POSITIVE_PKS"]["Nterm"], F.substring(s, 1, 1), p["PK_NTERMINAL"]).alias("Nterm"), end(p["NEGATIVE_PKS"]["Cterm"], F.substring(s, -1, 1), p["PK_CTERMINAL"]).alias("Cterm"))


def _charge(c: Column, ph: Column) -> Column:
    p = load("protein")
    plus, minus = F.lit(0.0), F.lit(0.0)
    for a, v in p["POSITIVE_PKS"].items():
        k, n = (c["Nterm"], F.lit(1.0)) if a == "Nterm" else (F.lit(float(v)), c[a])
        plus = plus + n * (F.lit(1.0) / (F.pow(F.lit(10.0), ph - k) + 1.0))
    for a, v in p["NEGATIVE_PKS"].items():
        k, n = (c["Cterm"], F.lit(1.0)) if a == "Cterm" else (F.lit(float(v)), c[a])
        minus = minus + n * (F.lit(1.0) / (F.pow(F.lit(10.0), k - ph) + 1.0))
    return plus - minus


def charge(seq: str | Column, ph: float = 7.0) -> Column:
    """Net charge at a pH."""
    s = _upper(seq)
    return F.when(F.length(s) > 0, bound(_content(s), lambda c: _charge(c, F.lit(float(ph)))))


def isoelectric_point(seq: str | Column, ph: float = 7.775, low: float = 4.05, high: float = 12.0) -> Column:
    """Bisection until the interval is at most 0.0001 wide."""
    s = _upper(seq)
    start = F.struct(F.lit(ph).alias("p"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(c: Column, acc: Column) -> Column:
        up = _charge(c, acc["p"]) > 0
        lo, hi = F.when(up, acc["p"]).otherwise(acc["lo"]), F.when(up, acc["hi"]).otherwise(acc["p"])
        new = F.struct(((lo + hi) / 2).alias("p"), lo.alias("lo"), hi.alias("hi"))
        return F.when(acc["hi"] - acc["lo"] > 0.0001, new).otherwise(acc)

    out = bound(_content(s), lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, lambda acc, _: step(c, acc), lambda a: a["p"]))
    return F.when(F.length(s) > 0, out)
