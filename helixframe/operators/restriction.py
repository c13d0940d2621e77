"""Restriction enzymes (R1-R20): registry, relations among enzymes, digests, filters of results, reports."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..dims import ENZYME_FIELDS, enzyme_table, load, supplier_table
from ..functions import kernels

_LETTERS = {w[0]: w[1:] for w in "AA CC GG TT RAG YCT WAT SGC MAC KGT HACT BCGT VACG DAGT NACGT".split()}
_COMPLEMENT = str.maketrans("ACGTRYWSMKHBVDN", "TGCAYRWSKMDVBHN")


@cache
def _registry() -> dict[str, dict]:
    return {e[0]: dict(zip(ENZYME_FIELDS, e)) for e in load("enzymes")["enzymes"]}


def get_enzyme(name: str) -> dict:
    """R1."""
    return _registry()[name]


def names(commercial: bool | None = None) -> list[str]:
    """All enzymes, or those with (or without) a supplier."""
    return sorted(n for n, e in _registry().items() if commercial is None or ("Commercially_available" in e["types"]) == commercial)


def reverse_site(site: str) -> str:
    return site.split("|")[0].translate(_COMPLEMENT)[::-1]


def pattern(name: str) -> tuple[str, str | None]:
    """R2: expressions of the site on the top strand and, unless palindromic, on the other one."""
    e = get_enzyme(name)

    def body(site: str) -> str:
        return "".join("." if c == "N" else _LETTERS[c] if len(_LETTERS[c]) == 1 else f"[{_LETTERS[c]}]" for c in site)

    top = body(e["site"].split("|")[0])
    return top, None if "Palindromic" in e["types"] else body(reverse_site(e["site"]))


FLAGS = {"is_palindromic": "Palindromic", "cut_once": "OneCut", "cut_twice": "TwoCuts", "is_blunt": "Blunt", "is_5overhang": "Ov5", "is_3overhang": "Ov3", "is_defined": "Defined", "is_ambiguous": "Ambiguous", "is_unknown": "NotDefined", "is_methylable": "Meth_Dep", "is_comm": "Commercially_available"}


def enzymes(spark: SparkSession) -> DataFrame:
    """The enzyme dimension with its flags, overhang kind and frequency."""
    df = enzyme_table(spark)
    for flag, kind in FLAGS.items():
        df = df.withColumn(flag, F.array_contains("types", kind))
    kind = F.when(F.col("is_blunt"), "blunt").when(F.col("is_5overhang"), "5' overhang").when(F.col("is_3overhang"), "3' overhang").otherwise("unknown")
    return df.withColumn("overhang", kind)


def suppliers(spark: SparkSession) -> DataFrame:
    """(code, supplier, enzymes) of every supplier."""
    per = enzyme_table(spark).select(F.explode("suppl").alias("code"), "name").groupBy("code").agg(F.sort_array(F.collect_set("name")).alias("enzymes"))
    return per.join(F.broadcast(supplier_table(spark)), "code", "left").select("code", "supplier", "enzymes")


def relatives(spark: SparkSession, kind: str) -> DataFrame:
    """Pairs (name, other) with one recognition site: isoschizomers cut alike or not, equischizomers alike,
    neoschizomers not. A hash join on the site of a table of fixed size."""
    e = enzyme_table(spark)
    cols = ["site", "fst5", "fst3", "scd5", "scd3", "ovhg"]
    a = e.select("name", *cols)
    b = e.select(F.col("name").alias("other"), *[F.col(c).alias(f"o_{c}") for c in cols])
    same = F.lit(True)
    for c in cols[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    pair = a.join(b, (F.col("site") == F.col("o_site")) & (F.col("name") != F.col("other")))
    rule = {"isoschizomers": F.lit(True), "equischizomers": same, "neoschizomers": ~same}[kind]
    return pair.where(rule).select("name", "other")


def _compatible(a: dict, b: dict) -> bool:
    """Ends of the same side and length whose overhangs can match letter by letter."""
    if a["ovhgseq"] is None or b["ovhgseq"] is None or a["ovhg"] is None or b["ovhg"] is None:
        return False
    if a["ovhg"] == 0 or b["ovhg"] == 0:
        return a["ovhg"] == b["ovhg"] == 0
    if (a["ovhg"] > 0) != (b["ovhg"] > 0) or len(a["ovhgseq"]) != len(b["ovhgseq"]):
        return False
    return all(set(_LETTERS[x]) & set(_LETTERS[y]) for x, y in zip(a["ovhgseq"], b["ovhgseq"]))


def compatible_ends(name: str, among: list[str] | None = None) -> list[str]:
    """Enzymes whose ends can be joined to this one's, sorted, itself left out."""
    e = get_enzyme(name)
    return sorted(n for n in among or _registry() if n != name and _compatible(e, get_enzyme(n)))


def elucidate(name: str) -> str:
    """The site with ^ for the cut on the top strand and _ for the one below; ? where unknown."""
    e = get_enzyme(name)
    site = e["site"]
    if e["fst5"] is None:
        return f"? {site} ?"
    top, low = e["fst5"], len(site) + e["fst3"]
    left, right = max(0, -min(top, low)), max(0, max(top, low) - len(site))
    text = "N" * left + site + "N" * right
    top, low = top + left, low + left
    marks = sorted([(top, "^"), (low, "_")], key=lambda x: (x[0], x[1] == "_"))
    if top == low:
        return text[:top] + "^_" + text[top:]
    (a, x), (b, y) = marks
    return text[:a] + x + text[a:b] + y + text[b:]


# ------------------------------------------------------------------ digests


@cache
def _plan(name: str) -> tuple:
    e = get_enzyme(name)
    top, low = pattern(name)
    return re.compile(f"(?=({top}))"), re.compile(f"(?=({low}))") if low else None, e


def normalise(text: str) -> str:
    """Upper case without white space and digits; other characters than IUPAC nucleotides are a TypeError."""
    s = re.sub(r"[\s\d]", "", text).upper()
    if bad := re.search(r"[^ABCDGHKMNRSTVWY]", s):
        raise TypeError(f"Invalid character found in sequence: {bad[0]!r}")
    return s


def cut_positions(name: str, seq: str, linear: bool = True) -> list[int]:
    """1-based first bases of the 3' fragments of a normalised sequence."""
    top, low, e = _plan(name)
    n = len(seq)
    text = " " + seq + ("" if linear else seq[: e["size"] - 1])

    def places(base: int, sign: int, ends: tuple[str, str]) -> list[int]:
        shifts = [e[k] for k in ends if e[k] is not None]
        if "NoCut" in e["types"] or not shifts:
            return [base]
        return [base + sign * v for v in shifts]

    forward = [m.start() for m in top.finditer(text, 1)]
    cuts = [c for p in forward for c in places(p, 1, ("fst5", "scd5"))]
    if low is not None:
        seen = set(forward)
        cuts += [c for m in low.finditer(text, 1) if m.start() not in seen for c in places(m.start(), -1, ("fst3", "scd3"))]
        cuts.sort()
    if linear:
        if e["ovhg"] is None:
            return cuts
        return [c for c in cuts if 1 < c <= n and 1 < c - e["ovhg"] <= n]
    for i, c in enumerate(cuts):
        if c >= 1:
            break
        cuts[i] = c + n
    for i in range(len(cuts) - 1, -1, -1):
        if cuts[i] <= n:
            break
        cuts[i] -= n
    return cuts


def fragments(name: str, seq: str, linear: bool = True) -> list[str]:
    """The pieces of a digest; on a circle the first one spans the origin."""
    e = get_enzyme(name)
    if e["ovhg"] is None:
        raise NotImplementedError(f"{name} restriction is unknown.")
    cuts = cut_positions(name, seq, linear)
    if not cuts:
        return [seq]
    inner = [seq[a - 1 : b - 1] for a, b in zip(cuts, cuts[1:])]
    if linear:
        return [seq[: cuts[0] - 1], *inner, seq[cuts[-1] - 1 :]]
    return [seq[cuts[-1] - 1 :] + seq[: cuts[0] - 1], *inner]


_CUTS = ArrayType(StructType([StructField("enzyme", StringType()), StructField("cuts", ArrayType(IntegerType()))]))


def digest(batch: list[str], linear: bool = True):
    """Column function of a sequence: an array of (enzyme, cuts) for every enzyme of the batch. Arrow batches are bounded by bytes."""
    kernels.batches()
    chosen = sorted(batch)
    for b in chosen:
        get_enzyme(b)

    @F.udf(_CUTS, useArrow=True)
    def run(seq: str):
        if seq is None:
            return None
        s = normalise(seq)
        return [(n, cut_positions(n, s, linear)) for n in chosen]

    return run


def catalyse(name: str, linear: bool = True):
    """R4 as a Column function: the array of fragments. Arrow batches are bounded by bytes."""
    kernels.batches()
    get_enzyme(name)

    @F.udf(ArrayType(StringType()), useArrow=True)
    def run(seq: str):
        return None if seq is None else fragments(name, normalise(seq), linear)

    return run


def search(df: DataFrame, batch: list[str], seq: str = "sequence", linear: bool = True) -> DataFrame:
    """A row per sequence and enzyme with its cuts and their number; the batch travels with the task."""
    hit = F.explode(digest(batch, linear)(F.col(seq))).alias("hit")
    return df.select("*", hit).select(*df.columns, F.col("hit.enzyme").alias("enzyme"), F.col("hit.cuts").alias("cuts"), F.size("hit.cuts").alias("n_cuts"))


def palindrome_cuts(seq: str | Column, name: str) -> Column:
    """R3 without Python for a palindromic enzyme that cuts once inside a linear sequence of plain letters."""
    from ..functions.sequence import nt_search

    e = get_enzyme(name)
    if "Palindromic" not in e["types"] or "OneCut" not in e["types"]:
        raise ValueError(f"{name} is not a palindromic single cutter")
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(s)
    cuts = F.transform(nt_search(s, e["site"]), lambda p: p + 1 + e["fst5"])
    return F.filter(cuts, lambda c: (c > 1) & (c <= n) & (c - e["ovhg"] > 1) & (c - e["ovhg"] <= n))


# ------------------------------------------------------------------ filters of results (columns cuts, n_cuts)


def _bounds(start: int, end: int, length: Column) -> tuple[Column, Column]:
    if start == end:
        raise TypeError("a region needs two different bounds")
    a, b = (F.lit(x) if x >= 1 else length + x for x in (start, end))
    return F.least(a, b), F.greatest(a, b)


def only_between(found: DataFrame, start: int, end: int, seq: str = "sequence") -> DataFrame:
    """Enzymes that cut, and only inside [start, end)."""
    a, b = _bounds(start, end, F.length(seq))
    return found.where((F.col("n_cuts") > 0) & F.forall("cuts", lambda c: (c >= a) & (c < b)))


def between(found: DataFrame, start: int, end: int, seq: str = "sequence") -> DataFrame:
    a, b = _bounds(start, end, F.length(seq))
    return found.where(F.exists("cuts", lambda c: (c >= a) & (c < b)))


def only_outside(found: DataFrame, start: int, end: int, seq: str = "sequence") -> DataFrame:
    a, b = _bounds(start, end, F.length(seq))
    return found.where((F.col("n_cuts") > 0) & F.forall("cuts", lambda c: (c < a) | (c >= b)))


def outside(found: DataFrame, start: int, end: int, seq: str = "sequence") -> DataFrame:
    a, b = _bounds(start, end, F.length(seq))
    return found.where(F.exists("cuts", lambda c: (c < a) | (c >= b)))


def do_not_cut(found: DataFrame, start: int, end: int, seq: str = "sequence") -> DataFrame:
    a, b = _bounds(start, end, F.length(seq))
    return found.where(~F.exists("cuts", lambda c: (c >= a) & (c < b)))


def with_number(found: DataFrame, *counts: int) -> DataFrame:
    """Results of enzymes that cut so many times."""
    return found.where(F.col("n_cuts").isin(*counts))


def with_sites(found: DataFrame) -> DataFrame:
    return found.where("n_cuts > 0")


def without_site(found: DataFrame) -> DataFrame:
    return found.where("n_cuts = 0")


def with_name(found: DataFrame, *wanted: str) -> DataFrame:
    return found.where(F.col("enzyme").isin(*wanted))


def of_kind(spark: SparkSession, found: DataFrame, **wanted) -> DataFrame:
    """Results of enzymes with the given flags or fields, such as is_blunt=True or size=6."""
    dim = enzymes(spark)
    for k, v in wanted.items():
        dim = dim.where(F.col(k) == v)
    return found.join(F.broadcast(dim.select(F.col("name").alias("enzyme"))), "enzyme", "left_semi")


def by_cut_number(found: DataFrame) -> DataFrame:
    """Enzymes by their number of cuts per sequence."""
    keys = [c for c in found.columns if c not in ("enzyme", "cuts", "n_cuts", "sequence")]
    return found.groupBy(*keys, "n_cuts").agg(F.sort_array(F.collect_list("enzyme")).alias("enzymes"))


class Batch:
    """A set of enzymes with the usual set operations."""

    def __init__(self, first: list[str] = (), suppliers: str = ""):
        self.names = set(first)
        for n in self.names:
            get_enzyme(n)
        for s in suppliers:
            self.add_supplier(s)

    def add(self, name: str) -> None:
        get_enzyme(name)
        self.names.add(name)

    def remove(self, name: str) -> None:
        self.names.remove(name)

    def add_supplier(self, code: str) -> None:
        self.names |= {n for n, e in _registry().items() if code in e["suppl"]}

    def __add__(self, other: "Batch | str") -> "Batch":
        return Batch(self.names | ({other} if isinstance(other, str) else other.names))

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __len__(self) -> int:
        return len(self.names)

    def elements(self) -> list[str]:
        return sorted(self.names)

    def split(self, **wanted: bool) -> "Batch":
        """Enzymes for which every named flag has the given value."""
        return Batch([n for n in self.names if all((FLAGS[k] in get_enzyme(n)["types"]) == v for k, v in wanted.items())])

    def where(self, test) -> "Batch":
        return Batch([n for n in self.names if test(get_enzyme(n))])

    def search(self, df: DataFrame, seq: str = "sequence", linear: bool = True) -> DataFrame:
        return search(df, self.elements(), seq, linear)


def report(rows: list[tuple[str, list[int]]], style: str = "list", width: int = 80) -> str:
    """Printed results of one sequence: alphabetic list, grouped by number of cuts, and enzymes that do not cut."""
    cutting = sorted((n, c) for n, c in rows if c)
    none = sorted(n for n, c in rows if not c)

    def block(items: list[tuple[str, list[int]]]) -> list[str]:
        pad = max((len(n) for n, _ in items), default=0) + 11
        out = []
        for n, cuts in items:
            line = f"{n:<{pad - 11}}         :  "
            for i, c in enumerate(cuts):
                piece = f"{c}{', ' if i + 1 < len(cuts) else '.'}"
                if len(line) + len(piece.rstrip()) > width:
                    out.append(line.rstrip())
                    line = " " * (pad + 3)
                line += piece
            out.append(line.rstrip())
        return out

    out: list[str] = []
    if style == "number":
        for k in sorted({len(c) for _, c in cutting}):
            out += ["", f"enzymes which cut {k} times :" if k > 1 else "enzymes which cut once :", "", *block([x for x in cutting if len(x[1]) == k])]
    else:
        out += block(cutting)
    if none:
        out += ["", "   Enzymes which do not cut the sequence.", ""]
        per = max(1, width // 10)
        out += ["".join(f"{n:<10}" for n in none[i : i + per]).rstrip() for i in range(0, len(none), per)]
    return "\n".join(out) + "\n"
