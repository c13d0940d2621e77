"""Genetic codes (G1-G9): tables by id and name, alphabets, ambiguous codons, back tables."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from . import load

ORDER = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
#: IUPAC letters, each before the bases it stands for.
DNA_CODES = {w[0]: w[1:] for w in "AA CC GG TT MAC RAG WAT SCG YCT KGT VACG HACT DAGT BCGT XGATC NGATC".split()}
_PROTEIN_CODES = [("B", "DN"), ("J", "IL"), ("Z", "EQ"), ("X", "ACDEFGHIKLMNPQRSTVWY")]
_CUSTOM: list = []


class TranslationError(ValueError):
    """A codon that no reading of the code allows."""


class Code:
    """One genetic code."""

    def __init__(self, ident: int, name: str, alt: str | None, aas: str, starts: list[str], stops: list[str], dual: list):
        self.id, self.name, self.alt, self.starts, self.stops, self.dual = ident, name, alt, list(starts), list(stops), [tuple(d) for d in dual]
        self.names = [n.strip() for n in name.split(";")] + ([alt] if alt else [])
        self.forward = {c: a for c, a in zip(ORDER, aas) if a != "*"} | dict(self.dual)

    def back(self) -> dict[str | None, str]:
        """Residue -> its last codon in sorted order; None -> the first stop."""
        out: dict[str | None, str] = {}
        for codon in sorted(self.forward):
            out[self.forward[codon]] = codon
        if self.stops:
            out[None] = self.stops[0]
        return out

    def possible(self, codon: str) -> list[str]:
        """Residues that an ambiguous codon may stand for; mixed with stops is an error, only stops a KeyError."""
        found, stop = set(), False
        for c in map("".join, product(*(DNA_CODES[x] for x in codon))):
            if c in self.forward:
                found.add(self.forward[c])
            elif c in self.stops:
                stop = True
        if stop:
            if found:
                raise TranslationError(f"ambiguous codon {codon!r} codes for both proteins and stop codons")
            raise KeyError(codon)
        return sorted(found)

    @cache
    def residue(self, codon: str) -> str:
        """The residue, or the smallest ambiguity letter that covers all possible ones."""
        if codon in self.forward:
            return self.forward[codon]
        found = self.possible(codon)
        if len(found) == 1:
            return found[0]
        for letter, covers in _PROTEIN_CODES:
            if set(found) <= set(covers):
                return letter
        raise TranslationError(codon)

    def ambiguous_stops(self) -> list[str]:
        """The stop codons with every ambiguous codon that expands to stops alone."""
        letters = [x for x in DNA_CODES if x != "X"]
        out = list(self.stops)
        for c in map("".join, product(letters, repeat=3)):
            if c not in out and all(e in self.stops for e in map("".join, product(*(DNA_CODES[x] for x in c)))):
                out.append(c)
        return out

    @cache
    def codon_map(self) -> dict[str, str]:
        """Every codon of IUPAC letters: residue, X where it is legal but open, * where only stops fit."""
        out = {}
        for c in map("".join, product(DNA_CODES, repeat=3)):
            try:
                out[c] = self.residue(c)
            except KeyError:
                out[c] = "*"
            except TranslationError:
                out[c] = "X"
        for c in self.stops:
            if c not in dict(self.dual):
                out[c] = "*"
        return out

    def __str__(self) -> str:
        head = f"Table {self.id} {', '.join(self.names)}\n\n" if self.id else "Table ID not set\n\n"
        lines = ["  |" + "|".join(f"  {b:<6}" for b in "TCAG") + "|", rule := "--+" + "+".join(["---------"] * 4) + "+--"]
        for a in "TCAG":
            for c in "TCAG":
                cells = []
                for b in "TCAG":
                    codon = a + b + c
                    aa = "Stop" if codon in self.stops else self.forward.get(codon, "")
                    cells.append(f" {codon} {aa}{'(s)' if codon in self.starts else ''}".ljust(9))
                lines.append(f"{a} |{'|'.join(cells)}| {c}")
            lines.append(rule)
        return head + "\n".join(lines)


@cache
def _built_in() -> list[Code]:
    return [Code(*row) for row in load("codes")]


def tables() -> list[Code]:
    return _built_in() + _CUSTOM


def register(ident: int, names: list[str], aas: str, starts: list[str], stops: list[str]) -> Code:
    """Adds a code of 64 residue letters in T, C, A, G order."""
    code = Code(ident, "; ".join(names), None, aas, starts, stops, [])
    _CUSTOM.append(code)
    return code


def get(key: int | str) -> Code:
    """A code by id or by any of its names; numbers as text are ids."""
    try:
        found = [t for t in tables() if t.id == int(key)]
    except ValueError:
        found = [t for t in tables() if key in t.names or key == t.name]
    if not found:
        raise KeyError(f"no genetic code {key!r}")
    return found[-1]


def code_table(spark: SparkSession) -> DataFrame:
    """A row per code and codon."""
    rows = [(t.id, t.names, c, t.forward.get(c), c in t.starts, c in t.stops) for t in tables() for c in ORDER]
    return spark.createDataFrame(rows, "table_id int, names array<string>, codon string, aa string, is_start boolean, is_stop boolean")


def proteins_table(spark: SparkSession) -> DataFrame:
    """Ambiguous codons (X left out as a synonym of N) of every code with the letter they translate to."""
    rows = [(t.id, c, a) for t in tables() for c, a in t.codon_map().items()]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string")
