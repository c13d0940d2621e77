"""Column functions over nucleotide sequences. All are built-in expressions: nothing leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import load

_FROM, _TO = "ABCDGHKMRTUVYabcdghkmrtuvy", "TVGHCDMKYAABRtvghcdmkyaabr"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, body) -> Column:
    """body(x) with x computed once per row: an expression named inside a lambda or a branch is computed again at every use."""
    return F.element_at(F.transform(F.array(x), body), 1)


def count_letters(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters: the bytes that it loses with them. Few plain letters are replaced one after the
    other, which is several times faster than a translate that looks every character up."""
    if not letters.isascii() or len(letters) > 8:
        return F.length(seq) - F.length(F.translate(seq, letters, ""))
    rest = seq
    for a in letters:
        rest = F.replace(rest, F.lit(a), F.lit(""))
    return F.octet_length(seq) - F.octet_length(rest)


def complement(seq: str | Column) -> Column:
    """IUPAC complement without reversing; case kept, U becomes A, other characters stay."""
    return F.translate(_c(seq), _FROM, _TO)


def reverse_complement(seq: str | Column) -> Column:
    """F1."""
    return F.reverse(complement(seq))


def gc_counts(seq: str | Column) -> Column:
    """Struct of G/C/S and A/T/W/U counts, both cases."""
    s = _c(seq)
    return F.struct(count_letters(s, "CGScgs").alias("gc"), count_letters(s, "ATWUatwu").alias("at"))


def gc_fraction(seq: str | Column, ambiguous: str = "remove") -> Column:
    """GC share of unambiguous letters, of all letters, or with ambiguous letters weighed; 0 of nothing."""
    s = _c(seq)
    gc, at = count_letters(s, "CGScgs").cast("double"), count_letters(s, "ATWUatwu")
    if ambiguous == "remove":
        top, length = gc, gc + at
    elif ambiguous == "ignore":
        top, length = gc, F.length(s)
    elif ambiguous == "weighted":
        top, length = gc, F.length(s)
        values = load("residues")["GC_VALUES"]
        for letter in "BDHKMNRVXY":
            top = top + count_letters(s, letter + letter.lower()) * F.lit(float(values[letter]))
    else:
        raise ValueError(f"ambiguous value '{ambiguous}' not recognized")
    return F.coalesce(F.try_divide(top, length.cast("double")), F.when(s.isNotNull(), F.lit(0.0)))


def gc123(seq: str | Column) -> Column:
    """percent GC over all positions and at each codon position, A, C, G and T only; nothing at all gives null."""
    s = _c(seq)
    at, gc = [], []
    for p in range(3):
        # every third base from p: the others are cut out of each codon
        picked = F.regexp_replace(F.substring(s, p + 1, 2**30), r"(?s)(.).{0,2}", "$1")
        at.append(count_letters(picked, "ATat").cast("double"))
        gc.append(count_letters(picked, "GCgc").cast("double"))
    zero = F.lit(0.0)
    frame = [F.coalesce(F.try_divide(g * 100.0, g + a), zero) for g, a in zip(gc, at)]
    total = F.try_divide((gc[0] + gc[1] + gc[2]) * 100.0, gc[0] + gc[1] + gc[2] + at[0] + at[1] + at[2])
    out = F.struct(total.alias("gc"), *[f.alias(f"gc{i + 1}") for i, f in enumerate(frame)])
    return F.when(total.isNotNull(), out)


def windows(seq: str | Column, size: int) -> Column:
    """Non-overlapping pieces of a sequence, the last one shorter."""
    return F.regexp_extract_all(_c(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def gc_skew(seq: str | Column, window: int = 100) -> Column:
    """(G - C) / (G + C) of each window, 0 where there is neither."""
    if window == 0:
        raise ValueError("range() arg 3 must not be zero")
    if window < 0:
        return F.array().cast("array<double>")

    def skew(w: Column) -> Column:
        g, c = count_letters(w, "Gg").cast("double"), count_letters(w, "Cc").cast("double")
        return F.coalesce(F.try_divide(g - c, g + c), F.lit(0.0))

    return F.transform(windows(seq, window), skew)


def codons(seq: str | Column) -> Column:
    """Whole codons, upper case."""
    return F.regexp_extract_all(F.upper(_c(seq)), F.lit("(?s)..."), F.lit(0))


def kmers(seq: str | Column, k: int) -> Column:
    """All overlapping k-mers of A, C, G and T, upper case; see A1."""
    if not 1 <= k <= 16:
        raise ValueError("k must be between 1 and 16")
    return F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


# ------------------------------------------------------------------ sums in a fixed order


def compensated(values: Column) -> Column:
    """Neumaier sum of an array of doubles, in order."""

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        c = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + c).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda a: a["s"] + a["c"])


def counted(s: Column, values: dict[str, float], message: str) -> Column:
    """Sum of the values of all letters of s, by their counts in one fixed order; a letter without a value fails the query."""
    other = f"(?s)[^{re.escape(''.join(values))}]"

    def total(x: Column) -> Column:
        out = F.lit(0.0)
        for a, v in values.items():
            out = out + count_letters(x, a).cast("double") * F.lit(float(v))
        bad = F.raise_error(F.concat(F.lit(message.split("{}")[0]), F.regexp_extract(x, other, 0), F.lit(message.split("{}")[1]))).cast("double")
        return F.when(~x.rlike(other), out).when(x.isNotNull(), bad)

    return bound(s, total)


def lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def molecular_weight(seq: str | Column, seq_type: str = "DNA", double_stranded: bool = False, circular: bool = False, monoisotopic: bool = False, ordered: bool = False) -> Column:
    """residue masses less the water of each bond; an unknown letter fails the query and is named.

    Masses are summed by the counts of the letters; with ordered, one by one in the order of the sequence with compensation, which
    may differ in the last digit and takes far longer.
    """
    if seq_type not in ("DNA", "RNA", "protein"):
        raise ValueError("Allowed seq_types are DNA, RNA or protein, not %r" % seq_type)
    if seq_type == "protein" and double_stranded:
        raise ValueError("protein sequences cannot be double-stranded")
    table = load("residues")[f"{seq_type.upper()}_WEIGHTS{'_MONOISOTOPIC' if monoisotopic else ''}"]
    water = 18.010565 if monoisotopic else 18.0153
    s = F.upper(F.regexp_replace(_c(seq), r"\s", ""))
    weights = lookup(table)

    def strand(x: Column) -> Column:
        bonds = F.length(x) - (0 if circular else 1)
        if not ordered:
            return counted(x, table, f"'{{}}' is not a valid unambiguous letter for {seq_type}") - bonds.cast("double") * water
        letters = F.filter(F.split(x, ""), lambda a: a != "")
        mass = F.transform(letters, lambda a: F.coalesce(F.try_element_at(weights, a), F.raise_error(F.concat(F.lit("'"), a, F.lit(f"' is not a valid unambiguous letter for {seq_type}"))).cast("double")))
        return compensated(mass) - bonds.cast("double") * water

    total = strand(s)
    if double_stranded:
        total = total + strand(F.translate(s, "ACGTU" if seq_type == "DNA" else "ACGU", "TGCAA" if seq_type == "DNA" else "UGCA"))
    return total


# ------------------------------------------------------------------ protein alphabets


def seq3(seq: str | Column, custom: dict[str, str] | None = None, undefined: str = "Xaa") -> Column:
    """one-letter to three-letter residues."""
    names = load("residues")["PROTEIN_1TO3"] | ({"*": "Ter"} if custom is None else custom)
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(_c(seq), ""), lambda a: a != ""), lambda a: F.coalesce(F.try_element_at(m, a), F.lit(undefined))), "")


def seq1(seq: str | Column, custom: dict[str, str] | None = None, undefined: str = "X") -> Column:
    """three-letter to one-letter residues, any case; a remainder is dropped."""
    names = load("residues")["PROTEIN_3TO1"] | ({"Ter": "*"} if custom is None else custom)
    m = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.upper(), v)])
    return F.array_join(F.transform(codons(seq), lambda a: F.coalesce(F.try_element_at(m, a), F.lit(undefined))), "")


def nt_pattern(query: str) -> str:
    """the regular expression of an ambiguous DNA query; an unknown letter is a KeyError."""
    values = load("residues")["AMBIGUOUS_DNA_VALUES"]
    return "".join(values[x] if len(values[x]) == 1 else f"[{values[x]}]" for x in query)


def nt_search(seq: str | Column, query: str) -> Column:
    """0-based starts of all overlapping matches.

    A zero-width split at each match start gives the pieces between starts; their running length is the position.
    """
    s = _c(seq)
    lengths = F.transform(F.split(s, f"(?={nt_pattern(query)})"), F.length)
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    first = F.when(s.rlike(f"^(?:{nt_pattern(query)})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    size = F.length(s)
    inner = F.element_at(F.transform(F.array(ends), lambda v: F.filter(F.slice(v, F.lit(2), F.greatest(F.size(v) - 2, F.lit(0))), lambda p: p > 0)), 1)
    return F.when(size > 0, F.array_distinct(F.concat(first, inner))).otherwise(F.array().cast("array<int>"))


# ------------------------------------------------------------------ checksums


def crc32(seq: str | Column) -> Column:
    """F18."""
    return F.crc32(_c(seq).cast("binary"))


def crc64_table() -> list[int]:
    """the upper halves of the 256 table entries."""
    out = []
    for i in range(256):
        low, high = i, 0
        for _ in range(8):
            flag, low, carry = low & 1, low >> 1, high & 1
            high >>= 1
            if carry:
                low |= 1 << 31
            if flag:
                high ^= 0xD8000000
        out.append(high)
    return out


def crc64(seq: str | Column) -> Column:
    """CRC-64 of the code points' low bytes as CRC- and sixteen hex digits."""
    table = F.array(*[F.lit(v - (1 << 32) if v >= 1 << 31 else v).cast("long") for v in crc64_table()])
    letters = F.filter(F.split(_c(seq), ""), lambda a: a != "")

    def step(acc: Column, a: Column) -> Column:
        index = (acc.bitwiseXOR(F.ascii(a).cast("long"))).bitwiseAND(F.lit(255)).cast("int")
        return F.shiftrightunsigned(acc, 8).bitwiseXOR(F.shiftleft(F.element_at(table, index + 1), 32))

    value = F.aggregate(letters, F.lit(0).cast("long"), step)
    text = F.lpad(F.hex(value), 16, "0")
    return F.concat(F.lit("CRC-"), text)


def gcg(seq: str | Column) -> Column:
    """GCG checksum."""
    letters = F.filter(F.split(F.upper(_c(seq)), ""), lambda a: a != "")
    terms = F.transform(letters, lambda a, i: (F.pmod(i, F.lit(57)) + 1).cast("long") * F.ascii(a))
    return F.pmod(F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(10000)).cast("int")


def seguid(seq: str | Column) -> Column:
    """SHA-1 of the upper-case sequence in base 64 without padding."""
    return F.rtrim(F.base64(F.unhex(F.sha1(F.upper(_c(seq)).cast("binary")))), F.lit("="))


def xgc_skew(*_, **__):
    """draws a picture instead of measuring; refused."""
    raise NotImplementedError("a drawing; use gc_skew for the values")
