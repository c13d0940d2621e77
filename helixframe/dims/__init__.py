"""Reference dimensions: genetic codes, restriction enzymes, substitution matrices, residue masses and scales.

All are constants of a fixed size (the largest has a few thousand rows), read from packed resources once per process
and handed to Spark as literals or small tables.
"""

from __future__ import annotations

import gzip
import json
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


@cache
def load(name: str):
    with resources.files(__package__).joinpath("data", f"{name}.json.gz").open("rb") as f:
        return json.loads(gzip.decompress(f.read()))


ENZYME_FIELDS = ["name", "site", "fst5", "fst3", "scd5", "scd3", "ovhg", "ovhgseq", "size", "freq", "suppl", "opt_temp", "inact_temp", "uri", "rebase_id", "types"]


def enzyme_table(spark: SparkSession) -> DataFrame:
    """One row per restriction enzyme."""
    rows = [(*e[:9], float(e[9]) if e[9] is not None else None, e[10], *(None if v is None else str(v) for v in e[11:13]), e[13], e[14], e[15]) for e in load("enzymes")["enzymes"]]
    return spark.createDataFrame(rows, "name string, site string, fst5 int, fst3 int, scd5 int, scd3 int, ovhg int, ovhgseq string, size int, freq double, suppl array<string>, opt_temp string, inact_temp string, uri string, rebase_id long, types array<string>")


def supplier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(load("enzymes")["suppliers"].items()), "code string, supplier string")


def matrix_names() -> list[str]:
    """The names of the built-in substitution matrices, sorted."""
    return sorted(m[0] for m in load("matrices"))


@cache
def matrix(name: str) -> dict[tuple[str, str], float]:
    """Scores of a named matrix by (row letter, column letter); a lower triangle is mirrored."""
    found = [m for m in load("matrices") if m[0] == name]
    if not found:
        raise KeyError(name)
    _, _, alphabet, symmetric, values = found[0]
    numbers = [float(v) for v in (values.split() if isinstance(values, str) else values)]
    out, k = {}, 0
    for i, a in enumerate(alphabet):
        for b in alphabet[: i + 1] if symmetric else alphabet:
            out[a, b] = numbers[k]
            if symmetric:
                out[b, a] = numbers[k]
            k += 1
    return out


def matrix_table(spark: SparkSession, *names: str) -> DataFrame:
    rows = [(n, a, b, s) for n in names or matrix_names() for (a, b), s in matrix(n).items()]
    return spark.createDataFrame(rows, "matrix string, row_letter string, col_letter string, score double")


def read_matrix(text: str) -> dict[tuple[str, str], float]:
    """A matrix file: # comments, a line of column letters, then a letter and its scores per line; or letter and score."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    if not lines:
        raise ValueError("no rows in the matrix")
    if len(lines) > 1 and len(lines[1]) == len(lines[0]) + 1:
        return {(r[0], c): float(v) for r in lines[1:] for c, v in zip(lines[0], r[1:], strict=True)}
    return {(r[0], ""): float(r[1]) for r in lines}


def scale_table(spark: SparkSession) -> DataFrame:
    """Residue scales; is_int keeps whole numbers apart, which the compensated sum needs."""
    p = load("protein")
    rows = [(s, aa, float(v), isinstance(v, int)) for s, values in p["SCALES"].items() for aa, v in zip(p["AMINO_ACIDS"], values)]
    return spark.createDataFrame(rows, "scale string, aa string, value double, is_int boolean")
