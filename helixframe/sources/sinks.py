"""Writers (K1-K8): records as text columns and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import _c


def format_fasta(title: str | Column, seq: str | Column, wrap: int | None = 60) -> Column:
    """K1: > and title, then the sequence in lines of `wrap`; 0 or None writes one line, even if empty."""
    if wrap is not None and wrap < 0:
        raise ValueError("wrap must not be negative")
    head = F.concat(F.lit(">"), _c(title))
    if not wrap:
        return F.concat(head, F.lit("\n"), _c(seq))
    body = F.array_join(F.regexp_extract_all(_c(seq), F.lit(f"(?s).{{1,{wrap}}}"), F.lit(0)), "\n")
    return F.when(F.length(_c(seq)) == 0, head).otherwise(F.concat(head, F.lit("\n"), body))


def format_fastq(title: str | Column, seq: str | Column, quality: str | Column) -> Column:
    """K2: four lines; unequal lengths fail the query and name the record."""
    t, s, q = _c(title), _c(seq), _c(quality)
    bad = F.raise_error(F.concat(F.lit("record '"), t, F.lit("': lengths of sequence and quality differ"))).cast("string")
    return F.when(F.length(s) == F.length(q), F.concat(F.lit("@"), t, F.lit("\n"), s, F.lit("\n+\n"), q)).otherwise(bad)


def phred(quality: str | Column) -> Column:
    """Scores of a phred+33 string."""
    return F.transform(F.filter(F.split(_c(quality), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_to_sanger(scores: str | Column) -> Column:
    """K5, K6: phred+33 text of scores, rounded half to even and cut at ~."""
    return F.array_join(F.transform(_c(scores), lambda q: F.chr(F.least(F.lit(126), F.rint(q.cast("double")).cast("int") + 33))), "")


def format_qual(title: str | Column, quality: str | Column, wrap: int = 60) -> Column:
    """K3, K4: decimal scores in lines shorter than or as long as `wrap`; from wrap 1 to 5 a line stays below it."""
    if wrap < 0:
        raise ValueError("wrap must not be negative")
    words = F.transform(phred(quality), lambda q: q.cast("string"))
    head = F.concat(F.lit(">"), _c(title))
    if not wrap:
        return F.concat(head, F.lit("\n"), F.array_join(words, " "))
    most = wrap if wrap > 5 else wrap - 1

    def add(acc: Column, w: Column) -> Column:
        line = F.concat(acc["line"], F.lit(" "), w)
        fits = F.length(line) <= most
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line"))).when(fits, F.struct(acc["done"].alias("done"), line.alias("line"))).otherwise(F.struct(F.concat(acc["done"], F.lit("\n"), acc["line"]).alias("done"), w.alias("line")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    body = F.aggregate(words, start, add, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.lit("\n"), a["line"])))
    return F.concat(head, body)


def title_of(ident: str | Column, description: str | Column) -> Column:
    """K8: the title of a record: the description if it starts with the id, else both."""
    i, d = F.coalesce(_c(ident), F.lit("")), F.coalesce(_c(description), F.lit(""))
    same = F.regexp_extract(d, r"^\s*(\S+)", 1) == i
    return F.when(d == "", i).when(same, d).otherwise(F.concat(i, F.lit(" "), d))


def to_records(df: DataFrame) -> DataFrame:
    """Id, name, description, sequence and phred scores."""
    cols = [F.col("name").alias("id"), "name", F.col("title").alias("description"), "sequence"]
    return df.select(*cols, *([phred("quality").alias("phred")] if "quality" in df.columns else []))


def write_fasta(df: DataFrame, path: str, wrap: int | None = 60, title: str = "title", seq: str = "sequence") -> None:
    df.select(format_fasta(title, seq, wrap).alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(format_fastq("title", "sequence", "quality").alias("value")).write.text(path)


def write_qual(df: DataFrame, path: str, wrap: int = 60) -> None:
    df.select(format_qual("title", "quality", wrap).alias("value")).write.text(path)
