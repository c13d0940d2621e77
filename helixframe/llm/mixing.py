"""Mixing sources to target weights by hierarchical budgets.

Weights run down a tree domain -> language -> source. A node's budget is shared among its children by weight; a child that
holds less than its share (its tokens times the epochs allowed) is filled, and what it lacks goes to its siblings, so a
shortage moves to the level above only when all siblings are full. Each leaf then takes whole epochs and a prefix of
one more, in an order seeded per epoch. The prefix is found by two sums: token totals of hash ranges give the range that the budget
ends in, and only that range is summed place by place. What results is one row a leaf, its epochs and the place that the prefix ends
at; documents are then chosen in their own scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small

#: Target weights: domain -> (weight, language -> (weight, source -> weight)); names not listed weigh DEFAULT.
DEFAULT = 1.0
WEIGHTS: dict = {
    "web": (0.4, {"en": (0.55, {}), "de": (0.15, {}), "fr": (0.15, {}), "es": (0.15, {})}),
    "books": (0.35, {"en": (0.4, {}), "de": (0.2, {}), "fr": (0.2, {}), "es": (0.2, {})}),
    "forum": (0.25, {}),
}
#: Leaves are few by design (named targets); more than this is taken for a wrong key.
MOST_LEAVES = 1_000_000


def domain_of(source: Column) -> Column:
    """The domain of a source name: src0 is the web crawl, src1 to src9 are books, all others the forum."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "books").otherwise("forum")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fill(budget: int, caps: list[int], weights: list[float]) -> list[int]:
    """Shares of budget by weight, none above its cap; what full ones lack goes to the others. Whole tokens."""
    got = [0] * len(caps)
    open_ = [i for i in range(len(caps)) if caps[i] > 0 and weights[i] > 0]
    left = min(budget, sum(caps[i] for i in open_))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] <= left * weights[i] / total]
        if not full:
            share = {i: int(left * weights[i] / total) for i in open_}
            rest = left - sum(share.values())
            for i in sorted(open_, key=lambda i: (share[i] - left * weights[i] / total, i)):
                step = min(max(rest, 0), 1, caps[i] - share[i])
                got[i], rest = share[i] + step, rest - step
            return got
        for i in full:
            got[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(leaves: dict[tuple[str, str, str], int], weights: dict, total: int, epochs: int) -> dict[tuple[str, str, str], int]:
    """Token budget of each leaf (domain, language, source) with the given tokens."""

    def of(node: dict, name: str) -> tuple[float, dict]:
        x = node.get(name, DEFAULT)
        return x if isinstance(x, tuple) else (x, {})

    def down(prefix: tuple, node: dict, budget: int) -> dict:
        level = len(prefix)
        inside = {k: v for k, v in leaves.items() if k[:level] == prefix}
        if level == 3:
            return {prefix: min(budget, room({prefix: inside.get(prefix, 0)}, level, node))}
        names = sorted({k[level] for k in inside})
        caps = [room({k: v for k, v in inside.items() if k[level] == n}, level + 1, of(node, n)[1]) for n in names]
        out: dict = {}
        for n, b in zip(names, _fill(budget, caps, [of(node, n)[0] for n in names])):
            out |= down((*prefix, n), of(node, n)[1], b)
        return out

    def room(inside: dict, level: int, node: dict) -> int:
        """Tokens that the leaves inside a node can take: those below a weight of 0 take none."""
        if level == 3:
            return sum(inside.values()) * epochs
        names = {k[level] for k in inside}
        return sum(room({k: v for k, v in inside.items() if k[level] == n}, level + 1, of(node, n)[1]) for n in names if of(node, n)[0] > 0)

    return down((), weights, total)


def plan(spark: SparkSession, docs: DataFrame, weights: dict = WEIGHTS, total: int | None = None, ratio: float = 0.6, epochs: int = 2, seed: int = 7, domain=domain_of) -> tuple[DataFrame, DataFrame]:
    """(documents, leaves): what mix() and mixed() decide by.

    documents: doc_id, leaf (three columns), mix_tokens, mix_place. leaves: the leaf, full (whole epochs), edge and last: the
    prefix of the last epoch takes the hash ranges below edge and in it the places up to last.
    """
    light = cut(spark, _placed(docs, seed, domain).select("doc_id", *LEAF, n_words(F.col("text").cast("string")).alias("mix_tokens"), "mix_place"), "light")
    rows = light.groupBy(*LEAF).agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    tokens = {(r[0], r[1], r[2]): int(r.t) for r in rows}
    want = total if total is not None else int(ratio * sum(tokens.values()))
    shares = budgets(tokens, weights, want, epochs)
    n_rows = max((r.n for r in rows), default=0)
    width = max(8, (max(1, n_rows // 20_000)).bit_length() + 4)  # hash ranges per leaf follow the largest leaf
    table = [(*k, (b // tokens[k]) if tokens[k] else 0, b - (b // tokens[k]) * tokens[k] if tokens[k] else 0, width) for k, b in shares.items()]
    budget = spark.createDataFrame(table, "mix_domain string, mix_lang string, mix_source string, full long, rest long, width int")
    put = light.join(small(budget.where("rest > 0"), len(table), 200), LEAF).withColumn("range", _range(F.lit(width)))
    totals = put.groupBy(*LEAF, "range").agg(F.sum("mix_tokens").alias("t"), F.first("rest").alias("rest"))
    run = F.sum("t").over(W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    edges = totals.withColumn("upto", run).where("upto > rest").groupBy(*LEAF).agg(F.min_by(F.struct(F.col("range").alias("edge"), (F.col("upto") - F.col("t")).alias("before")), "range").alias("e"))
    edges = cut(spark, edges.select(*LEAF, "e.*"), "edges")
    # equal rows stand at one place: summed before they meet, taken together or not at all
    inside = put.join(small(edges, len(table), 200), LEAF).where(F.col("range") == F.col("edge")).groupBy(*LEAF, "mix_place").agg(F.sum("mix_tokens").alias("t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum("t").over(W.partitionBy(*LEAF).orderBy("mix_place").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("c", upto).where(F.col("c") <= F.col("rest")).groupBy(*LEAF).agg(F.max("mix_place").alias("last"))
    ends = budget.join(edges.select(*LEAF, "edge"), LEAF, "left").join(last, LEAF, "left")
    return light, small(cut(spark, ends, "ends"), len(table), 300)


LEAF = ["mix_domain", "mix_lang", "mix_source"]


def _placed(docs: DataFrame, seed: int, domain) -> DataFrame:
    """docs with the leaf and the place in the seeded order; the columns are appended, whatever names docs has."""
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    text = F.xxhash64("text")
    place = F.struct(F.xxhash64(F.lit(seed), "doc_id", text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("i"), text.alias("t"))
    return docs.withColumns({"mix_domain": domain(source), "mix_lang": lang, "mix_source": source, "mix_place": place})


def _range(width: Column) -> Column:
    return F.call_function("shiftright", F.col("mix_place.h"), F.lit(64) - width)


def _copies() -> Column:
    """Whole epochs, and one more for places of the prefix."""
    at = _range(F.col("width"))
    taken = F.col("edge").isNull() | (at < F.col("edge")) | ((at == F.col("edge")) & F.coalesce(F.col("mix_place") <= F.col("last"), F.lit(False)))
    return F.col("full") + ((F.col("rest") > 0) & taken).cast("long")


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Per chosen document: doc_id, mix_domain, mix_lang, mix_source, mix_tokens, mix_copies (epochs that it takes part in).

    Options are those of plan(). The budget is `total` tokens (words), or `ratio` times those of docs. A leaf's last epoch is
    the longest prefix of its seeded order within the budget, so a leaf falls short by less than what stands at its next place;
    rows that agree in leaf, doc_id and text stand at one place. A null lang or source counts as ''; null or empty texts have no
    tokens and are taken with their place; null and repeated doc_ids are rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    light, ends = plan(spark, docs, **options)
    return light.join(ends, LEAF).withColumn("mix_copies", _copies()).where("mix_copies > 0").select("doc_id", *LEAF, "mix_tokens", "mix_copies")


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 7, domain=domain_of, **options) -> DataFrame:
    """The chosen documents themselves, with the columns of docs: a row for each epoch that takes one.

    The cases of mix() hold. Each row is judged in its scan by the ends of its leaf's prefix; texts are not moved. Columns of docs
    named mix_* are kept.
    """
    _, ends = plan(spark, docs, seed=seed, domain=domain, **options)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), *[F.col(c) for c in ("doc_id", "text", "lang", "source")])
    chosen = _placed(row, seed, domain).join(ends, LEAF).withColumn("mix_copies", _copies()).where("mix_copies > 0")
    return chosen.withColumn("mix_epoch", F.explode(F.expr("sequence(1L, mix_copies)"))).select("mix_row.*")
