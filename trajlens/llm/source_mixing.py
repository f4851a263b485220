"""Mixing sources to target weights over a tree of domains, languages and sources, with DataFrame operations only.

Every node's budget is its parent's budget by weight; a node that cannot use its share (its documents times the
epochs allowed) leaves the rest to its siblings by their weights. A node's capacity is the sum below it, so shortages
are made up among siblings first, and reach the next level only when a whole subtree is used up.

A leaf's budget is met by whole epochs and the token prefix of one more epoch. Each epoch has an order of its own: an
md5 of seed, epoch and id. The prefix is found without sorting a leaf: tokens are summed in 4096 ranges of the hash, and
only the rows of the range in which the budget ends are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.common import discard, keep, packed, unpacked

LEVELS = ("domain", "lang", "source")
#: Leaf tables up to this many rows (a few MB) are broadcast, larger ones are joined by shuffle.
BROADCAST_LEAVES = 20_000
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def domain_of(source: Column) -> Column:
    """Three domains from the number at the end of a source's name; no number: other."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 3).cast("string")))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("double")


def _shared_out(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Water-filling: add ``budget`` to children with ``cap``, ``weight`` and the parent's ``given``."""
    window = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = window.orderBy(F.col("cap") / F.col("weight"), F.col(level))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = children.withColumn("rate", (F.col("given") - before).cast("double") / rest)
    full = F.col("rate") >= F.col("cap") / F.col("weight")
    # Among children that are not full, the first in order has the largest rate: the common one.
    common = F.max(F.when(~full, F.col("rate"))).over(window)
    return rated.withColumn(
        "budget", F.when(full, F.col("cap")).otherwise(F.floor(F.greatest(common, F.lit(0.0)) * F.col("weight")).cast("long"))
    ).drop("rate")


def leaf_budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """Budget in tokens of each leaf (``domain, lang, source, tokens``); shares are rounded down to whole tokens.

    One row per node of the tree is all that is handled here.
    """
    sized = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = leaves.select(total.cast("long").alias("given"))
    current = sized.groupBy("domain").agg(F.sum("cap").alias("cap"))
    whole = given.agg(F.max("given").alias("given")).withColumn("_one", F.lit(1))
    current = _shared_out(
        current.withColumn("_one", F.lit(1)).join(whole, "_one").drop("_one").withColumn("weight", _weight("domain", weights)), [], "domain"
    )
    parent = ["domain"]
    for level in LEVELS[1:]:
        up = current.select(*parent, F.col("budget").alias("given"))
        here = sized.groupBy(*parent, level).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        current = _shared_out(here.join(up, parent).withColumn("weight", _weight(level, weights)), parent, level)
        parent = [*parent, level]
    return current.select(*LEVELS, "tokens", "budget")


def _draw(seed: int, epoch: Column, id_column: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_column.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float = 1.0, epochs: int = 2, seed: int = 7,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
    carry: bool = False,
) -> DataFrame:
    """Rows drawn, one per document and epoch: ``domain, lang, source, id, epoch, tokens, tokens_taken``.

    ``weights`` maps a level (domain, lang, source) to whole weights of values; others weigh 1. The target is
    ``share`` of all tokens (words between white space). ``tokens_taken`` is less than ``tokens`` only for the
    document in which a leaf's budget ends. Null languages and sources are a branch of their own, named ''. Texts
    without words, or null, are never drawn. Rows that repeat an id are ordered by their tokens and text. With
    ``carry`` the packed input row comes along as ``_row``.
    """
    text = F.col("_text")
    rows = docs.select(
        *([packed(docs)] if carry else []), F.col(id_column).alias("_id"), F.col(text_column).alias("_text"),
        domain_of(F.col(source_column)).alias("domain"), F.coalesce(F.col(lang_column), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_column), F.lit("")).alias("source"),
    ).withColumn("tokens", F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")).withColumn(
        "tie", F.md5(F.coalesce(text, F.lit("")))
    ).drop("_text").where("tokens > 0")
    # Without the text these rows are small; they are read three times.
    narrow = keep(rows.select("_id", *LEVELS, "tokens", "tie"))
    summed = keep(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    everything = summed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    leaves = leaf_budgets(summed, F.lit(int(everything * share)), weights, epochs)
    leaves = keep(
        leaves.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
        .withColumn("part", F.col("budget") - F.col("full") * F.col("tokens"))
    )
    small = leaves.count() <= BROADCAST_LEAVES

    def with_leaf(frame: DataFrame, table: DataFrame) -> DataFrame:
        table = table.drop("tokens")
        placed = frame.join(F.broadcast(table) if small else table, list(LEVELS))
        return placed.withColumn("hash", _draw(seed, F.col("full"), F.col("_id"))).withColumn("range", F.substring("hash", 1, 3))

    ranges = with_leaf(narrow, leaves).groupBy(*LEVELS, "part", "range").agg(F.sum("tokens").alias("held"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    # At most 4096 rows of each leaf are summed up here.
    last = ranges.withColumn("before", F.sum("held").over(upto) - F.col("held")).where("before < part and before + held >= part")
    leaves = keep(leaves.join(last.select(*LEVELS, F.col("range").alias("last"), "before"), list(LEVELS), "left"))
    placed = with_leaf(rows, leaves)
    columns = ["_row"] * carry + [*LEVELS, "_id", "tokens"]
    whole = placed.withColumn("copies", F.col("full") + F.coalesce(F.col("range") < F.col("last"), F.lit(False)).cast("long")).where(
        "copies > 0"
    ).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"), F.col("tokens").alias("tokens_taken"))
    inside = Window.partitionBy(*LEVELS, "range").orderBy("hash", "_id", "tokens", "tie")
    edge = (
        placed.where("range = last")
        .withColumn("start", F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .where("start < part")
        .select(*columns, F.col("full").alias("epoch"), F.least(F.col("tokens"), F.col("part") - F.col("start")).alias("tokens_taken"))
    )
    discard(summed)
    return whole.unionByName(edge).withColumnRenamed("_id", id_column)


def mixed_rows(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], **options) -> DataFrame:
    """The drawn rows with the columns of ``docs``, once per epoch drawn, each with its whole text."""
    return unpacked(mix(docs, weights, carry=True, **options), docs.columns)
