"""URL filter by association rules, with DataFrame operations only.

Spark's FP-growth mines frequent combinations of URL tokens and a class token from labelled pages. Rules that name a
class and reach the confidence, support and lift asked for are put into an inverted index under their rarest
token. A URL looks up its tokens and keeps the rules whose other tokens it has too; the best one decides. Fixed rules
for a host (with its subdomains) and a path prefix come first.

Tokens that occur on the same labelled pages, such as the parts of one template, are mined as one item; a rule with such
an item stands for the rules of all its parts, and a URL that has only some of them gets the longest rule it fits.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import keep

#: Fixed rules: host and path prefix, verdict.
HOUSE_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BLOCK, ALLOW = "y:block", "y:allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def house_rule(host: Column, path: Column, rules=HOUSE_RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda item: len(item[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: host labels, path parts, query parts, fragment; runs of digits count as one sign."""
    def parts(text: Column, sign: str, kind: str) -> Column:
        full = F.filter(F.split(text, sign), lambda part: part != "")
        return F.transform(full, lambda part: F.concat(F.lit(kind), F.regexp_replace(part, "[0-9]+", "#")))

    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    fragment = F.coalesce(F.regexp_extract(url, r"#([\s\S]*)", 1), F.lit(""))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                parts(host_of(url), r"\.", "h:"), parts(path_of(url), "/", "p:"), parts(query, "&", "q:"), parts(fragment, "#", "f:")
            )
        )
    )


def token_groups(tokens: DataFrame, min_support: float) -> DataFrame:
    """``token, item`` of the frequent tokens; tokens on the same rows share an item, the first of them by name.

    Same rows: equal counts and equal sums of two hashes of the rows. At most tokens per row over ``min_support`` rows.
    """
    def mark(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64("tokens", F.lit(seed)), F.lit(1 << 31)))

    least = F.ceil(F.lit(min_support) * F.lit(tokens.count()))
    seen = tokens.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"), mark(1).alias("a"), mark(2).alias("b")
    ).where(F.col("freq") >= least)
    groups = seen.groupBy("freq", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select("freq", F.col("members")[0].alias("item"), "members")


def mine_rules(tokens: DataFrame, min_support: float = 0.005, min_confidence: float = 0.4, min_lift: float = 1.1) -> DataFrame:
    """``rule_id, anchor, needs, verdict, confidence, support`` from rows of ``tokens`` and ``class``.

    ``needs`` lists items, each the array of its tokens; a rule may have any number of them. ``anchor`` is the array of the rarest
    item. The support bound also bounds what FP-growth keeps: at most tokens per row over ``min_support`` frequent items.
    """
    groups = keep(token_groups(tokens, min_support))
    shapes = tokens.select("tokens").distinct().select("tokens", F.explode("tokens").alias("item"))
    items = shapes.join(groups.select("item"), "item", "left_semi").groupBy("tokens").agg(F.collect_list("item").alias("found"))
    baskets = tokens.join(items, "tokens", "left").select(
        F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array("class")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW)).where(f"lift >= {min_lift}").select(
        F.array_join(F.array_sort("antecedent"), " ").alias("mined"), "antecedent",
        F.substring(F.col("consequent")[0], 3, 16).alias("verdict"), "confidence", "support",
    )
    whole = rules.select("mined", F.explode("antecedent").alias("item")).distinct().join(groups, "item").groupBy("mined").agg(
        F.array_sort(F.collect_list("members")).alias("needs"), F.min(F.struct("freq", "item", "members"))["members"].alias("anchor")
    )
    rules = rules.drop("antecedent").join(whole, "mined").drop("mined")
    return keep(rules.withColumn("rule_id", F.array_join(F.array_sort(F.flatten("needs")), " ")))


def match_rules(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """``shape, best`` for rows of ``shape`` and ``tokens`` that some rule fits.

    A rule fits with at least one token of each of its items. The best rule has the highest confidence, then support, then
    most tokens, then the first name in order.
    """
    index = rules.withColumn("token", F.explode("anchor"))
    looked_up = shapes.select("shape", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fitting = looked_up.where(F.forall("needs", lambda item: F.arrays_overlap(item, F.col("tokens")))).withColumn(
        "used", F.array_sort(F.array_intersect("tokens", F.flatten("needs")))
    )
    rank = F.struct(
        (-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), (-F.size("used")).alias("c"),
        F.array_join("used", " ").alias("rule_id"), "verdict", "confidence",
    )
    return fitting.groupBy("shape").agg(F.min(rank).alias("best"))


def judge(
    pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=HOUSE_RULES, **mining
) -> DataFrame:
    """``page_id, host, path, rule, verdict, learned_rule, confidence`` for every row.

    ``labels`` (doc_id, quality, toxic) teaches: a page whose id has a label counts as bad when any of its labels
    says quality 0 or toxic 1, rows without a value say nothing. Where neither a house rule nor a learned rule
    fits, the verdict is allow. A null URL, or one without ``://``, has empty host and path and no tokens. Rows are
    judged one by one: repeated ids and null ids stay as they are; empty labels just teach nothing.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select(
        "id", host_of(url).alias("host"), path_of(url).alias("path"),
        F.when(F.contains(url, F.lit("://")), url_tokens(url)).otherwise(F.array().cast("array<string>")).alias("tokens"),
    ).withColumn("shape", F.array_join("tokens", "\u0001"))
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    ).where("bad is not null")
    taught = rows.join(bad, rows["id"] == bad["doc_id"]).select("tokens", F.when(F.col("bad"), BLOCK).otherwise(ALLOW).alias("class"))
    mined = mine_rules(taught, **mining)
    # URLs of one site share a few shapes, so a hot site is looked up once per shape.
    best = match_rules(rows.select("shape", "tokens").distinct(), mined)
    found = rows.join(best, "shape", "left").withColumn("house", house_rule(F.col("host"), F.col("path"), rules))
    return found.select(
        F.col("id").alias(id_column), "host", "path", F.col("house.rule").alias("rule"),
        F.coalesce("house.verdict", "best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.rule_id").alias("learned_rule"), F.col("best.confidence").alias("confidence"),
    )
