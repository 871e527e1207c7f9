"""Operator 1: URL filtering by curated host rules and by mined association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import hot_join, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(rules: list[tuple[str, str]], host_col: str = "host", path_col: str = "path") -> Column:
    """The longest of the (verdict, rule) pairs that fits, as struct(rule, verdict); null if none.

    A rule is a host, then a path that starts at its first `/`. It fits the host and its subdomains
    if the url's path starts with the rule's.
    """
    h, p = F.col(host_col), F.col(path_col)
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        on_host = (h == name) | h.endswith(f".{name}")
        fits.append(F.when(on_host & p.startswith(f"/{rest}" if "/" in rule else ""), F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens: every domain suffix, words of the host, words of the path, query keys."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    suffixes = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))).otherwise(F.array().cast("array<string>"))
    inner = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), "-")  # the suffixes say the rest
    words = F.transform(F.filter(F.split(inner, "-"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.filter(F.split(F.lower(p), r"[/.\-_]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "[&;]"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    return F.coalesce(F.array_distinct(F.concat(suffixes, words, parts, keys)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.9, min_count: int = 20) -> DataFrame:
    """Rules from `labelled(url, verdict)`: columns rule_id, antecedent, verdict, confidence, support.

    FP-growth finds the frequent combinations of URL tokens and verdict; a rule is a combination
    that occurs in `min_support` of all urls, in `min_count` of them at least, and in `min_confidence` of its occurrences
    goes with one verdict. Urls with a null verdict are unlabelled: they count among the occurrences
    of their tokens, but for no verdict. Rare tokens can't be in any rule and are dropped first.
    """
    own = tokens(F.col("url"))
    rows = labelled.where("url is not null").select(F.when(F.col("verdict").isNull(), own).otherwise(F.array_append(own, F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items"))
    n = rows.count()
    min_support = min(1.0, max(min_support, min_count / max(n, 1)))
    common = rows.select(F.explode("items").alias("t")).groupBy("t").count().where(F.col("count") >= max(1.0, min_support * n))
    # at most (mean tokens of a url) / min_support tokens can be this frequent
    kept = [r["t"] for r in common.select("t").collect()]
    slim = rows.select(F.array_intersect("items", F.array(*map(F.lit, kept)) if kept else F.array().cast("array<string>")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(slim).associationRules
    rules = found.where(F.col("consequent")[0].startswith("verdict:") & ~F.exists("antecedent", lambda x: x.startswith("verdict:"))).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 9, 1 << 20).alias("verdict"), "confidence", "support"
    ).withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    return pruned(staged(rules, "url-rules"))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that add tokens to a rule of the same verdict and no lower confidence."""
    need = F.size("antecedent")
    small = rules.select(F.explode("antecedent").alias("token"), "verdict", F.col("rule_id").alias("small"), need.alias("need"), F.col("confidence").alias("sure"))
    large = rules.select(F.explode("antecedent").alias("token"), "verdict", "rule_id", need.alias("n"), "confidence")
    inside = large.join(small, ["token", "verdict"]).where((F.col("need") < F.col("n")) & (F.col("sure") >= F.col("confidence")))
    idle = inside.groupBy("rule_id", "small", "need").count().where("count = need").select("rule_id").distinct()
    return rules.join(idle, "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds mined_verdict and mined_rule to `urls`, by an inverted index over the rules' tokens.

    `urls` has page_id and url. A rule fires if the url has all its tokens; highest confidence, then support, then more
    tokens, then the smaller antecedent decide. Urls are first reduced to the set of tokens that
    occur in rules, so each distinct set is looked up once, however many urls have it.
    """
    rules = rules.select("rule_id", "antecedent", "verdict", "confidence", "support")
    used = [r["t"] for r in rules.select(F.explode("antecedent").alias("t")).distinct().collect()]  # bounded as in mine()
    known = F.array(*map(F.lit, used)) if used else F.array().cast("array<string>")
    keyed = urls.withColumn("_set", F.array_sort(F.array_intersect(tokens(F.col("url")), known)))
    index = rules.select(F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("need"))
    fired = (
        keyed.select("_set").distinct().select("_set", F.explode("_set").alias("token")).join(index, "token")
        .groupBy("_set", "rule_id", "need").count().where("count = need").join(rules, "rule_id")
        .groupBy("_set").agg(F.min_by(F.struct("verdict", "antecedent"), F.struct(-F.col("confidence"), -F.col("support"), -F.col("need"), "antecedent")).alias("_best"))
    )
    # one token set may belong to a third of all urls
    return hot_join(keyed, fired, ["_set"], ["page_id", "url"], "left").withColumn("mined_verdict", F.coalesce("_best.verdict", F.lit(default))).withColumn("mined_rule", F.array_join("_best.antecedent", " ")).drop("_set", "_best")


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule for every row of `pages(page_id, url)`.

    The longest curated rule decides. For the other urls the mined rules decide, learned from
    `labels(url, verdict)`, or, without labels, from all urls: those that a curated rule fits have its
    verdict, the others are unlabelled, so that what curated rules say of a few urls isn't carried
    over to hosts or paths that most urls share without being judged. Where none fires the verdict
    is allow. Null urls and urls without `://` have empty host and path and
    are allowed; very long urls are read whole; repeated rows count and are judged one by one, alike; ties
    between rules are settled in match(); on an empty table nothing is mined. Other columns, whatever
    their names, are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("fit", curated(rules))
    labelled = labels.where("verdict is not null") if labels is not None else rows.select("url", "fit.verdict")
    judged = match(rows, mine(labelled, **limits))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined_verdict").alias("verdict"), F.when(F.col("fit").isNull(), F.nullif(F.coalesce("mined_rule", F.lit("")), F.lit(""))).alias("mined_rule"))
