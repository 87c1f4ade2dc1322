"""URL filters: fixed host and path rules, and association rules of URL tokens mined from labels.

FP-growth mines combinations of a URL's tokens with the label of its page; rules that a token combination
implies `block` or `allow` are pruned by support, confidence and lift, and matched by an inverted index from
each rule's rarest token. All rules that pass are kept, in a table that is joined with the tokens of the distinct URLs.

A url that is null or has no `://` has empty host and path, fits no rule and is judged by the mined rules
(which have no token of it: `allow`). Repeated rows each give a row. Pages without labels only take part in matching.
Empty labels give no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (verdict, host, path) as the contract lists them.
FIXED_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "label=block", "label=allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(of + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Host labels, path words, file ending, names of query parameters, and whether there is a fragment."""
    words = lambda text, by: F.filter(F.split(text, by), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    tag = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    return F.array_distinct(
        F.coalesce(
            F.concat(
                tag("host=", words(host_of(url), r"\.")),
                tag("path=", words(F.regexp_replace(path, r"\.[A-Za-z]{1,5}$", ""), "/")),
                tag("end=", F.filter(F.array(ending), lambda x: x != "")),
                tag("query=", F.transform(words(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
                F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
            ),
            F.array().cast("array<string>"),
        )
    )


def mine(pages: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, min_lift: float) -> DataFrame:
    """token, rules: all rules that pass (antecedent, confidence, whether it blocks), under the antecedent's rarest token."""
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    items = F.array_append(url_tokens(F.col("url")), F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    known = pages.select("page_id", "url")
    baskets = known.join(bad, known["page_id"] == bad["doc_id"]).filter("url is not null").select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.array_contains(F.array(F.lit(BLOCK), F.lit(ALLOW)), F.col("consequent")[0]) & (F.col("lift") >= min_lift))
    singles = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rule = F.struct(F.col("antecedent").alias("all"), "confidence", (F.col("consequent")[0] == BLOCK).alias("block"))
    rarest = (
        found.select("antecedent", "consequent", rule.alias("rule"), F.explode("antecedent").alias("token")).join(singles, "token")
        .groupBy("antecedent", "consequent").agg(F.min_by("token", F.struct("freq", "token")).alias("token"), F.first("rule").alias("rule"))
    )
    return written(rarest.groupBy("token").agg(F.collect_list("rule").alias("rules")), "url-rules")


def mined_blocks(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values of `url` where the surest rule that matches blocks."""
    tokens = urls.filter("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    listed = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
    matched = F.filter("rules", lambda r: F.size(F.array_except(r["all"], F.col("tokens"))) == 0)
    best = F.array_max(F.transform(matched, lambda r: F.struct(r["confidence"].alias("confidence"), r["block"].alias("block"))))
    return listed.select("url", best.alias("best")).groupBy("url").agg(F.max("best").alias("best")).filter("best.block").select("url")


def judge(pages: DataFrame, labels: DataFrame, fixed=FIXED_RULES, min_support: float = 0.005, min_confidence: float = 0.5, min_lift: float = 1.05) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    name, verdict = fixed_rule(host, path, fixed)
    rows = pages.select("page_id", "url")
    blocks = mined_blocks(rows.filter(verdict.isNull()), mine(pages, labels, min_support, min_confidence, min_lift))
    judged = rows.join(blocks.select(url.alias("_blocked")), url == F.col("_blocked"), "left")
    mined = F.when(F.col("_blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", host.alias("host"), path.alias("path"), name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
