"""URL filters: fixed rules, then association rules mined from labelled pages.

A URL becomes a set of tokens: the words of its host, between dots and hyphens, and path
segments without digits.  FP-growth mines frequent combinations over the labelled pages,
those marked bad carrying one more item.  Rules that conclude it are kept if they pass the least
support, as a share and as a number of bad pages, the least confidence, and a bound on chance: among the pages that hold
a rule's tokens there are more bad ones than all pages' share lets expect, by ``deviations`` standard deviations.
A rule whose tokens include all of another kept one's is dropped.  Rules are
held in an inverted index under one of their tokens, the rarest.  The tokens of each different URL
are looked up there, and a rule fires if all its tokens are in the set.

Only DataFrame operations and the JVM's FP-growth are used.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule
and is allowed.  Without labelled pages, or without rules that pass, the verdict is
``allow`` where no fixed rule fits.  A page whose label is null counts as not bad.  URLs of any length are read whole.
Of fixed rules of equal length only one can fit.  Repeated rows get the same verdict; columns of other
names are ignored.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import materialise

#: Verdict, host and path of the contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BAD = "=bad"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path, which replace columns of these names."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(text, PARTS, 1), UPPER, UPPER.lower()), "path": F.regexp_extract(text, PARTS, 2)})


def fitting(rules=RULES):
    """Struct of rule and verdict of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens():
    """Of host and path, a set without nulls or empty tokens."""
    words = F.split("host", "[.-]")
    segments = F.filter(F.split("path", "/"), lambda x: ~x.rlike("[0-9]"))
    tagged = F.concat(F.transform(words, lambda x: F.concat(F.lit("h:"), x)), F.transform(segments, lambda x: F.concat(F.lit("p:"), x)))
    return F.array_distinct(F.filter(tagged, lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, support: float, confidence: float, least: int, deviations: float) -> DataFrame:
    """rule_tokens, confidence, support of pruned rules; labelled: host, path, bad."""
    schema = "rule_tokens array<string>, confidence double, support double"
    spark = labelled.sparkSession
    bad = F.coalesce(F.col("bad"), F.lit(False))
    pages, share = labelled.agg(F.count(F.lit(1)), F.avg(bad.cast("double"))).first()
    if not pages or pages * share < least:
        return spark.createDataFrame([], schema)
    items = labelled.select(F.when(bad, F.array_append(tokens(), F.lit(BAD))).otherwise(tokens()).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, (least - 0.5) / pages), minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support")
    held = F.col("support") * pages / F.col("confidence")
    chance = (F.col("confidence") - share) * F.sqrt(held) >= deviations * (share * (1 - share)) ** 0.5
    rules = materialise(rules.where((F.round(F.col("support") * pages) >= least) & chance))
    return without_wider(rules)


def without_wider(rules: DataFrame) -> DataFrame:
    """The rules whose tokens don't include all of another's: that one fires as well.  Each rule is looked up under its first token."""
    first = rules.select(F.col("rule_tokens")[0].alias("token"), F.col("rule_tokens").alias("inner"))
    wide = rules.where(F.size("rule_tokens") > 1).select("rule_tokens", F.explode("rule_tokens").alias("token"))
    inside = (F.size("inner") < F.size("rule_tokens")) & (F.size(F.array_except("inner", "rule_tokens")) == 0)
    covered = wide.join(first, "token").where(inside).select("rule_tokens").distinct()
    return rules.join(covered, "rule_tokens", "left_anti")


def index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rules under their rarest token: token, rule_tokens, confidence."""
    held = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token"))
    frequency = labelled.select(F.explode(tokens()).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(frequency, "token").groupBy("rule_tokens").agg(F.min(F.struct("n", "token")).alias("r"), F.max("confidence").alias("confidence"))
    return rarest.select(F.col("r.token").alias("token"), "rule_tokens", "confidence")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, support: float = 0.002, confidence: float = 0.6, least: int = 10, deviations: float = 4.0) -> DataFrame:
    """pages with host, path, rule, verdict and the confidence of the mined rule that fired, if any.

    labelled: url, bad.
    """
    known = parsed(labelled.select("url", "bad"))
    mined = index(mine(known, support, confidence, least, deviations), known)
    rows = parsed(pages.drop("mined_confidence"))
    looked = rows.select("host", "path").distinct().withColumn("tokens", tokens())
    hits = looked.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(mined, "token")
    hits = hits.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).groupBy("host", "path").agg(F.max("confidence").alias("mined_confidence"))
    out = rows.join(hits, ["host", "path"], "left").withColumn("__fit", fitting(rules))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"))
    return out.withColumn("rule", F.col("__fit.rule")).withColumn("verdict", verdict).drop("__fit")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: pages whose id has a label; bad if it is of low quality or toxic."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("url", F.col("page_id").alias("doc_id")).join(known, "doc_id").select("url", "bad")
