"""URL filters: fixed host and path rules, then association rules mined from labels by FP-growth (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import Scratch, salted_join

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A rule holds this share of the labelled urls at least, and so many of them; the confidence is that which is likely (19 in 20) to be exceeded on other urls.
SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.6
BLOCK = "!block"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null: it names the host or a domain above it, and the path begins with its path."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Different tokens of a url: labels of the host, steps of the path, names in the query."""
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(host, path, F.coalesce(query, F.array().cast("array<string>"))), lambda x: F.length(x) > 2))


def likely_confidence(hits: Column, of: Column) -> Column:
    """The lower end of the 90 % score interval of a share."""
    z = 1.645
    p = hits / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules (tokens, token, confidence, support) from urls with a verdict; `token` is the rarest of a rule's. labelled: url, block (boolean).

    FP-growth finds token combinations that hold at least `support` of the labelled urls, and `least` of them; of the rules that they block, those stay whose likely confidence
    reaches the bound, but for rules that a rule on fewer of their tokens, at least as sure, makes needless.

    Cases: null urls or verdicts, and urls without tokens, teach nothing. Repeated rows teach once each. Fewer urls than `least`: no rules. Empty table: no rules."""
    spark = labelled.sparkSession
    baskets = labelled.where("url IS NOT NULL AND block IS NOT NULL").select(url_tokens(F.col("url")).alias("own"), "block")
    baskets = Scratch(spark).keep(baskets.select("own", F.concat("own", F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")))
    n = baskets.count()
    if n < max(least, 1):
        return spark.createDataFrame([], "tokens array<string>, token string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    hits = F.round(F.col("support") * n)
    rules = rules.withColumn("confidence", likely_confidence(hits, F.round(hits / F.col("confidence")))).where(F.col("confidence") >= confidence)
    counts = baskets.select(F.explode("own").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    rarest = rules.select("tokens", F.explode("tokens").alias("t")).join(counts, "t").groupBy("tokens").agg(F.min_by("t", F.struct("n", "t")).alias("token"))
    rules = Scratch(spark).keep(rules.join(rarest, "tokens").select("tokens", "token", "confidence", "support"))
    more, less = rules.select(F.explode("tokens").alias("token"), "tokens", "confidence"), rules.select("token", F.col("tokens").alias("l"), F.col("confidence").alias("c"))
    needless = more.join(less, "token").where((F.size("l") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("l", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(needless, "tokens", "left_anti")


def mined_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Different `url`s that a mined rule fits, with the greatest `confidence`. An inverted index lists each rule under its rarest token; a url meets only the rules under its own."""
    own = urls.select("url").distinct().withColumn("_own", url_tokens(F.col("url")))
    met = own.select("url", "_own", F.explode("_own").alias("token")).join(rules, "token").where(F.size(F.array_except("tokens", "_own")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that decided; else null) of each row of `pages`.

    A fixed rule decides where one fits; else a url that a mined rule fits is blocked and any other allowed. A labelled page teaches a block if its label says low quality or toxic.

    Cases: null url or one without "://": host and path empty, allowed unless mined. Repeated rows: judged alike. Labels without page: teach nothing; no labels: no mined rules.
    Empty table: no rows. Other columns are ignored."""
    own = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.select(F.col(label_id).alias("page_id"), bad.alias("block"))
    scratch = Scratch(pages.sparkSession)
    rules = scratch.keep(mine(own.join(known, "page_id").select("url", "block"), least=least))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("_fixed", fixed_rule(F.col("host"), F.col("path")))
    open_ = F.col("_fixed").isNull() & F.col("url").isNotNull()
    rest = own.where(open_)
    counts = rest.groupBy("url").agg(F.count("*").alias("n"))
    found = scratch.keep(mined_matches(rest, rules))
    # a url that many pages have is dealt over many tasks
    mined = salted_join(rest, found, ["url"], "page_id", counts, rest.agg(F.count("*")).scalar(), "left").select(*own.columns, "confidence")
    own = own.where(~open_).withColumn("confidence", F.lit(None).cast("double")).union(mined)
    verdict = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return own.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", verdict).alias("verdict"), "confidence")
