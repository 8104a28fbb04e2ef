"""URL filtering by host and path rules, and by mined association rules.

Fixed rules decide first (longest fitting rule).  For all other urls, Spark's
FP-growth mines combinations of URL tokens from the bad pages; the rules
"tokens -> bad" that keep enough evidence and confidence are matched
through an inverted index keyed by each rule's rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read
from treeline.llm.registry import register

#: Fixed values: (verdict, host, path) of the rules that the query applies.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn(
        "path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def fixed_rule(rules=RULES) -> Column:
    """Struct of the longest rule that fits host and path and its verdict; null without one.  Of equally long rules, the first in the list wins."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens() -> Column:
    """Distinct tokens of a url: parts of its host, of its path (numbers as one token) and names of its query."""
    host = F.transform(F.split("host", r"[.]"), lambda x: F.concat(F.lit("host:"), x))
    path = F.transform(F.split(F.lower("path"), "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.transform(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.filter(F.array_distinct(F.concat(host, path, query)), lambda x: ~F.endswith(x, F.lit(":")))


def mine(pages: DataFrame, labels: DataFrame, min_confidence: float = 0.6, min_count: int = 5) -> DataFrame:
    """Rules ``antecedent`` (array of tokens), confidence, support and
    ``pivot`` (its rarest token), mined from all labelled pages.

    ``pages``: page_id, url; ``labels``: doc_id (a page_id), quality, toxic;
    quality 0 or toxic 1 is bad, nulls count as neither.  A rule stays if its
    tokens lie in at least ``min_count`` bad pages and the lower end of the
    95 % interval of its confidence reaches ``min_confidence``, whatever else
    is labelled: combinations are mined from the bad pages by their count,
    and counted over all pages after that.  No labels: no rules.
    """
    spark = pages.sparkSession
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    marked = with_parts(pages.select("page_id", "url")).join(bad, F.col("page_id") == F.col("doc_id")).select(
        tokens().alias("items"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    marked = materialize(marked.where(F.size("items") > 0), "stage")
    n, n_bad = marked.agg(F.count("*"), F.sum("bad")).first()
    if not n or n_bad < min_count:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, pivot string")
    # half a page below the count, as the product is rounded up again
    fitted = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n_bad).fit(marked.where("bad = 1").select("items"))
    sets = materialize(fitted.freqItemsets.select(F.sort_array("items").alias("antecedent"), F.col("freq").alias("hits")), "stage")
    # urls of one form are counted once; a form meets the index at a combination's rarest token only
    forms = materialize(marked.groupBy(F.sort_array("items").alias("items")).agg(F.count("*").alias("n")), "stage")
    alone = forms.select("n", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n").alias("freq"))
    pivot = (sets.select("antecedent", F.explode("antecedent").alias("token")).join(alone, "token")
             .groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("least")))
    index = materialize(sets.join(pivot, "antecedent").select("antecedent", "hits", F.col("least.token").alias("pivot")), "stage")
    asked = forms.select("items", "n", F.explode("items").alias("pivot"))
    held = asked.join(index, "pivot").where(F.size(F.array_except("antecedent", "items")) == 0)
    counted = held.groupBy("antecedent", "hits", "pivot").agg(F.sum("n").alias("seen"))
    z, p, seen = 1.96, F.col("hits") / F.col("seen"), F.col("seen")
    lower = (p + z * z / (2 * seen) - z * F.sqrt(p * (1 - p) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)
    return counted.where(lower >= min_confidence).select("antecedent", p.alias("confidence"), (F.col("hits") / n).alias("support"), "pivot")


def matched_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls (url, reason: the matching rule of highest confidence, tokens
    joined by spaces) that hold all tokens of a rule: pages meet the index at the rule's pivot only."""
    urls = with_parts(pages.where("url is not null").select("url").distinct()).select("url", tokens().alias("tokens"))
    asked = urls.select("url", "tokens", F.explode("tokens").alias("pivot"))
    found = asked.join(rules, "pivot").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("reason")))
    return found.groupBy("url").agg(best.alias("best")).select("url", F.col("best.reason").alias("reason"))


def judge(pages: DataFrame, mined: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, reason`` for every row of
    ``pages`` (page_id, url).  rule: the fixed rule (host and path joined),
    null without one; verdict: its verdict, else block if a mined rule
    matches, else allow.  Null urls have empty host and path and are allowed;
    repeated rows stay.  Other columns don't matter."""
    own = with_parts(pages.select("page_id", "url")).withColumn("fixed", fixed_rule(rules))
    found = matched_urls(own.where("fixed is null"), mined)
    return own.join(found, "url", "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("reason").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("reason")).alias("reason"))


@register("op9_url_rules")
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(pages, read(spark, sf_dir, "labels")))
