"""URL filter in DataFrame functions: rules first, a trained score for the rest.

A rule names a host and the start of a path; it fits that host and all its
subdomains, and the longest fitting rule decides. Other URLs are judged by a
logistic regression on hashed character n-grams of host and path, trained
with Spark ML from a small labelled table. Its weights (``BUCKETS`` numbers)
become a literal array, so scoring is one projection over the ``url`` column,
without a shuffle and without Python on the executors.

Defined edge results: a NULL url or one without '://' has an empty host and
path, fits no rule and gets the model's verdict on the empty text; repeated
rows are judged alike; an empty table gives an empty result; other columns
are ignored. URLs of any length are scored whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innlytics.llm import url_table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
BUCKETS = 1024
SIZES = (3, 4, 5)
ALLOW_WEIGHT = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(urls: DataFrame) -> DataFrame:
    """Add host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest) + 1)
    return urls.select("*", F.translate(host, UPPER, LOWER).alias("host"),
                       F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # longer ones overrule
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams() -> Column:
    """Buckets of the character n-grams of host and path."""
    text = F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$"))
    def of(n: int) -> Column:  # a lambda with a second parameter would get the index there
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                           lambda i: F.pmod(F.xxhash64(text.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of(n) for n in SIZES])


def train(labelled: DataFrame, reg: float = 0.01, allow_weight: float = ALLOW_WEIGHT) -> tuple[float, list[float]]:
    """(intercept, weights) of a logistic regression on the share of each
    bucket among the n-grams of a URL. ``labelled`` is a small table with more
    blocked rows than the web has: allowed ones weigh ``allow_weight`` times."""
    g = split_url(labelled.select("url", F.col("label").cast("double").alias("label"))).withColumn("g", grams())
    share = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
                        lambda b: F.size(F.filter("g", lambda x: x == b)) * 100.0 / F.size("g"))
    weight = F.when(F.col("label") == 0, F.lit(allow_weight)).otherwise(F.lit(1.0))
    model = LogisticRegression(regParam=reg, maxIter=50, weightCol="weight").fit(
        g.select("label", weight.alias("weight"), array_to_vector(share).alias("features")))
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def default_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(url_table.rows(), "url string, label int")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score (probability of block), verdict."""
    bias, weights = train(labelled if labelled is not None else default_table(pages.sparkSession))
    rule, says = fitting_rule(rules)
    w = F.array(*[F.lit(x) for x in weights])
    total = F.aggregate("g", F.lit(0.0), lambda acc, b: acc + F.element_at(w, b + 1))
    score = 1 / (1 + F.exp(-(F.lit(bias) + 100.0 * total / F.size("g"))))
    out = split_url(pages.select("page_id", "url")).select("page_id", "host", "path", rule.alias("rule"),
                                                           says.alias("says"), grams().alias("g"))
    return out.withColumn("score", score).select(
        "page_id", "host", "path", "rule", "score",
        F.coalesce("says", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
