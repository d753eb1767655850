"""URL filter: rules first, then logistic regression on hashed character n-grams of
host and path (DataFrame functions and Spark's own ML, no Python on executors).

The classifier is trained from a small labelled URL table (:data:`LABELLED`, or the
caller's).  ``HashingTF`` hashes the n-grams into a fixed number of weights, so what is
sent to executors does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled URLs (1: block).
LABELLED = [
    ("http://cheap-pills.test/en/1", 1), ("http://www.cheap-pills.test/buy", 1),
    ("https://m.cheap-pills.test/fr/22?ref=x", 1), ("https://pills-online.test/order", 1),
    ("http://cheap-meds.test/en/7.html", 1), ("https://blog.cheap-viagra.test/de/3", 1),
    ("http://casino-win.test/en/31", 1), ("https://www.casino-win.test/es/5/", 1),
    ("https://m.casino-win.test/en/9", 1), ("http://win-casino-bonus.test/play", 1),
    ("https://online-casino.test/de/11", 1), ("http://poker-win.test/jackpot", 1),
    ("http://spam-farm.test/en/728", 1), ("https://www.spam-farm.test/fr/2", 1),
    ("https://blog.spam-farm.test/en/14/", 1), ("http://link-farm.test/seo", 1),
    ("https://free-money.test/en/6", 1), ("http://xxx-adult.test/de/4", 1),
    ("https://adult-chat.test/en/12", 1), ("http://payday-loan.test/es/8", 1),
    ("http://bets-online.test/en/18", 1), ("https://m.free-spins.test/en/21", 1),
    ("http://ads-click.test/fr/2", 1), ("https://ad-tracker.test/en/81", 1),
    ("https://cheap-replica.test/en/45", 1), ("http://free-followers.test/fr/30", 1),
    ("https://get-rich-quick.test/en/3", 1), ("http://torrent-warez.test/en/10", 1),
    ("http://example.test/en/1", 0), ("http://www.library.test/buy", 0),
    ("https://m.weather.test/fr/22?ref=x", 0), ("https://news.test/order", 0),
    ("http://university.test/en/7.html", 0), ("https://blog.gardening.test/de/3", 0),
    ("http://thinking.test/en/31", 0), ("https://www.history.test/es/5/", 0),
    ("https://m.theatre.test/en/9", 0), ("http://museum.test/play", 0),
    ("https://cooking.test/de/11", 0), ("http://mathematics.test/lecture", 0),
    ("http://there.test/en/728", 0), ("https://www.station.test/fr/2", 0),
    ("https://blog.another.test/en/14/", 0), ("http://others.test/seo", 0),
    ("https://weathering.test/en/6", 0), ("http://thentheir.test/de/4", 0),
    ("https://northern.test/en/12", 0), ("http://nation.test/es/8", 0),
    ("http://better.test/en/18", 0), ("https://m.freedom.test/en/21", 0),
    ("http://lads.test/fr/2", 0), ("https://blog.tradition.test/en/81", 0),
    ("https://interest.test/en/45", 0), ("http://streets.test/fr/30", 0),
    ("https://together.test/en/3", 0), ("http://forest.test/en/10", 0),
]

#: Fixed values: (verdict, host, path) rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES, WEIGHTS = (2, 3, 4), 1 << 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one.  Rules are configuration:
    they become one CASE expression, longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each told apart by a mark."""
    def pieces(mark: str, text: Column, n: int) -> Column:
        places = F.length(text) - (n - 1)  # texts shorter than n have none
        each = F.transform(F.sequence(F.lit(1), F.greatest(places, F.lit(1))),
                           lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))
        return F.when(places > 0, each).otherwise(F.array().cast("array<string>"))

    texts = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": path}
    return F.flatten(F.array(*[pieces(mark, text, n) for mark, text in texts.items() for n in SIZES]))


def featured(df: DataFrame, weights: int) -> DataFrame:
    return HashingTF(numFeatures=weights, inputCol="_grams", outputCol="_features").transform(df)


def train(labelled: DataFrame, weights: int = WEIGHTS) -> LogisticRegressionModel:
    """Fit on (url, label).  Rows without a label are left out; the rows are spread over
    one task, as the table is small."""
    host, path = host_and_path(F.col("url"))
    rows = (labelled.where("label is not null").select(F.col("label").cast("double").alias("_label"),
                                                       host.alias("_host"), path.alias("_path"))
            .withColumn("_grams", grams(F.col("_host"), F.col("_path"))).coalesce(1))
    return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_blocked",
                              probabilityCol="_probability", rawPredictionCol="_raw", regParam=0.01,
                              maxIter=50, standardization=False).fit(featured(rows, weights))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def judge_urls(df: DataFrame, id_col: str, url_col: str, model: LogisticRegressionModel,
               rules: Sequence[tuple[str, str, str]] = tuple(RULES), weights: int = WEIGHTS) -> DataFrame:
    """(id, host, path, rule, verdict, method_verdict) for every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule, and gets
    the verdict that the method gives the empty text.  Repeated rows are judged alike; an
    empty table gives no rows; other columns take no part."""
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = featured(rows.withColumn("_grams", grams(F.col("host"), F.col("path"))), weights)
    scored = model.transform(rows)
    method = F.when(F.col("_blocked") > 0.5, "block").otherwise("allow")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                         method.alias("method_verdict"))
