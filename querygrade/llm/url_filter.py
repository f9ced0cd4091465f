"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained from a small table of labelled URLs with Spark's own feature and classifier classes; rules
and scores are DataFrame expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the n-grams; hash buckets of host and path n-grams together; ridge penalty; passes of training.
GRAMS = (3, 4, 5)
BUCKETS = 1 << 13
RIDGE = 0.02
PASSES = 60

#: (verdict, host, path prefix), as the contract of the query states them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Words of unwanted and of ordinary hosts; the labelled table is made of them by ``LABELLED_FORMS``.
UNWANTED = "casino poker slots jackpot bets betting lottery pills pharma viagra adult porn xxx escort spam ads adserver banner track tracker popup clickbait loans payday warez torrent crack phish malware cheap free win farm".split()
ORDINARY = (
    "library school garden museum history science weather recipes village river mountain teacher journal letters archive council theatre orchestra "
    "parish cycling reading harbour notes stories gallery letterpress research institute university hospital kitchen bakery market station forest "
    "valley meadow ocean island castle bridge tower window carpenter painter writer farmer doctor engineer student family children animals flowers "
    "birds fishing sailing walking hiking camping dancing singing music film photo video language english german french spanish grammar spelling "
    "maths physics chemistry biology geology astronomy energy water earth north south east west summer winter spring autumn morning evening home "
    "house street city town county country nation people society culture art design fashion health medicine nursing pharmacy sport football tennis "
    "running swimming chess puzzles books poetry novels essays news press radio podcast forum wiki docs blog photos travel hotel train airline"
).split()
LABELLED_FORMS = [
    "http://{0}.example.net/en/12",
    "https://www.{0}.example.org/de/345/",
    "https://blog.{0}.example.com/fr/67?page=2",
    "https://{0}-{1}.example.net/es/8.html",
    "http://m.{1}-{0}.example.org/en/910#top",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label): 1 for unwanted."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            rows += [(form.format(word, words[(k * 7 + 3) % len(words)]), label) for form in LABELLED_FORMS]
    values = ", ".join(f"('{url}', {label}.0D)" for url, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent of it and begins the path, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_grams(host: Column, path: Column) -> Column:
    """All character n-grams of host and path with their ends marked; those of the path are told apart by a mark."""
    def grams(mark: str, text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    ends = {mark: F.concat(F.lit("^"), text, F.lit("$")) for mark, text in (("h", host), ("p", path))}
    return F.concat(*[grams(mark, text, n) for mark, text in ends.items() for n in GRAMS])


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Fit on rows (url, label), in one partition so that sums have one order; None without rows of both labels."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).coalesce(1)
    if len(rows.select("label").distinct().limit(2).collect()) < 2:
        return None
    rows = rows.select(F.col("label").cast("double").alias("label"), url_grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(rows)
    return LogisticRegression(regParam=RIDGE, maxIter=PASSES, standardization=False).fit(hashed)


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """Columns page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url; other columns are ignored).

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows
    up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path. A rule's verdict
    holds, else the model's: block if it finds the URL unwanted. An empty host, or a model that could not be trained,
    gives allow. Repeated rows come out once each; an empty table gives an empty table.
    """
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": ruled, "grams": url_grams(F.col("host"), F.col("path"))})
    model = train(labelled)
    if model is None:
        judged = parsed.withColumn("prediction", F.lit(0.0))
    else:
        judged = model.transform(HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(parsed))
    found = F.when((F.col("prediction") == 1.0) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", found).alias("verdict"))
