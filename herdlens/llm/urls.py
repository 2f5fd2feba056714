"""URL filters in DataFrame functions only: rules on hosts and paths, and a logistic regression for all other urls.

The regression reads hashed character n-grams of host and path. It is trained by Spark's own estimator on a small
labelled url table; its weights become one constant array, so judging is a narrow, generated projection.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no n-grams, so it is
allowed; repeated urls get equal verdicts; rules of equal length go by their text; an empty table gives an empty
result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES, BUCKETS = (3, 4), 2048
#: Rules become a constant array; more than this belongs into a join.
MOST_RULES = 1000

# Names of the small labelled table (invented). Hosts and paths around them follow by rule, the same for
# both classes, so that only the names tell them apart.
BLOCKED = """
casino-games casino-royal win-casino casino-win lucky-casino free-bets bets-today sports-bets free-spins poker-win cheap-pills pills-online
buy-pills cheap-meds diet-pills adult-x adult-chat x-adult adult-cams adult-videos adult-zone xxx-cams spam-farm link-farm spam-mail link-spam ads-track track-ads
ad-track click-track click-ads quick-loans payday-loans lottery-win free-prize prize-win cheap-watches cheap-viagra hot-singles fast-cash
""".split()
ALLOWED = """
library university council museum weather gardening recipes history science travel school hospital thinker theatre orchestra newspaper northern
station mountain river other thread action nation entire heather ocean stone handbook bakery forest letters chess mathematics garden winter
field window trading freedom double table thing thanks shelter ready heron thesis other-side atlas reader session tailor tender inside history-club
green-door old-town open-data north-sea two-rivers
""".split()
PREFIXES, ENDS, PATHS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org"), ("/en/{}", "/fr/{}/", "/de/{}.html", "/es/{}")
# The rules, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url__, instr(__url__, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    kept = urls.drop("host", "path").withColumn("__url__", F.col(f"`{url}`"))
    host, path = split_url(F.col("__url__"))
    return kept.withColumns({"host": host, "path": path}).drop("__url__")


def _grams(part: Column, mark: str) -> Column:
    """Hash buckets of the n-grams of one marked part."""
    text = F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$"))  # digits say nothing
    made = []
    for n in SIZES:
        last = F.length(text) - F.lit(n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(starts, lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int")))
    return F.concat(*made)


def grams(host: Column, path: Column) -> Column:
    empty = (host == "") & (path == "")
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.concat(_grams(host, "h"), _grams(path, "p")))


@dataclass
class Model:
    weights: list[float]
    bias: float

    def probability(self, buckets: Column) -> Column:
        """Of being blocked; no n-grams at all counts as zero."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
        logit = F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))
        return F.when(F.size(buckets) == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-logit)))


def labelled(spark: SparkSession) -> DataFrame:
    """The small table to train from: url, label (1: block)."""
    rows = []
    for names, bad in ((BLOCKED, 1.0), (ALLOWED, 0.0)):
        for n, name in enumerate(names):
            for k, (prefix, path) in enumerate((p, q) for p in PREFIXES for q in PATHS):
                where = path.format(37 * n + 211 * k + 5)
                rows.append({"url": f"https://{prefix}{name}.{ENDS[(n + k) % len(ENDS)]}{where}", "label": bad})
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, label: double>>")
    return spark.range(1).select(F.inline(made))


def fit(table: DataFrame, url: str = "url", label: str = "label") -> Model:
    """Logistic regression over a small table; without rows of both classes nothing is blocked."""
    rows = with_parts(table.select(F.col(url).alias("url"), F.col(label).cast("double").alias("__label__")).dropna())
    buckets = rows.select("__label__", grams(F.col("host"), F.col("path")).alias("b")).where(F.size("b") > 0)
    one = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter(F.col("b"), lambda x: x == k)) / F.sqrt(F.size("b")))
    data = buckets.select("__label__", array_to_vector(one).alias("features")).coalesce(1).cache()
    if data.select("__label__").distinct().count() < 2:
        return Model([0.0] * BUCKETS, -40.0)
    model = LogisticRegression(labelCol="__label__", featuresCol="features", regParam=1e-4, maxIter=100, standardization=False).fit(data)
    data.unpersist()
    return Model([round(float(w), 6) for w in model.coefficients], float(model.intercept))


def judge(urls: DataFrame, model: Model, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, the longest fitting rule, the probability and the verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    kept = urls.drop("rule", "verdict", "score")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    host, path = F.col("host"), F.col("path")
    fit_rule, fit_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, start in reversed(ordered):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fit_rule = F.when(fits, F.lit(name + start)).otherwise(fit_rule)
        fit_verdict = F.when(fits, F.lit(verdict)).otherwise(fit_verdict)
    parts = with_parts(kept, url)
    scored = parts.withColumn("score", model.probability(grams(host, path))).withColumn("rule", fit_rule).withColumn("__rule__", fit_verdict)
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce(F.col("__rule__"), own)).drop("__rule__")
