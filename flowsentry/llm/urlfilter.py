"""URL filter: host and path rules, and gradient-boosted trees for URLs that no rule fits.

The trees (Spark ML, JVM only) see lexical features of the URL: lengths, depth, digit ratio,
character entropy, parameter counts and statistics of its host suffix.  They are trained on
labelled URLs: those that a rule decides, with the rule's verdict as label, at most
``max_labelled`` of them in the order of their hash, half of each class where there are so many.
Suffix statistics (the smoothed share of blocked among labelled URLs that end in the host's last
one or two labels) are counted over all of them.  A URL teaches once, on however many pages it
stands, so copies of one URL change no other URL's verdict.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
is scored like any other; with labels of one class only, unruled URLs get that class; without
any labelled URL they are allowed; of rules of equal length that fit, the first in
alphabetical order wins; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "dashes", "entropy",
            "parameters", "fragment", "last_label", "last_two_labels")
MAX_RULES = 500


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    return F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", 0.0).otherwise(
            (n - F.length(F.replace(text, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(text, c, F.lit("")))) / n)))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    def count(text: Column, pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")

    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": count(path, "[^/]") * -1 + F.length(path),
        "labels": count(host, r"[.]"), "digits": count(url, "[0-9]") / n, "dashes": count(url, "[-_]"),
        "entropy": F.when(F.length(url) > 0, _entropy(url)).otherwise(0.0),
        "parameters": F.when(F.length(query) > 0, count(query, "[&;]") + 1.0).otherwise(0.0),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def judge(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", keep: tuple[str, ...] = (),
          max_labelled: int = 10_000, trees: int = 15, depth: int = 3, smoothing: float = 20.0,
          threshold: float = 0.75) -> DataFrame:
    """``keep`` columns plus host, path, rule, verdict and block_score.

    ``keep`` names must differ from the five result names.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(*[F.col(c) for c in keep], url.alias("_url")) \
        .withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}) \
        .withColumns({"_fit": fitting_rule(F.col("host"), F.col("path"), rules), "_suffix1": _suffix(F.col("host"), 1), "_suffix2": _suffix(F.col("host"), 2)})
    # a URL teaches once, on however many pages it stands
    known = base.filter("_fit is not null").select("_url", "host", "path", "_suffix1", "_suffix2",
                                                   (F.col("_fit.verdict") == "block").cast("double").alias("_label")).dropDuplicates(["_url"])

    def seen(suffix: str) -> DataFrame:
        return known.groupBy(suffix).agg(F.count("*").alias("_labelled"), F.sum("_label").alias("_blocked"))

    both = known.agg(F.count("*"), F.sum("_label")).first()
    labelled, blocked = float(both[0] or 0), float(both[1] or 0)
    # both classes weigh the same, so an unseen suffix stands at one half
    heavy = (labelled - blocked) / max(blocked, 1.0)
    marked = F.col("_blocked") * heavy
    share = (marked + smoothing * 0.5) / (marked + F.col("_labelled") - F.col("_blocked") + smoothing)
    fixed = F.when(F.col("_fit").isNotNull(), F.col("_fit.verdict"))
    if blocked == 0 or blocked == labelled:
        other = "block" if labelled and blocked else "allow"
        return base.select(*keep, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(fixed, F.lit(other)).alias("verdict"),
                           F.lit(1.0 if other == "block" else 0.0).alias("block_score"))

    def measured(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(_lexical(F.col("_url"), F.col("host"), F.col("path")))  # before the joins: in the input's partitions
        for suffix, name in (("_suffix1", "last_label"), ("_suffix2", "last_two_labels")):
            rate = seen(suffix).select(F.col(suffix).alias("_of"), share.alias(name))
            rows = rows.join(rate, F.col(suffix) == F.col("_of"), "left").drop("_of").fillna(0.5, [name])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)

    rows = measured(base)
    # of each class the URLs of lowest hash, half of the bound each (or what the other leaves)
    few = min(blocked, labelled - blocked, max_labelled // 2)
    drawn = [known.filter(F.col("_label") == y).orderBy(F.xxhash64("_url"), "_url").limit(int(max(max_labelled // 2, max_labelled - few)))
             for y in (0.0, 1.0)]
    sample = measured(drawn[0].unionByName(drawn[1])) \
        .select("_features", "_label", F.when(F.col("_label") == 1, heavy).otherwise(1.0).alias("_weight"))
    # Ten thousand rows at most, so Spark's split search uses every row, however they are dealt.
    model = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_pred", maxIter=trees, maxDepth=depth,
                          stepSize=0.2, maxBins=64, seed=7, minInstancesPerNode=5).fit(sample)
    model = model.setRawPredictionCol("_raw").setProbabilityCol("_prob")
    scored = model.transform(rows).withColumn("block_score", vector_to_array("_prob")[1])
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(*keep, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(fixed, learned).alias("verdict"), "block_score")
