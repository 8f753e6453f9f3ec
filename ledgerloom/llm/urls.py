"""URL filter: host and path rules, and gradient-boosted trees for URLs that no rule fits.

The trees read lexical features: lengths, depths, digit ratio, entropy, counts of parameters
and marks, and how often labelled URLs of the same host suffix are blocked. All features are
column expressions and the trees are Spark ML's, so nothing here leaves the JVM.

The trees are fitted on a bounded sample of distinct labelled URLs (`sample_rows` in expectation,
chosen by a hash of the URL), each weighted by its rows; suffix statistics count all labelled
rows. A URL that is fitted on sees the suffix rate of the other folds only, so that its own label
is not among its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import checkpointed, table

SAMPLE_ROWS = 50_000
_FIT_PARTITIONS = 6
#: Host suffixes (some 50 bytes each) whose rates may be broadcast; more are joined.
_BROADCAST_SUFFIXES = 200_000
#: Rules are tried inside each row, so there may be this many at most.
_MOST_RULES = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that count as seen for every suffix, at the overall rate.
_PRIOR = 20.0
#: Folds, by a hash of the URL, whose suffix counts are kept apart.
_FOLDS = 5


@dataclass(frozen=True)
class UrlRule:
    """`verdict` for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host, path and rest (what follows the path) to rows with a url.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there
    up to `?`, `#` or the end. All are empty where url is null or has no `://`.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    after = F.when(mark > 0, F.expr("substring(coalesce(cast(url as string), ''), instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), "rest": F.regexp_extract(after, r"^[^?#]*([\s\S]*)$", 1)})


def fitting_rule(rules: tuple[UrlRule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits host and path, else null; of equally long ones a block."""
    if len(rules) > _MOST_RULES:
        raise ValueError(f"at most {_MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(F.length(text) == 0, 0.0).otherwise(bits)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def suffix(host: Column) -> Column:
    """Last label of a host."""
    return F.element_at(F.split(host, r"\."), -1)


def lexical_features() -> dict[str, Column]:
    """Lexical features by name, over host, path and rest."""
    return {
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "rest_length": F.length("rest").cast("double"),
        "host_depth": _count(F.col("host"), r"\."),
        "path_depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(F.concat("host", "path", "rest"), "[0-9]") / F.greatest(F.length(F.concat("host", "path", "rest")), F.lit(1)),
        "host_digits": _count(F.col("host"), "[0-9]"),
        "hyphens": _count(F.concat("host", "path"), "-"),
        "parameters": _count(F.col("rest"), "[?&][^&#]"),
        "fragment": F.contains(F.col("rest"), F.lit("#")).cast("double"),
        "host_entropy": entropy(F.col("host")),
        "path_entropy": entropy(F.col("path")),
        "first_part_length": F.length(F.regexp_extract("path", "^/([^/]*)", 1)).cast("double"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))).cast("double"),
    }


@dataclass
class UrlModel:
    """Trees, blocked rate by suffix (suffix, suffix_rate), and the overall blocked rate."""

    trees: GBTClassificationModel | None
    rates: DataFrame
    rate: float


def _with_suffix(parts: DataFrame, by_suffix: DataFrame) -> DataFrame:
    few = by_suffix.count() <= _BROADCAST_SUFFIXES
    return parts.withColumn("suffix", suffix(F.col("host"))).join(F.broadcast(by_suffix) if few else by_suffix, "suffix", "left")


def _featured(rated: DataFrame, rate: float) -> DataFrame:
    """Adds features to rows with host, path, rest and suffix_rate (null: a suffix never labelled)."""
    rated = rated.withColumns({f"feature_{name}": column for name, column in lexical_features().items()} | {"suffix_rate": F.coalesce("suffix_rate", F.lit(rate))})
    return VectorAssembler(inputCols=[*(f"feature_{name}" for name in lexical_features()), "suffix_rate"], outputCol="features").transform(rated)


def fit_url_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4) -> UrlModel:
    """Fit on labelled: url, host, path, rest and blocked (0 or 1). With one class or none there are no trees.

    Null labels are left out. The number of distinct URLs is estimated, so the sample's expected
    size is `sample_rows` within a few per cent; a URL in it brings all its rows as one weight.
    """
    known = labelled.where(F.col("blocked").isNotNull())
    n, blocked, urls = known.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0)), F.approx_count_distinct("url", 0.02)).first()
    rate = (float(blocked) + 1) / (n + 2)
    fold = F.pmod(F.xxhash64("url"), F.lit(_FOLDS)).cast("int")
    own = lambda value, name: [F.sum(F.when(F.col("fold") == i, value).otherwise(0)).alias(f"{name}{i}") for i in range(_FOLDS)]
    counts = known.withColumn("fold", fold).groupBy(suffix(F.col("host")).alias("suffix")).agg(F.sum("blocked").alias("b"), F.count("*").alias("n"), *own(F.col("blocked"), "b"), *own(F.lit(1), "n"))
    smoothed = lambda b, n: (b + _PRIOR * rate) / (n + _PRIOR)
    others = F.array(*(smoothed(F.col("b") - F.col(f"b{i}"), F.col("n") - F.col(f"n{i}")) for i in range(_FOLDS)))
    by_suffix = checkpointed(counts.select("suffix", smoothed(F.col("b"), F.col("n")).alias("suffix_rate"), others.alias("rates_of_others")))
    rates = by_suffix.select("suffix", "suffix_rate")
    if not 0 < blocked < n:
        return UrlModel(None, rates, rate)
    share = int(min(1.0, sample_rows / max(urls, 1)) * (1 << 20))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share).groupBy("url", "host", "path", "rest", "blocked").agg(F.count("*").cast("double").alias("weight"))
    rated = _with_suffix(sample, by_suffix.drop("suffix_rate")).withColumn("suffix_rate", F.get("rates_of_others", fold))
    booster = GBTClassifier(labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=0, checkpointInterval=-1)
    # the sample is of bounded size and read once per level of each tree: few partitions, made once
    features = checkpointed(_featured(rated, rate).select("features", F.col("blocked").cast("double").alias("blocked"), "weight").repartition(_FIT_PARTITIONS))
    return UrlModel(booster.fit(features) if features.select("blocked").distinct().count() == 2 else None, rates, rate)


def score_urls(parts: DataFrame, model: UrlModel) -> DataFrame:
    """Adds blocked_score (0 to 1) to rows with host, path and rest, by the trees, or the overall rate without trees."""
    if model.trees is None:
        return parts.withColumn("blocked_score", F.lit(model.rate))
    scored = model.trees.transform(_featured(_with_suffix(parts, model.rates), model.rate))
    return scored.withColumn("blocked_score", vector_to_array("probability")[1]).select(*parts.columns, "blocked_score")


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_score of each row of pages.

    pages: needs page_id and url; other columns, whatever their names, are ignored. The URLs
    that a rule fits are the labelled ones; the trees learn from them and judge the rest. A
    null url, or one without `://`, has an empty host and path and is judged by the trees.
    Repeated rows are answered each for itself, an empty table gives no rows.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("found", fitting_rule(rules))
    labelled = parts.where(F.col("found").isNotNull()).select("url", "host", "path", "rest", (F.col("found.verdict") == "block").cast("int").alias("blocked"))
    model = fit_url_model(labelled, sample_rows)
    by_method = F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow")
    return score_urls(parts, model).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_method).alias("verdict"), "blocked_score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))
