"""URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame functions and Spark ML alone.

Urls that a rule decides are the labelled examples; the trees learn from a bounded sample of distinct ones and judge the rest.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ready, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# fixed values: the contract's rules
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: labelled urls that the trees learn from, at most, of each label; and examples that a suffix needs for statistics of its own
SAMPLE, SUFFIX_LEAST = 10_000, 20
#: parts of the labelled urls: a url's suffix statistics, while learning, come from the other parts; and suffixes that are broadcast, at most
FOLDS, BROADCAST_SUFFIXES = 5, 200_000
TREES, DEPTH = 12, 4

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "host_digits", "path_digits", "hyphens", "parameters", "entropy", "suffix_rate", "suffix_share")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without a ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null; of rules as long, the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # a longer one overrides
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _share(of: Column, pattern: str) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def _entropy(of: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits."""
    n = F.greatest(F.length(of), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(F.split(of, "")), lambda c: (F.length(of) - F.length(F.replace(of, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _lexical(rows: DataFrame) -> DataFrame:
    """Lexical features of url, host and path."""
    url = F.coalesce("url", F.lit(""))
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -2),
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
            "host_digits": _share(F.col("host"), "[0-9]"),
            "path_digits": _share(F.col("path"), "[0-9]"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"),
            "entropy": _entropy(F.lower(F.concat("host", "path"))),
        }
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, few: bool, rate: float, n: int, own: bool = False) -> DataFrame:
    """With suffix_rate and suffix_share by the counts of ``suffixes``; with ``own``, less those of the row's own fold."""
    x = rows.join(F.broadcast(suffixes) if few else suffixes, "suffix", "left")
    k, b = F.coalesce("k", F.lit(0)), F.coalesce("b", F.lit(0.0))
    if own:
        mine = lambda c, zero: F.coalesce(F.get(F.col(c), F.col("fold")), zero)
        k, b = k - mine("ks", F.lit(0)), b - mine("bs", F.lit(0.0))
    known = k >= SUFFIX_LEAST
    x = x.withColumns({"suffix_rate": F.when(known, (b + rate * SUFFIX_LEAST) / (k + SUFFIX_LEAST)).otherwise(rate), "suffix_share": F.when(known, k / F.lit(float(n))).otherwise(0.0)})
    return x.drop("k", "b", "ks", "bs")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row: allow or block.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Where no rule fits, ``verdict``
    is block if ``score``, the trees' probability of block, is ``threshold`` or more; score is null where a rule decides.
    The trees learn from the urls that rules decide: of each label the SAMPLE distinct urls that are first by hash; if there are
    not both labels, everything else is allowed with score 0. Suffix statistics count all rows that rules decide; a url that is learned
    from sees those of the other FOLDS - 1 parts alone. Null urls and urls without :// have an empty host and path and are
    judged by their features. Repeated rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    ready(pages.sparkSession)
    verdicts = dict(rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for r, v in verdicts.items():
        ruled = F.when(F.col("rule") == r, F.lit(v)).otherwise(ruled)
    rows = written(_lexical(rows.withColumn("ruled", ruled)))  # once, for the sample and for the verdicts

    labelled = rows.where(F.col("ruled").isNotNull()).select("url", "suffix", *FEATURES[:-2], (F.col("ruled") == "block").cast("double").alias("y"), _fold().alias("fold"))
    first = lambda y: labelled.where(F.col("y") == y).dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    sample = written(first(0.0).unionByName(first(1.0)))
    n, all_blocked = labelled.agg(F.count("*"), F.sum("y")).first()
    out = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    if not n or not 0 < all_blocked < n:
        score = F.when(F.col("ruled").isNull(), 0.0)
        return rows.select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"), score.alias("score"))
    rate = all_blocked / n
    each = [(F.count_if(F.col("fold") == i), F.coalesce(F.sum(F.when(F.col("fold") == i, F.col("y"))), F.lit(0.0))) for i in range(FOLDS)]
    counts = labelled.groupBy("suffix").agg(F.count("*").alias("k"), F.sum("y").alias("b"), F.array(*(k for k, _ in each)).alias("ks"), F.array(*(b for _, b in each)).alias("bs"))
    suffixes = written(counts.where(F.col("k") >= SUFFIX_LEAST))
    few = suffixes.count() <= BROADCAST_SUFFIXES
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    training = assembler.transform(_with_suffixes(sample, suffixes, few, rate, n, own=True)).select("features", "y").repartition(4, "y", F.hash("features"))
    model = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7).fit(training)
    judged = _scored(_with_suffixes(rows, suffixes, few, rate, n), assembler, model)
    score = F.when(F.col("ruled").isNull(), F.round("p", 9))
    verdict = F.coalesce(F.col("ruled"), F.when(F.round("p", 9) >= threshold, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), score.alias("score"))


def _scored(rows: DataFrame, assembler: VectorAssembler, model: GBTClassificationModel) -> DataFrame:
    return model.transform(assembler.transform(rows)).withColumn("p", vector_to_array("probability")[1])
