"""URL verdicts by rules and, where none fits, by gradient-boosted trees on lexical features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootloom.llm.common import ascii_lower
from bootloom.operators.lineage import settle

#: Rules (host, path) and their verdicts.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
#: Distinct labelled URLs that the trees are fitted on, at most about so many.
TRAINING_URLS = 200_000
TREES, DEPTH = 20, 4
#: How much a suffix's own share of blocked URLs is drawn to the overall share.
SMOOTHING = 20.0
#: Parts of the labelled URLs; a row is trained with the statistics of the others.
FOLDS = 5


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z in lower case) and ``path``; both empty for null and for a URL without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return pages.withColumns(
        {
            "host": ascii_lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)),
            "path": F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
        }
    )


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null.  A rule fits its host and all subdomains, from the start of the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add lexical features as doubles, and the suffixes that statistics are kept of."""
    text, host, path = F.coalesce(url, F.lit("")), F.col("host"), F.col("path")
    asked = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    features = {
        "f_length": F.length(text).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": _count(path, "/[^/]"),
        "f_labels": _count(host, r"\."),
        "f_hyphens": _count(host, "-"),
        "f_digits": _count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1)),
        "f_host_digits": _count(host, "[0-9]") / F.greatest(F.length(host), F.lit(1)),
        "f_entropy": _entropy(host),
        "f_path_entropy": _entropy(path),
        "f_parameters": F.when(asked == "", 0.0).otherwise(_count(asked, "&") + 1),
        "f_fragment": text.contains("#").cast("double"),
        "f_secure": text.startswith("https://").cast("double"),
    }
    suffixes = {
        "s_host": F.substring_index(host, ".", -2),
        "s_file": F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
    }
    return pages.withColumns(features | suffixes)


FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_hyphens", "f_digits", "f_host_digits",
    "f_entropy", "f_path_entropy", "f_parameters", "f_fragment", "f_secure",
]
SUFFIXES = ["s_host", "s_file"]


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(FOLDS)).cast("int")


def _statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """(suffix, by fold the numbers of labelled and of blocked URLs) over all labelled rows."""
    own = [F.when(_fold(F.col("url")) == k, F.col("label")) for k in range(FOLDS)]
    return labelled.groupBy(suffix).agg(
        F.array(*[F.count(x) for x in own]).alias(f"{suffix}_n"),
        F.array(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in own]).alias(f"{suffix}_blocked"),
    )


def _with_statistics(rows: DataFrame, statistics: dict[str, DataFrame], overall: float, training: bool) -> DataFrame:
    """Add each suffix's smoothed share of blocked URLs and the log of their number.

    For rows to train on they are those of the other folds: neither a row's own
    label is in them, nor does leaving out just that one give it away.
    """
    for suffix, table in statistics.items():
        rows = rows.join(table, suffix, "left")
        sums = []
        for c in (f"{suffix}_n", f"{suffix}_blocked"):
            each = [F.coalesce(F.get(c, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(FOLDS)]
            if training:
                each = [F.when(_fold(F.col("url")) == k, 0.0).otherwise(x) for k, x in enumerate(each)]
            sums.append(reduce(lambda x, y: x + y, each))
        n, blocked = sums
        share = (blocked + SMOOTHING * overall) / (n + SMOOTHING)
        rows = rows.withColumns({f"{suffix}_share": share, f"{suffix}_size": F.log1p(n)})
    return rows


def judged(
    pages: DataFrame,
    *,
    url: str = "url",
    rules: dict[str, str] = RULES,
    training_urls: int = TRAINING_URLS,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced, all others stay.

    A URL that a rule fits has the rule's verdict.  The URLs that rules label,
    each counted once, train the trees that judge all others.  Shares of suffixes
    are taken over all labelled rows, for a row that the trees are fitted on
    over those of other folds; a suffix that no labelled row has gets the overall
    share.  The trees are fitted on all distinct labelled URLs, or on about
    ``training_urls`` of them, by a hash.  If the rules label none, or give all the
    same verdict, that verdict (``allow`` for none) is the answer.  Null URLs have
    an empty host and path, and are judged like others.
    """
    # The caller's columns stand aside, so that none has a name that is needed here.
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = with_parts(pages.select(F.struct(*kept).alias("_own"), F.col(url).alias("url")))
    ruled = parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    of_rule = F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")

    def answer(rows: DataFrame, otherwise: Column) -> DataFrame:
        return rows.select("_own.*", "host", "path", "rule", F.coalesce(of_rule, otherwise).alias("verdict"))

    known = ruled.where(F.col("rule").isNotNull()).select("url", "host", "path", of_rule.alias("_verdict"))
    label = (F.col("_verdict") == "block").cast("double")
    known = settle(with_features(known.distinct()).withColumn("label", label).drop("_verdict"))
    n, blocked = known.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0, n):
        return answer(ruled, F.lit("block" if n and blocked == n else "allow"))
    overall = blocked / n
    statistics = {s: settle(_statistics(known, s)) for s in SUFFIXES}

    def assembled(rows: DataFrame, training: bool) -> DataFrame:
        names = [*FEATURES, *[f"{s}_{k}" for s in SUFFIXES for k in ("share", "size")]]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(_with_statistics(rows, statistics, overall, training))

    chosen = known
    if n > training_urls:
        part = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * training_urls / n)
        chosen = known.where(part)
    sample = settle(assembled(chosen, training=True).select("_features", "label"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_block", maxIter=TREES, maxDepth=DEPTH, seed=7
    )
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(sample)
    scored = trees.transform(assembled(with_features(ruled), training=False))
    return answer(scored, F.when(F.col("_block") == 1.0, "block").otherwise("allow"))
