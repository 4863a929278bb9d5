"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A small labelled table of hosts and paths trains the model (binary features, L-BFGS with a ridge).
Everything runs on built-in functions and Spark's own feature and classification classes, row by
row: judging a table shuffles nothing, and the model is one bounded vector.

Defined results: host and path of a NULL url, or of one without ``://``, are empty; such a row is
judged like any other. A rule fits its host and the hosts below it, where the path begins with the
rule's path; the longest rule wins, and of two equally long ones the first. Without labelled rows
the model allows everything; with labels of one kind it gives that kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

from stagecast.llm.common import lower_az, materialise

#: n-gram lengths, and the width of the hashed features.
GRAMS = (2, 3, 4)
FEATURES = 1 << 16
#: About so many labelled rows train the model at most.
LABELLED_ROWS = 20_000
BLOCK, ALLOW = "block", "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda pattern: F.coalesce(F.regexp_extract(after, pattern, 1), F.lit(""))
    return lower_az(part("^([^/?#]*)")), part("^[^/?#]*([^?#]*)")


def longest_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host/path) that fits a row, else NULL."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of ``text`` between two marks, each tagged by where it comes from."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    of = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))),
        lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(framed, i, n)),
    )
    return F.concat(*[of(n) for n in GRAMS])


def features(rows: DataFrame) -> DataFrame:
    """Add ``_features`` of host and path."""
    grams = rows.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(grams).drop("_grams")


@dataclass
class UrlFilter:
    """A fitted filter; ``model`` is None if all labels were ``constant``."""

    model: LogisticRegressionModel | None
    constant: str = ALLOW

    def judge(self, rows: DataFrame, out: str = "_judged") -> DataFrame:
        """Add the verdict of the model on ``host`` and ``path``."""
        if self.model is None:
            return rows.withColumn(out, F.lit(self.constant))
        judged = self.model.transform(features(rows))
        return judged.withColumn(out, F.when(F.col("_prediction") == 1.0, BLOCK).otherwise(ALLOW)).drop(
            "_features", "_raw", "_probability", "_prediction"
        )


def fit(labelled: DataFrame, rows: int = LABELLED_ROWS) -> UrlFilter:
    """Train on a table of host, path, label (block or allow), of which about ``rows`` are used."""
    kinds = {r["label"]: r["count"] for r in labelled.where(F.col("label").isin(BLOCK, ALLOW)).groupBy("label").count().collect()}
    if len(kinds) < 2:
        return UrlFilter(None, next(iter(kinds), ALLOW))
    # Half of the rows for each label, chosen by hash, so that a lost task chooses the same ones.
    # The share is a bound on 64-bit hashes: exact however many rows there are.
    bound = F.lit(-(1 << 63))
    for kind, count in kinds.items():
        bound = F.when(F.col("label") == kind, F.lit(min((1 << 63) * rows // count, (1 << 64) - 1) - (1 << 63))).otherwise(bound)
    chosen = labelled.where(F.xxhash64("host", "path") <= bound)
    known = F.when(F.col("label") == BLOCK, F.lit(1.0)).otherwise(F.lit(0.0)).alias("_label")
    small = materialise(features(chosen.select("host", "path", known)).select("_label", "_features").coalesce(8), "url-labels")
    return UrlFilter(
        LogisticRegression(
            featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", probabilityCol="_probability",
            predictionCol="_prediction", maxIter=30, regParam=0.01,
        ).fit(small)
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: UrlFilter | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, else the model's.

    Without a model, one is trained on the rows that the rules decide.
    """
    host, path = host_path(F.col(f"`{url_col}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # The page's own columns travel as one, so no name of theirs meets a name used here.
    rows = pages.select(F.struct(*kept).alias("_page"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict)
    if model is None:
        model = fit(rows.where(F.col("_ruled").isNotNull()).select("host", "path", F.col("_ruled").alias("label")))
    return model.judge(rows).select("_page.*", "host", "path", "rule", F.coalesce("_ruled", "_judged").alias("verdict"))
