"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Only DataFrame functions and Spark's own tree learner. Features: lengths, depth, digit ratio,
character entropy, parameter counts, separators, and statistics of the host's last label
(its frequency among all URLs and its smoothed block rate among the labelled ones).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import ascii_lower, stored

FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "hyphens", "params",
            "query_chars", "fragment", "entropy", "suffix_share", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://`` or for null."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (ascii_lower(F.coalesce(F.regexp_extract(url, split, 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, split, 2), F.lit("")))


def matched(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct ``(rule, verdict)``; else null.

    The rule list becomes one expression, so it suits lists of up to some hundred rules.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(host & F.startswith(F.col("path"), F.lit(rule.path)), found).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character: the characters sorted, so that each one's run is its count."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    count = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: F.when(count(c) > 0, acc - count(c) / size * F.log2(count(c) / size)).otherwise(acc))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with columns url, host, path and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.length(url).cast("double")
    return (urls
            .withColumn("suffix", F.substring_index("host", ".", -1))
            .withColumn("url_chars", chars)
            .withColumn("host_chars", F.length("host").cast("double"))
            .withColumn("path_chars", F.length("path").cast("double"))
            .withColumn("depth", F.regexp_count("path", F.lit("/[^/]")).cast("double"))
            .withColumn("labels", F.when(F.col("host") == "", 0.0).otherwise(F.regexp_count("host", F.lit(r"\.")) + 1.0))
            .withColumn("digit_ratio", F.regexp_count(url, F.lit("[0-9]")) / F.greatest(chars, F.lit(1.0)))
            .withColumn("hyphens", F.regexp_count("host", F.lit("-")).cast("double"))
            .withColumn("params", F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0))
            .withColumn("query_chars", F.length(query).cast("double"))
            .withColumn("fragment", F.contains(url, F.lit("#")).cast("double"))
            .withColumn("entropy", entropy(url)))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
          max_labelled: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """Verdict of every URL: ``page_id, host, path, rule, verdict, score``.

    ``labels`` holds labelled URLs (``url``, ``verdict``); without it the URLs that a rule decides are the
    labelled ones. The trees are fitted on at most ``max_labelled`` of them, chosen by a hash of the
    URL. A rule's verdict stands; otherwise block from a score of 0.5 on. With labels of one kind only, that
    kind is the verdict; without any, allow. Null URLs and those without ``://`` have an empty host and path
    and are judged by the trees; repeated rows are judged each. Empty input gives an empty result.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = lexical(rows).withColumn("hit", matched(rules))
    if labels is None:
        known = rows.filter("hit is not null").withColumn("label", (F.col("hit.verdict") == "block").cast("double"))
    else:
        lh, lp = parts(F.col("url"))
        known = lexical(labels.select("url", "verdict").withColumn("host", lh).withColumn("path", lp))
        known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    known = known.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    known = stored(known.select("label", "suffix", *[f for f in FEATURES if not f.startswith("suffix")]), "url-labels")
    kinds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        score = F.lit(next(iter(kinds), 0.0))
        return shown(rows.withColumn("score", score))
    rate = sum(k * n for k, n in kinds.items()) / sum(kinds.values())
    strength = 20.0
    by_label = known.groupBy("suffix").agg(((F.sum("label") + strength * rate) / (F.count("*") + strength)).alias("suffix_rate"))
    stats = stored(rows.groupBy("suffix").agg(F.count("*").alias("urls")), "url-suffixes")
    total = stats.agg(F.sum("urls")).first()[0] or 1
    stats = (stats.join(by_label, "suffix", "left")
             .select("suffix", (F.col("urls") / F.lit(float(total))).alias("suffix_share"), F.coalesce("suffix_rate", F.lit(rate)).alias("suffix_rate")))
    packed = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # labels of suffixes absent from this input still train, with no share
    train = (known.join(stats, "suffix", "left")
             .na.fill({"suffix_share": 0.0, "suffix_rate": rate}))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed,
                          stepSize=0.3).fit(packed.transform(train).select("label", "features"))
    scored = model.transform(packed.transform(rows.join(stats, "suffix")))
    return shown(scored.withColumn("score", F.round(vector_to_array("probability")[1], 9)))


def shown(scored: DataFrame) -> DataFrame:
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
