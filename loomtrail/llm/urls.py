"""URL parts, rules, and a gradient-boosted classifier on lexical features."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled URLs that the classifier is fitted on at most, its trees and their depth.
SAMPLE, TREES, DEPTH = 10_000, 12, 4
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_length", "suffix_share", "suffix_blocked")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. ``rules``: (verdict, host/path prefix).

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, prefix = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def _lexical(urls: DataFrame) -> DataFrame:
    """Adds all features but the suffix statistics to (url, host, path, ...)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def part(c: Column) -> Column:
        p = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    letters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    return urls.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
            "entropy": F.aggregate(letters, F.lit(0.0), lambda sum_, c: sum_ + part(c)),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "hyphens": F.regexp_count(url, F.lit("-")).cast("double"),
            "suffix_length": F.length(F.substring_index("host", ".", -1)).cast("double"),
        }
    )


class UrlFilter:
    """Gradient-boosted trees over the lexical features of labelled URLs.

    Fitted on at most ``sample`` of them, first in the order of a hash of the URL. Suffix statistics, the
    share of a host's last label among the sample and how much of it is blocked (smoothed by the whole),
    come from the sample too, so that they have no more rows than it.
    """

    def __init__(self, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> None:
        self.sample, self.trees, self.depth, self.seed = sample, trees, depth, seed
        self.model, self.suffixes, self.constant = None, None, 0.0

    def fit(self, labelled: DataFrame) -> UrlFilter:
        """``labelled``: (url, label), label 1 to block and 0 to allow; rows without either are left out."""
        rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")).where("url IS NOT NULL AND label IS NOT NULL")
        rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(self.sample)
        rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        # the sample is all that the rest reads
        told = cut(_lexical(rows).select("suffix", "label", *FEATURES[:-2]))
        n, blocked = told.agg(F.count("*"), F.sum("label")).first()
        self.constant = blocked / n if n else 0.0
        of_suffix = told.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        share, smoothed = F.col("n") / max(1, n), (F.col("blocked") + 10 * self.constant) / (F.col("n") + 10)
        self.suffixes = cut(of_suffix.select("suffix", share.alias("suffix_share"), smoothed.alias("suffix_blocked")))
        if 0 < self.constant < 1:
            self.model = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, seed=self.seed).fit(self._assembled(told.join(F.broadcast(self.suffixes), "suffix")))
        return self

    @staticmethod
    def _assembled(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def block(self, urls: DataFrame) -> DataFrame:
        """Adds ``blocked`` (1.0 or 0.0) and ``p_block`` to (url, host, path, ...). A sample of one label decides for all."""
        if self.model is None:
            return urls.withColumns({"blocked": F.lit(float(self.constant >= 0.5)), "p_block": F.lit(float(self.constant))})
        joined = _lexical(urls).join(F.broadcast(self.suffixes), "suffix", "left")
        joined = joined.fillna({"suffix_share": 0.0, "suffix_blocked": self.constant})
        scored = self.model.transform(self._assembled(joined))
        return scored.select(*urls.columns, F.col("prediction").alias("blocked"), vector_to_array("probability")[1].alias("p_block"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block).

    A rule decides where one fits; else the classifier does. ``labelled`` (url, label) trains it; without,
    it learns from the pages that rules decide. Null URLs and those without ``://`` have empty parts and go
    to the classifier. Rows repeat as they come; only id and URL are read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "told": told})
    if labelled is None:
        labelled = urls.where("told IS NOT NULL").select("url", (F.col("told") == "block").cast("double").alias("label"))
    judged = UrlFilter().fit(labelled).block(urls)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("blocked") == 1, "block").otherwise("allow")).alias("verdict"))
