"""Operator 7 (native): URL filtering by host and path rules, and by boosted trees where no rule decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: URLs that the trees are fitted on at most, chosen by a hash among those that a rule labels.
TRAINING_URLS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many URLs' worth of the overall share a suffix's own share of blocked URLs is drawn by.
PRIOR = 20.0
#: Folds that the training rows' own shares come from the others of.
FOLDS = 5
KEYS = ("suffix", "domain", "segment")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "letter_ratio", "other_ratio", "entropy", "parameters", "has_query", "has_fragment", "secure", "suffix_share", "domain_share", "segment_share")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of rules of one length the first in the alphabet."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = F.char_length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1.0)))
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.char_length(text).cast("double")

    def ratio(pattern: str) -> Column:
        return (n - F.char_length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1.0))

    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": n,
        "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.filter(F.split(host, r"\."), lambda s: s != "")).cast("double"),
        "digit_ratio": ratio(r"[0-9]"),
        "letter_ratio": ratio(r"[A-Za-z]"),
        "other_ratio": ratio(r"[^0-9A-Za-z]"),
        "entropy": entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
        "has_query": F.contains(text, F.lit("?")).cast("double"),
        "has_fragment": F.contains(text, F.lit("#")).cast("double"),
        "secure": text.startswith("https://").cast("double"),
    }


def _shares(counts: DataFrame, key: str, overall: float, fold: bool) -> DataFrame:
    """For each value of the key: the share of blocked URLs among the sampled ones, drawn towards the overall share.

    With fold, the share that rows of each fold see, which is that of the other folds: no row's own label is in its features.
    """
    whole = counts.groupBy(key).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    if fold:
        own = counts.groupBy(key, "fold").agg(F.sum("blocked").alias("own_blocked"), F.sum("n").alias("own_n"))
        whole = own.join(F.broadcast(whole), key).select(key, "fold", (F.col("blocked") - F.col("own_blocked")).alias("blocked"), (F.col("n") - F.col("own_n")).alias("n"))
    share = (F.col("blocked") + overall * PRIOR) / (F.col("n") + PRIOR)
    return whole.select(key, *["fold"] * fold, share.alias(f"{key}_share"))


@dataclass(frozen=True)
class Trees:
    """Boosted trees and the shares of suffixes, domains and first path segments, which the sample's size bounds."""

    model: GBTClassificationModel
    counts: DataFrame
    overall: float

    def features(self, keyed: DataFrame, fold: bool = False) -> DataFrame:
        for key in KEYS:
            keyed = keyed.join(F.broadcast(_shares(self.counts, key, self.overall, fold)), [key, *["fold"] * fold], "left")
        filled = keyed.withColumns({f"{key}_share": F.coalesce(f"{key}_share", F.lit(self.overall)) for key in KEYS})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(filled)

    def score(self, keyed: DataFrame) -> DataFrame:
        return self.model.transform(self.features(keyed)).withColumn("score", vector_to_array("probability")[1])


def with_keys(parsed: DataFrame) -> DataFrame:
    """parsed (url, host, path, ...) with what the trees look at, but for the shares."""
    keys = {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "segment": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))}
    return parsed.withColumns(keys).withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))


def fit(sample: DataFrame) -> Trees | None:
    """Trees from a checkpointed sample (url, host, path, label 0.0 or 1.0) of distinct URLs; None where it has one label only."""
    keyed = checkpoint(with_keys(sample).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(FOLDS)), F.lit(FOLDS))))
    n, blocked = keyed.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return None
    counts = checkpoint(keyed.groupBy(*KEYS, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")))
    trees = Trees(None, counts, blocked / n)
    known = checkpoint(trees.features(keyed, fold=True).select("features", "label"))
    return Trees(GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, seed=7, minInfoGain=1e-6).fit(known), counts, blocked / n)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", training_urls: int = TRAINING_URLS) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), score of every row.

    The verdict is that of the longest fitting rule. The other rows go by gradient-boosted trees on lexical features, fitted
    on a bounded sample of the URLs that rules label (allow 0, block 1), each distinct URL once: block where score, the trees'
    probability, is 0.5 or more. Where the labelled URLs have one verdict only, that is the verdict of the others; without any
    it is allow. Null URLs, and those without ://, have empty host and path, fit no rule and are scored like any other. Very
    long URLs are scored whole; repeated rows are judged alike. The pages are read three times.
    """
    host, path = parse_url(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": name, "ruled": verdict})
    labelled = ruled.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    # A hash of the URL draws all copies of one or none, and copies come down to one before they are shuffled.
    drawn = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < min(1_000_000, -(-training_urls * 1_000_000 // max(1, n)))
    trees = fit(checkpoint(labelled.where(drawn).select("url", "host", "path", "label").distinct())) if 0 < blocked < n else None
    if trees is None:
        other = "block" if n and 2 * blocked > n else "allow"
        return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.lit(other)).alias("verdict"), F.lit(float(other == "block")).alias("score"))
    return trees.score(with_keys(ruled)).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
