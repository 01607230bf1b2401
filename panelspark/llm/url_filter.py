"""URL verdicts: longest matching rule, else gradient-boosted trees.

DataFrame and SQL functions only. Lexical features of the url feed boosted
trees that learn from labelled URLs: those that a rule decides, unless a
labelled table is given. Suffix statistics (how common the host's last label
and its last two are among labelled URLs, and how often they are blocked) are
grouped counts; a training row is left out of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, discard, table

# The rules of the contract.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LOWER + "0123456789-_.~/?=&%#:+"
#: Bound of the labelled URLs that a fit uses.
MAX_TRAIN = 20_000
LEXICAL = (
    "n_url", "n_host", "n_path", "depth", "labels", "digits", "host_digits", "hyphens", "params", "escapes",
    "entropy", "https", "longest_label", "fragment", "extension",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null where none does.

    A rule fits its host and every subdomain if the path starts with its path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """``df(url, host, path)`` with the LEXICAL columns and the host's last labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    low = F.translate(url, UPPER, LOWER)
    gone = lambda c, chars: (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")
    part = lambda k: F.when(k > 0, -(k / n) * F.ln(k / n)).otherwise(0.0)
    counts = [gone(low, ch) for ch in ALPHABET]
    entropy = reduce(lambda a, b: a + b, [part(c) for c in [*counts, F.length(F.translate(low, ALPHABET, "")).cast("double")]])
    labels = F.split("host", r"\.")
    return df.withColumns({
        "suffix1": F.element_at(labels, -1),
        "suffix2": F.substring_index("host", ".", -2),
        "n_url": F.length(url).cast("double"),
        "n_host": F.length("host").cast("double"),
        "n_path": F.length("path").cast("double"),
        "depth": gone(F.col("path"), "/"),
        "labels": F.size(labels).cast("double"),
        "digits": gone(url, "0123456789") / n,
        "host_digits": gone(F.col("host"), "0123456789"),
        "hyphens": gone(F.col("host"), "-"),
        "params": F.when(F.instr(url, "?") > 0, gone(F.regexp_extract(url, r"\?([^#]*)", 1), "&") + 1).otherwise(0.0),
        "escapes": gone(url, "%"),
        "entropy": entropy,
        "https": low.startswith("https://").cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "fragment": (F.instr(url, "#") > 0).cast("double"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    })


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_train: int = MAX_TRAIN, seed: int = 7) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_score)`` for each row of ``pages(page_id, url)``.

    ``labelled(url, verdict)`` replaces the URLs that rules decide as training
    rows. Beyond ``max_train`` of them a hash of the url decides which are
    used. If they hold one verdict only, or none, unmatched URLs are allowed
    (score 0). Null, empty and malformed urls have empty host and path and are
    judged by their features; repeated rows each keep their row, an empty
    table gives none, further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))

    def parsed(df: DataFrame) -> DataFrame:
        return df.withColumn("host", host).withColumn("path", path)

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = parsed(pages.select("page_id", F.col("url").cast("string").alias("url")))
    base = base.withColumn("rule", rule).withColumn("given", verdict)
    known = base.where("given is not null").select("url", "host", "path", "given")
    if labelled is not None:
        known = parsed(labelled.where("verdict is not null").select("url", F.col("verdict").alias("given")))
    total = known.count()
    known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < min(1.0, max_train / max(total, 1)) * (1 << 20))
    train = cut(lexical(known).withColumn("y", (F.col("given") == "block").cast("double")))
    seen = train.agg(F.count("*"), F.sum("y")).first()
    out = base.select("page_id", "host", "path", "rule", "given")
    if not seen[0] or not 0 < seen[1] < seen[0]:
        discard(train)
        return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("block_score"))
    prior = float(seen[1] / seen[0])
    suffixes = ("suffix1", "suffix2")
    stats = {s: cut(train.groupBy(s).agg(F.count("*").alias(f"{s}_n"), F.sum("y").alias(f"{s}_y"))) for s in suffixes}
    inputs = [*LEXICAL, *(f"{s}_{what}" for s in suffixes for what in ("count", "block"))]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")

    def with_stats(df: DataFrame, own: Column | None = None) -> DataFrame:
        """Counts and smoothed block rates; a row with a label of its ``own`` is left out of them."""
        for s in suffixes:
            df = df.join(stats[s], s, "left").fillna({f"{s}_n": 0, f"{s}_y": 0.0})
            n, y = (F.col(f"{s}_n"), F.col(f"{s}_y")) if own is None else (F.col(f"{s}_n") - 1, F.col(f"{s}_y") - own)
            df = df.withColumns({f"{s}_count": F.log1p(n.cast("double")), f"{s}_block": (y + 5 * prior) / (n + 5)})
        return df

    fitted = GBTClassifier(featuresCol="features", labelCol="y", maxIter=10, maxDepth=3, seed=seed, cacheNodeIds=False).fit(
        assembler.transform(with_stats(train, F.col("y")).select("y", *inputs))
    )
    scored = fitted.transform(assembler.transform(with_stats(lexical(base))))
    scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    by_method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", by_method).alias("verdict"), "block_score")


def op2(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
