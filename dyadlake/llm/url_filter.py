"""URL filters: a host and path rule list, and gradient-boosted trees over lexical features for what no rule fits.

Features come from the URL alone, as SQL expressions: lengths, depth, digit ratio, character entropy, parameter counts,
hyphens and labels of the host, and statistics of its suffixes (how often a last or last-two-label suffix
was blocked among all labelled rows, repeated ones counted each, smoothed). Trees are trained by MLlib on at most ``SAMPLE`` labelled URLs, the first by a
hash of the URL, every split among a third of the features, so that no one of them decides alone and hosts that were never seen are told by what they share with others; all rows are scored. Of every suffix table the ``FREQUENT`` commonest keys are broadcast; if there are more, the other keys are joined by key.

Host: what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A rule fits its host and all subdomains, for paths that begin with its path; the longest wins.
Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated rows get the same result each; an empty table gives an empty one, and trees learned
from none or one class alone are no trees: the verdict is the share's; columns of the input named like an added one are replaced.
"""

from __future__ import annotations


from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

SAMPLE = 20_000
FREQUENT = 20_000
#: The rules of the registered query, (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words that mark a host as unwanted; they label the URLs that the registered query trains on.
SEEDS = ("adult", "bet", "bets", "bonus", "casino", "farm", "free", "loan", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "win", "xxx")

FEATURES = ("url_len", "host_len", "path_len", "depth", "host_labels", "first_label_len", "hyphens", "digit_ratio", "host_digits", "entropy", "params", "has_fragment", "letters_only", "longest_run", "suffix1", "suffix2")


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def fitting(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string and as its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(c: Column) -> Column:
    """Of the characters, in bits."""
    chars = F.array_sort(F.split(c, ""))
    n = F.greatest(F.size(chars), F.lit(1))
    # over equal neighbours of the sorted characters: sum of k log k
    folded = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct(x.alias("c"), F.when(x == a["c"], a["k"] + 1).otherwise(1).alias("k"), (a["s"] + F.when((x != a["c"]) & (a["k"] > 0), a["k"] * F.log2(F.greatest(a["k"], F.lit(1)).cast("double"))).otherwise(0.0)).alias("s")),
        lambda a: a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(F.greatest(a["k"], F.lit(1)).cast("double"))).otherwise(0.0),
    )
    return F.log2(n.cast("double")) - folded / n


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """The frame with host, path and the lexical features, all but the suffix statistics, and the keys of those."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = split(F.col(url))
    df = urls.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    n = F.size(labels)
    bare = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    first = F.substring_index(bare, ".", 1)
    d = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    count = lambda c, x: (F.length(c) - F.length(F.regexp_replace(c, x, ""))).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_len": F.length(u).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "host_labels": n.cast("double"), "first_label_len": F.length(first).cast("double"),
        "hyphens": count(F.col("host"), "-"), "digit_ratio": d(u) / F.greatest(F.length(u), F.lit(1)), "host_digits": d(F.col("host")), "entropy": entropy(first),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "has_fragment": F.contains(u, F.lit("#")).cast("double"),
        "letters_only": first.rlike("^[a-z]+$").cast("double"), "longest_run": F.array_max(F.transform(F.split(first, "[^bcdfghjklmnpqrstvwxz]+"), lambda x: F.length(x))).cast("double"),
        "key_suffix1": F.element_at(labels, -1), "key_suffix2": F.substring_index("host", ".", -2),
    })


def seed_label(host: Column) -> Column:
    """1.0 where a label of the host has a seed word among its parts."""
    parts = F.split(host, r"[.\-]")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SEEDS))).cast("double")


class Model:
    """Suffix statistics by name, the commonest keys and the others (None if there are none), and the trees over ``FEATURES`` (None if only one class was seen)."""

    def __init__(self, stats: dict[str, tuple[DataFrame, DataFrame | None]], trees: GBTClassificationModel | None, prior: float):
        self.stats, self.trees, self.prior = stats, trees, prior


def with_stats(df: DataFrame, stats: dict[str, tuple[DataFrame, DataFrame | None]], prior: float) -> DataFrame:
    """Suffix statistics joined to ``lexical``'s frame. Only rows whose key isn't among the commonest look for it by key; the others are spread."""
    for k, (common, others) in stats.items():
        df = df.join(F.broadcast(common), f"key_{k}", "left")
        if others is not None:
            seek = F.col(k).isNull()
            df = df.withColumns({"seek": seek, "seek_key": F.when(seek, F.col(f"key_{k}")).otherwise(F.pmod(F.xxhash64("url"), F.lit(4096)).cast("string"))})
            df = df.join(others.select(F.lit(True).alias("seek"), F.col(f"key_{k}").alias("seek_key"), F.col(k).alias("sought")), ["seek", "seek_key"], "left").withColumn(k, F.coalesce(k, "sought")).drop("seek", "seek_key", "sought")
        df = df.withColumn(k, F.coalesce(k, F.lit(prior)))
    return df


def suffix_stats(known: DataFrame) -> tuple[dict[str, tuple[DataFrame, DataFrame | None]], float]:
    """The statistics of all labelled rows, and the share blocked of them."""
    names = ("suffix1", "suffix2")
    keys = lexical(known).select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"key_{k}").alias("key")) for k in names])).alias("k"))
    counts = S.materialize(keys.groupBy("k.name", "k.key").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")))
    sums = {r["name"]: r for r in counts.groupBy("name").agg(F.count("*").alias("keys"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).collect()}
    prior = (sums["suffix1"].blocked + 1) / (sums["suffix1"].n + 2) if sums else 0.5
    stats = {}
    for k in names:
        own = counts.where(F.col("name") == k).select(F.col("key").alias(f"key_{k}"), ((F.col("blocked") + 20 * prior) / (F.col("n") + 20)).alias(k), "n")
        if not sums or sums[k]["keys"] <= FREQUENT:
            stats[k] = (own.drop("n"), None)
        else:
            common = S.materialize(own.orderBy(F.desc("n"), f"key_{k}").limit(FREQUENT).drop("n"))
            stats[k] = (common, own.drop("n").join(F.broadcast(common.select(f"key_{k}")), f"key_{k}", "left_anti"))
    return stats, prior


def train(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> Model:
    """From labelled URLs (label 1.0: block): statistics of all of them, trees from at most ``sample`` distinct ones."""
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna()
    stats, prior = suffix_stats(known)
    rows = S.sample_by_hash(known, "url", sample).groupBy("url").agg(F.max("label").alias("label"))
    seen = lexical(S.materialize(rows))  # at most `sample` rows
    total = seen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < total[1] < total[0]:
        return Model(stats, None, prior)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_stats(seen, stats, prior)).select("features", "label")
    trees = GBTClassifier(maxIter=30, maxDepth=3, seed=7, maxBins=32, featureSubsetStrategy="onethird").fit(vectors.coalesce(2))
    return Model(stats, trees, prior)


def judge(urls: DataFrame, model: Model, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, verdict and block_probability of every row; columns of these names are replaced."""
    added = ("host", "path", "rule", "verdict", "block_probability")
    kept = [c for c in urls.columns if c.lower() not in added]
    base = urls.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)], F.col(f"`{url}`").alias("url"))
    df = with_stats(lexical(base), model.stats, model.prior)
    if model.trees is None:
        df = df.withColumn("p", F.lit(float(round(model.prior))))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)
        df = model.trees.transform(vectors).withColumn("p", vector_to_array("probability")[1])
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    p = F.when(F.col("host") == "", 0.0).otherwise(F.col("p"))
    own = F.when(p >= 0.5, "block").otherwise("allow")
    return df.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)], "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), p.alias("block_probability"))


