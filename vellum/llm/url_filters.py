"""URL filters: longest matching rule, and boosted trees over lexical features for URLs that no rule fits.

A rule is (pattern, verdict) with pattern host + path prefix, such as "example.org/es/". It fits the host and all its
subdomains where the URL's path starts with the rule's; the longest pattern wins. Rules are compiled into a map from host
to its path prefixes, longest first, and looked up for each suffix of a URL's host, so no row is shuffled.

The trees are trained on at most `sample` URLs that a rule decides (those with the lowest hashes); suffix statistics are the
share of blocked URLs under a host's last labels and first path part among them, smoothed. If the decided URLs have one
verdict only, others get that verdict; if there are none, allow.

Rows: a null URL or one without "://" has an empty host and path, no rule, and is judged by the trees from its features.
Repeated rows and null ids are judged like any other row. An empty table gives an empty result. Other columns are kept
where the names don't clash with host, path, rule and verdict, which replace those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize

#: At most this many rules are compiled; more raise an error.
MOST_RULES = 50_000
SAMPLE = 8_000
#: At most this many suffixes, the most frequent ones in the sample, get statistics.
SUFFIXES = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "host_labels", "digit_ratio", "entropy", "n_params", "query_length", "hyphens", "last_label", "last_labels", "first_part")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_suffixes(host: Column) -> Column:
    """A host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _compiled(rules: list[tuple[str, str]]) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    by_host: dict[str, list] = {}
    for pattern, verdict in rules:
        host, slash, path = pattern.partition("/")
        by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append((slash + path, pattern, verdict))
    entry = lambda p: F.struct(F.lit(p[0]).alias("path"), F.lit(p[1]).alias("rule"), F.lit(p[2]).alias("verdict"))
    # Of two verdicts for one pattern the first given counts: the sort is stable.
    return F.create_map(*[x for host, ps in by_host.items() for x in (F.lit(host), F.array(*[entry(p) for p in sorted(ps, key=lambda p: -len(p[0]))]))])


def match(df: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """df with host, path and `fit`, the longest rule that fits (rule, verdict; null: none)."""
    host, path = split_url(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    if not rules:
        return df.withColumn("fit", F.lit(None).cast("struct<path:string,rule:string,verdict:string>"))
    compiled, suffixes = _compiled(rules), host_suffixes(F.col("host"))
    fits = lambda x: F.filter(F.coalesce(F.element_at(compiled, x), F.array().cast("array<struct<path:string,rule:string,verdict:string>>")), lambda r: F.col("path").startswith(r["path"]))
    found = F.flatten(F.transform(suffixes, fits))
    longest = F.aggregate(found, F.lit(None).cast("struct<path:string,rule:string,verdict:string>"), lambda a, x: F.when(a.isNull() | (F.length(x["rule"]) > F.length(a["rule"])), x).otherwise(a))
    return df.withColumn("fit", longest)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df (with host and path) with the lexical features but suffix statistics, and the three suffix keys."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda t, some: F.length(t) - F.length(F.translate(t, some, ""))
    n = F.greatest(F.length(u), F.lit(1))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns({
        "length": F.length(u), "host_length": F.length("host"), "depth": count(F.col("path"), "/"), "host_labels": F.size(labels),
        "digit_ratio": count(u, "0123456789") / n, "entropy": entropy, "n_params": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "query_length": F.length(query), "hyphens": count(u, "-_"),
        "key_1": F.concat(F.lit("."), F.element_at(labels, -1)), "key_2": F.concat(F.lit(":"), F.substring_index("host", ".", -2)),
        "key_3": F.concat(F.lit("/"), F.element_at(F.split(F.concat("path", F.lit("//")), "/"), 2)),
    })


def _with_statistics(df: DataFrame, known: dict[str, float], base: float) -> DataFrame:
    stats = F.create_map(*[x for k, v in sorted(known.items()) for x in (F.lit(k), F.lit(v))]) if known else F.create_map(F.lit(""), F.lit(base))
    value = lambda key: F.coalesce(F.element_at(stats, F.col(key)), F.lit(base))
    df = df.withColumns({"last_label": value("key_1"), "last_labels": value("key_2"), "first_part": value("key_3")})
    return df.select("*", *[F.col(c).cast("double").alias(f"f_{c}") for c in FEATURES])


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", *, sample: int = SAMPLE, trees: int = 8, depth: int = 3) -> DataFrame:
    """df with host, path, rule and verdict (allow or block)."""
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url}`").cast("string").alias("url"))
    fitted = match(row, rules)
    decided = fitted.where("fit is not null and url is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    decided = decided.orderBy(F.xxhash64("url"), "url").limit(sample)
    train = materialize(lexical(decided), "urls").coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url")
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    fallback = "block" if set(classes) == {1.0} else "allow"
    if len(classes) == 2:
        base = classes[1.0] / sum(classes.values())
        # At most 3 keys a sampled URL; the rarest are left at the base share beyond SUFFIXES.
        keys = train.select("label", F.explode(F.array("key_1", "key_2", "key_3")).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
        known = {r["key"]: (r["s"] + 8 * base) / (r["n"] + 8) for r in keys.orderBy(F.desc("n"), "key").limit(SUFFIXES).collect()}
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        assemble = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=1, stepSize=0.3).fit(assemble.transform(_with_statistics(train, known, base)).select("features", "label"))
        scored = model.transform(assemble.transform(_with_statistics(lexical(fitted), known, base)))
        other = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    else:
        scored, other = fitted, F.lit(fallback)
    return scored.select(*[F.col(f"row.`{c}`") for c in keep], "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), other).alias("verdict"))
