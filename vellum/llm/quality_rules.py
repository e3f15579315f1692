"""Quality rules: base counts of texts and a learned decision list, in DataFrame functions only.

Learning is sequential covering. Labelled documents are split by a hash into a growing and a pruning part. A rule grows one
threshold condition at a time, the one with the largest information gain over per-feature histograms of labels (one grouped
count a step; the driver sees bins, never documents), and is pruned from its end while precision on the pruning part does
not fall. It is kept if it is precise enough there; what it covers leaves both parts, and the next rule is grown. The
ordered list is a Spark conditional expression.

Rows: null texts count as empty: all counts 0, base_failed true. Labels without a document, documents without a label and
null labels teach nothing; a document with several labels counts as bad if any says so. Without both kinds of label the
list is empty and keeps all. Very long texts stay one row's arrays of 64-bit hashes. Other columns, whatever their names,
are not read, or kept as they are by `judge` unless they have a name of its results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, materialize, where_computed, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: The list is learned from at most this many labelled documents, those with the lowest hashes of their ids.
SAMPLE = 6_000
BINS = 32


def base_counts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the base counts (long) as columns named prefix + name; df has no column that begins with __."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = lambda name: f"__{name}"
    # One projection a level: each is used more than once by the next, so it is computed once a row.
    df = df.withColumn(own("words"), words_of(F.col(text)))
    df = df.withColumns({own("n"): F.size(own("words")).cast("long"), own("h"): F.transform(own("words"), lambda w: F.xxhash64(w))})
    pair = F.zip_with(own("h"), F.slice(own("h"), 2, F.greatest(F.col(own("n")).cast("int"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(own("pairs"), pair).drop(own("words"))
    many = F.greatest(F.col(own("n")).cast("int"), F.lit(1))
    four = F.zip_with(own("pairs"), F.slice(own("pairs"), 3, many), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice(own("h"), 5, many), lambda a, b: F.xxhash64(a, b))
    five = F.when(F.col(own("n")) >= 5, F.slice(five, 1, F.greatest(F.col(own("n")).cast("int") - 4, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(own("five"), five).drop(own("h"), own("pairs"))
    # Windows in the order of their hashes: equal ones stand side by side.
    sorted_windows = F.when(F.size(F.array_distinct(own("five"))) < F.size(own("five")), F.array_sort(F.transform(own("five"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn(own("sorted"), sorted_windows).drop(own("five"))
    twice = F.zip_with(own("sorted"), F.slice(own("sorted"), 2, F.greatest(F.size(own("sorted")), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(own("at"), F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop(own("sorted"))
    gaps = F.zip_with(own("at"), F.slice(own("at"), 2, F.greatest(F.size(own("at")), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(own("lines"), lines)
    values = {
        "n_words": F.col(own("n")),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("long"),
        "n_repeat_words": covered,
    }
    return df.withColumns({prefix + k: v for k, v in values.items()}).drop(own("n"), own("at"), own("lines"))


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def features(text: str = "text", prefix: str = "") -> dict[str, Column]:
    """What conditions test, as ratios that do not grow with the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, chars = F.greatest(F.col(prefix + "n_words"), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    without = lambda some: F.length(t) - F.length(F.regexp_replace(t, f"[{some}]+", ""))
    return {
        "word_length": F.col(prefix + "word_chars") / n,
        "symbols_a_word": F.col(prefix + "n_symbols") / n,
        "dup_lines_a_word": F.col(prefix + "n_dup_lines") / n,
        "repeated_share": F.col(prefix + "n_repeat_words") / n,
        "capital_share": without("A-Z") / chars,
        "mark_share": without("!?") / chars,
        "digit_share": without("0-9") / chars,
        "stop_share": without(".,;") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.cut) if self.above else of[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all_of(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Features and `bad` of at most `sample` labelled documents."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return where_computed(base_counts(found), ~base_failed()).select("doc_id", "bad", *[v.cast("double").alias(k) for k, v in features().items()])


def _midway(rows: DataFrame, c: Condition, of: dict[str, Column]) -> Condition:
    """The condition with its cut midway between the nearest value that it spares and the nearest bad one that it rejects."""
    v = of[c.feature]
    spared, rejected = (v <= c.cut, v > c.cut) if c.above else (v > c.cut, v <= c.cut)
    near, edge = (F.max, F.min) if c.above else (F.min, F.max)
    ends = rows.agg(near(F.when(spared, v)).alias("spared"), edge(F.when(rejected & F.col("bad"), v)).alias("bad")).first()
    return c if None in ends else Condition(c.feature, c.above, (ends["spared"] + ends["bad"]) / 2)


def learn(sample: DataFrame, *, most_rules: int = 6, most_conditions: int = 3, precision: float = 0.97, least: int = 12) -> list[Rule]:
    """An ordered list of rules that reject, from rows of `doc_id`, boolean `bad` and numeric features."""
    names = [c for c in sample.columns if c not in ("doc_id", "bad")]
    rows = sample.withColumn("prune", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0)
    of = {c: F.col(c) for c in names}
    shares = [i / BINS for i in range(BINS)]
    # Of distinct values, so that a value which most rows have isn't the only cut.
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), of[c].alias("v")) for c in names])).alias("x")).select("x.f", "x.v").distinct()
    found = {r["f"]: r["v"] for r in each.groupBy("f").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("v")).collect()}
    cuts = {c: sorted({float(x) for x in found.get(c) or ()}) for c in names}
    # A feature's bin: how many of its cuts lie below the value.
    bins = {c: sum([(of[c] > F.lit(x)).cast("int") for x in cuts[c]], F.lit(0)) for c in names}
    binned = materialize(rows.select("*", *[b.alias(f"bin_{c}") for c, b in bins.items()]), "binned").coalesce(4)

    def tally(df: DataFrame) -> tuple[int, int]:
        got = df.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return got["p"], got["n"]

    rules: list[Rule] = []
    left = binned
    while len(rules) < most_rules:
        rule: Rule = ()
        grow = left.where(~F.col("prune"))
        while len(rule) < most_conditions:
            here = grow.where(_all_of(rule, of))
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"bin_{c}").alias("b")) for c in names])).alias("x")
            seen = here.select("bad", pairs).groupBy("x.f", "x.b", "bad").count().collect()
            count = {(r["f"], r["b"], r["bad"]): r["count"] for r in seen}
            total = [sum(v for (f, _, bad), v in count.items() if f == names[0] and bad == want) for want in (True, False)]
            if total[0] < least or not total[1]:
                break
            base, best = math.log2(total[0] / sum(total)), None
            for c in names:
                p = n = 0
                for i, cut in enumerate(cuts[c]):
                    p, n = p + count.get((c, i, True), 0), n + count.get((c, i, False), 0)
                    for above, p1, n1 in ((False, p, n), (True, total[0] - p, total[1] - n)):
                        if p1 >= least:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - base)
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, Condition(c, above, cut)
            if best is None or best[0] <= 1e-9:
                break
            rule += (_midway(here, best[1], of),)
        if not rule:
            break
        pruned = left.where("prune")
        scores = pruned.agg(*[F.count_if(_all_of(rule[:k], of) & (F.col("bad") if good else ~F.col("bad"))).alias(f"v{k}{int(good)}") for k in range(1, len(rule) + 1) for good in (True, False)]).first()
        score = lambda k: ((scores[f"v{k}1"] + 1) / (scores[f"v{k}1"] + scores[f"v{k}0"] + 2), scores[f"v{k}1"])
        k = max(range(1, len(rule) + 1), key=lambda k: (score(k)[0], score(k)[1], -k))
        exact = scores[f"v{k}1"] / max(1, scores[f"v{k}1"] + scores[f"v{k}0"])
        if scores[f"v{k}1"] < least / 3 or exact < precision:
            break
        rules.append(rule[:k])
        left = left.where(~_all_of(rule[:k], of))
        if not tally(left.where(~F.col("prune")))[0] >= least:
            break
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The ordered conditional expression: number of the first rule that rejects, 0: none."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(_all_of(rule, of), i) if out is None else out.when(_all_of(rule, of), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], prefix: str = "", text: str = "text") -> DataFrame:
    """docs with base counts, base_failed, rule (0: none) and kept, each named prefix + name; they replace columns of docs
    with these names."""
    new = [prefix + c for c in (*BASE, "base_failed", "rule", "kept")]
    # Other columns travel in one struct, so that none can clash.
    old = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in old]).alias("row"), F.col(f"`{text}`").alias("text"))
    counted = base_counts(rows, "text", prefix)
    counted = counted.withColumn(prefix + "base_failed", base_failed(prefix))
    counted = counted.withColumn(prefix + "rule", verdict(rules, features("text", prefix)).cast("int"))
    counted = counted.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0))
    place = {c: F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in [text, *old]}
    return counted.select(*[place[c] for c in docs.columns if c in place], *[F.col(f"`{c}`") for c in new])


__all__ = ["BASE", "SPACE", "base_counts", "base_failed", "features", "judge", "labelled_sample", "learn", "verdict"]
