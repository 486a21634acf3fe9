"""Quality rules whose joint rejections carry a guarantee. Column expressions only.

All rules of a stratum are tightened together along one path of settings that is fixed without looking at labels: a
setting z cuts each rule at its median plus z times its lower spread, both taken from the rows without labels. Labelled
rows are a holdout. From the most lenient setting on, a setting holds if the exact (Clopper-Pearson) upper bound of
the share of good rows that any rule rejects stays under `max_rejected`. The settings are nested and tested in order,
so they need no correction among themselves, whatever the number of rules; strata are corrected by Bonferroni. So the
guarantees hold together with probability `1 - risk`. Of the settings that hold, the one with the best gain is taken.
With 4 strata, a rate of 0.05 and a risk of 0.05 a stratum needs 86 good labels, if none of them is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import materialize, word_array

MAX_REJECTED = 0.05
RISK = 0.05
#: A lost good document counts as much as so many caught bad ones.
GOOD_WEIGHT = 10.0
WINDOW_WORDS = 8
#: Rule scores are whole numbers; above this they grow with the logarithm, a thousand a doubling.
LINEAR_SCORE = 10_000
#: Settings of the path, from lenient to strict, and the least spread of a rule.
PATH = tuple(round(200 * 0.92**t, 3) for t in range(64))
MIN_SPREAD = 5


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks and n_distinct.

    A null text has no words and no characters. Everything is an expression over the row.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept_only = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    # The line and the word arrays are made once and dropped once measured.
    d = docs.withColumns({"_w": word_array(t), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    last = F.size("_w") - WINDOW_WORDS
    at = [F.get(F.col("_h"), F.lit(k)) for k in range(WINDOW_WORDS)]
    assert len(at) == WINDOW_WORDS
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW_WORDS)]))
    d = d.withColumn("_s", F.when(last >= 1, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_r", F.size(F.array_distinct("_s")) < F.size("_s"))
    return d.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        kept_only("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_r"), covered(F.col("_s"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        kept_only("[^A-Z]+").alias("n_upper"),
        kept_only("[^!?]+").alias("n_marks"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def covered(windows: Column) -> Column:
    """Words under windows that occur more than once, from the windows' hashes in text order."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.get(F.transform(F.array(pairs), _covered), F.lit(0))


def _covered(s: Column) -> Column:
    twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
    starts = F.sort_array(F.transform(twice, lambda x: x.i))
    first = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n"))
    add = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW_WORDS), x - a["last"])).alias("n"))
    return F.aggregate(starts, first, add, lambda a: a["n"])


def rule_scores() -> dict[str, Column]:
    """Rules as whole scores per mille; a document scores high on what is wrong with it."""

    def per(n: str, of: str) -> Column:
        x = F.floor(1000 * F.col(n) / F.greatest(F.col(of), F.lit(1)))
        return F.when(x <= LINEAR_SCORE, x).otherwise(LINEAR_SCORE + F.floor(1000 * F.log2(x / float(LINEAR_SCORE)))).cast("int")

    return {
        "symbols": per("n_symbols", "n_words"), "long_words": per("word_chars", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"), "same_words": F.lit(1000) - per("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1: Stirling's series at x + 8, taken down again."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.log(x + float(k))
    return series - down


def binomial_cdf(k: Column, n: Column, rate: Column | float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), for k up to n * rate (above that 1 is given, which no test accepts).

    Terms more than 60 standard deviations under k are below the smallest double and left out.
    """
    k, n = k.cast("double"), n.cast("double")
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    low = F.greatest(F.lit(0.0), F.floor(k - 60 * F.sqrt(n * rate) - 60))
    whole = _log_gamma(n + 1)
    term = lambda i: F.exp(whole - _log_gamma(i + 1) - _log_gamma(n - i + 1) + i * F.log(rate) + (n - i) * F.log(1 - rate))
    total = F.aggregate(F.sequence(low.cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    return F.when(k > n * rate, 1.0).otherwise(F.least(F.lit(1.0), total))


def _path(scored: DataFrame, rules: list[str]) -> DataFrame:
    """(stratum, one struct (mid, spread) per rule) from the rows without labels, or from all where a stratum has none."""
    each = scored.select("stratum", F.col("_q").isNull().cast("long").alias("free"), F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in rules])))
    # One row per stratum, rule and score from here on; scores of a rule are some ten thousand at most.
    hist = each.groupBy("stratum", "rule", "score").agg(F.sum("free").alias("free"), F.count("*").alias("every"))
    whole = W.partitionBy("stratum", "rule")
    weight = F.when(F.sum("free").over(whole) > 0, F.col("free")).otherwise(F.col("every"))
    h = hist.withColumn("c", weight)
    upto = whole.orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.select("stratum", "rule", "score", F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("n"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("score")))
    q = h.groupBy("stratum", "rule").agg(at(0.5).alias("mid"), at(0.1).alias("low"))
    q = q.select("stratum", "rule", F.struct("mid", F.greatest(F.col("mid") - F.col("low"), F.lit(MIN_SPREAD)).alias("spread")).alias("x"))
    return q.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("x"))).alias(f"p_{r}") for r in rules])


def _cut(rule: str, z: Column) -> Column:
    return F.col(f"p_{rule}.mid") + z * F.col(f"p_{rule}.spread")


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", quality: str = "quality", max_rejected: float = MAX_REJECTED, risk: float = RISK) -> DataFrame:
    """One row per stratum with a struct `cut` of one cutoff per rule; strata without a setting that holds have none.

    measured: key, stratum and the measures. A label of 1 is good, 0 bad; null labels are left out, and a
    key labelled both ways counts as bad. A rule rejects scores above its cutoff. All labelled rows that pass the
    base rules count, and null keys have no label.
    """
    rules = rule_scores()
    marked = labels.filter(F.col(quality).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(quality).alias("_q"))
    # Made into rows of their own, the measures are not computed anew wherever the filter uses them.
    row = F.struct(F.col(key).alias("_k"), F.col(stratum).alias("stratum"), base_failed().alias("_failed"), *[s.alias(r) for r, s in rules.items()])
    scored = measured.select(F.inline(F.array(row))).filter("not _failed").drop("_failed")
    scored = materialize(scored.join(marked, "_k", "left").drop("_k"), "scores")
    path = materialize(_path(scored, list(rules)).withColumnRenamed("stratum", "_s"), "path")
    held_out = scored.filter("_q is not null").join(path, F.col("stratum").eqNullSafe(F.col("_s")))
    zs = F.array(*[F.lit(z) for z in PATH])
    first = lambda r: F.size(F.filter(zs, lambda z: F.col(r) <= _cut(r, z)))
    # A row falls at the first setting at which any rule rejects it; len(PATH) is never.
    falls = held_out.select("stratum", F.least(*[first(r) for r in rules]).alias("at"), (F.col("_q") >= 1).cast("long").alias("good"))
    steps = materialize(falls.groupBy("stratum", "at").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")), "holdout")
    strata = steps.select("stratum").distinct().count()
    whole = W.partitionBy("stratum")
    upto = whole.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = steps.select("stratum", "at", F.sum("g").over(whole).alias("n"), F.sum("b").over(whole).alias("m"), F.sum("g").over(upto).alias("k"), F.sum("b").over(upto).alias("caught")).filter(F.col("at") < len(PATH))
    # The bound is under the rate exactly if so few rejections are this unlikely at that rate. As k grows along the path, the settings that hold are its beginning.
    holds = binomial_cdf(F.col("k"), F.col("n"), max_rejected) <= risk / max(strata, 1)
    gain = F.col("caught") / F.greatest("m", F.lit(1)) - GOOD_WEIGHT * F.col("k") / F.greatest("n", F.lit(1))
    held = h.filter(holds & (F.col("caught") > 0)).withColumn("gain", gain).filter("gain > 0")
    best = held.groupBy("stratum").agg(F.max_by("at", F.struct("gain", -F.col("at"))).alias("at"))
    z = F.get(zs, F.col("at"))
    chosen = best.join(path, F.col("stratum").eqNullSafe(F.col("_s")))
    return chosen.select("stratum", F.struct(*[F.floor(_cut(r, z)).cast("int").alias(r) for r in rules]).alias("cut"))


def judged(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept. A stratum without cutoffs keeps what passes the base rules; null is a stratum."""
    over = F.lit(False)
    for r, s in rule_scores().items():
        over = over | F.coalesce(s > F.col(f"cut.{r}"), F.lit(False))
    d = measured.join(cuts.withColumnRenamed("stratum", "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "cut")


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, measures, base_failed, kept) per row of docs.

    Null keys are judged, but have no label. Repeated rows are judged alike. Without labels only the base
    rules reject. Texts of any length are measured whole, in arrays of their words. Empty tables give no rows; other
    columns are not read.
    """
    d = materialize(measures(docs.select(key, stratum, text), text).drop(text), "measures")
    return judged(d, materialize(cutoffs(d, labels, key, stratum), "cutoffs"), stratum)


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of docs that `quality` keeps, with their own columns, which may have any name; nulls, repeated rows and empty tables as there.

    Texts are measured in two passes, one for the cutoffs and one for the verdicts, so they are not shuffled.
    """
    d = measures(docs.select(key, stratum, text), text).drop(text)
    cuts = materialize(cutoffs(d, labels, key, stratum), "cutoffs")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = measures(own, names[text])
    # Made into rows of their own, the measures are not computed anew wherever the filter uses them.
    found = found.select(*names.values(), F.inline(F.array(F.struct(*[c for c in found.columns if c not in names.values()]))))
    kept = judged(found, cuts, names[stratum]).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
