"""Quality rules whose thresholds are certified: a document is rejected only by a cutoff for which a labelled holdout
shows, at an exact binomial bound, that few good documents of its stratum are rejected falsely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_of, words

SYMBOLS = r"[^#*$%&|<>]+"
#: Metric -> cutoffs from lenient to strict; a document with metric >= cutoff is rejected. Chosen before seeing data.
RULES = {
    "symbol_ratio": (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5),
    "mean_word_chars": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0),
}
#: What a stratum without labels is called in the result; nothing is certified for it.
OTHER = "(other)"
#: What a null stratum is called in the result. Within, other strata have a sign before their name, so none meets it.
NONE = "(null)"


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows of this width at these ascending positions."""
    steps = F.transform(positions, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(positions, k + 1) - p, F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def measure(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Counts of each whole text, all in one pass without a shuffle. Null text: no words. Equal 3-word windows are found
    by their 64-bit hash. keep: columns of docs to pass on; they must not be named like the counts."""
    df = docs.select(*keep, text_of(text).alias("_t"))
    df = df.select(
        *keep,
        words(F.col("_t")).alias("_w"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0).alias("_l"),
    )
    df = df.select(
        *keep, "n_symbols", "n_upper", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_h"),
    )
    df = df.drop("_w").withColumn(
        "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    same = lambda x, j: F.get("_s", j)["h"].eqNullSafe(x["h"])
    df = df.drop("_h").withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0))))), lambda x: x["i"])))
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_p"), 3), F.lit(0).cast("long"))).drop("_s", "_p", "_l")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def with_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
    })


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the exact chance of k or fewer successes in n draws with chance p: the term of k, then each from the
    one after it, down to 0 or to where 10 standard deviations and 100 terms leave nothing that a double could show. For k beyond
    the mean, which no certificate needs, the greatest terms are those summed last."""
    import math

    odds = math.log(p) - math.log1p(-p)
    size = n.cast("double")
    choose = lambda j: _log_factorial(size) - _log_factorial(j) - _log_factorial(size - j) + j * math.log(p) + (size - j) * math.log1p(-p)
    state = lambda term, top, total: F.struct(term.alias("term"), top.alias("top"), total.alias("total"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((j + 1).cast("double")) - F.log((n - j).cast("double")) - odds
        top = F.greatest(s["top"], term)
        return state(term, top, s["total"] * F.exp(s["top"] - top) + F.exp(term - top))

    first = choose(k.cast("double"))
    spread = F.ceil(F.lit(100.0) + 10 * F.sqrt(size * p * (1 - p)) + F.greatest(F.lit(0.0), k - size * p)).cast("long")
    steps = F.when(k > 0, F.sequence(k - 1, F.greatest(F.lit(0).cast("long"), k - spread), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, state(first, first, F.lit(1.0)), add, lambda s: s["top"] + F.log(s["total"]))


def _log_factorial(x: Column) -> Column:
    """Of whole numbers: the sum of logarithms up to 20, beyond it Stirling's series to a relative error below 1e-15."""
    import math

    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)]), F.least(x, F.lit(20.0)).cast("int") + 1)
    y = F.greatest(x, F.lit(20.0))
    series = y * F.log(y) - y + F.log(2 * math.pi * y) / 2 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return F.when(x <= 20, small).otherwise(series)


def certify(labelled: DataFrame, limit: float, error: float) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoff of each rule and stratum that rejects the most bad documents, the
    most lenient of equals. labelled: stratum, quality and the metrics.

    All cutoffs certified together hold with chance 1 - error: a share limit / #rules of good documents for each rule
    (so limit for all), error / (#strata * #rules) for each sequence of cutoffs, and within a sequence each is tested
    only if all more lenient ones passed, which needs no further correction."""
    import math

    rules, share = len(RULES), limit / len(RULES)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), (F.col(r) >= c).alias("hit")) for r, cs in RULES.items() for i, c in enumerate(cs)])
    good, hit = F.col("quality") == 1, F.col("c.hit")
    counts = (
        labelled.select("stratum", "quality", F.explode(cells).alias("c"))
        .groupBy("stratum", "c.rule", "c.step", "c.cutoff")
        .agg(F.count_if(good).alias("n"), F.count_if(good & hit).alias("k"), F.count_if(~good & hit).alias("bad"))
    )
    counts = counts.withColumn("_nth", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("stratum")))
    level = F.log(F.lit(error)) - F.log(F.max("_nth").over(W.partitionBy(F.lit(0))) * F.lit(float(rules)))
    tested = counts.withColumn("level", level).withColumn(
        "passed", F.when(F.col("k") > share * F.col("n"), F.lit(False)).otherwise(log_binomial_tail(F.col("n"), F.col("k"), share) <= F.col("level"))
    )
    in_order = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    ok = tested.withColumn("passed", F.min("passed").over(in_order)).filter("passed")
    return ok.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("bad", -F.col("step"))).alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", limit: float = 0.1, error: float = 0.1) -> DataFrame:
    """key, the counts of measure(), the metrics, base_failed, stratum, kept, rejected_by.

    labels: (key, quality 0 or 1). limit: share of a stratum's good documents that may be rejected, at confidence
    1 - error over all strata and rules together. Without enough labels nothing is certified and nothing rejected.

    Null text counts as empty; a null stratum is one of its own, also beside one named like it; rows with an equal or null key each give a row, a null
    key has no label; conflicting labels count as bad; no documents give no rows, no labels reject by base_failed only."""
    counted = materialize(with_metrics(measure(docs.select(F.col(key).alias("_k"), F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit(NONE)).alias("_g"), "text"), "_k", "_g")), "quality")
    quality = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("quality").alias("quality"))
    counted = counted.withColumnRenamed("_g", "stratum")
    marked = counted.filter(~F.col("base_failed")).join(quality, "_k")
    cutoffs = certify(marked, limit, error)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select("stratum", *[F.col(r).alias(f"_c_{r}") for r in RULES])
    wide = marked.select("stratum").distinct().withColumn("_labelled", F.lit(True)).join(wide, "stratum", "left")  # one row a stratum
    wide = materialize(wide, "cutoffs")
    one = counted.join(wide, "stratum", "left").withColumn("stratum", F.when(F.col("_labelled"), F.regexp_replace("stratum", "^=", "")).otherwise(OTHER))
    broken = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"_c_{r}"), F.lit(r)) for r in RULES]))
    return one.select(
        F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), "n_lines", "n_upper", *RULES, "stratum", F.array_join(broken, ",").alias("rejected_by"),
    )
