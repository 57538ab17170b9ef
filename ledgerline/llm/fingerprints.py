"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

For each of SAMPLES samples a term has fixed draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), a function of the term alone. With
weight w it gives t = floor(ln w / r + b), y = exp(r (t - b)) and a = c exp(-r) / y; the sample is the (term, t) of the
least a. Two documents agree in a sample with a chance of their generalised Jaccard similarity, the sum of the lesser
weights over the sum of the greater ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_of, words

SAMPLES = 64
#: A draw takes DRAW_BITS bits of a hash and goes between two quantiles by as many bits more. Below the first and above the
#: last quantile, those more bits take a quantile of a table as fine again, so the tails are not cut off.
DRAW_BITS = 10
BLOCK = 2
#: Documents are sorted within ranges of about so many ids; ranks are interpolated between KNOTS quantiles.
RANGE_ROWS = 256
KNOTS = 64
#: Ranges are put in order within blocks of so many.
BLOCK_RANGES = 1_024


def gamma_quantile(p: float, above: float) -> float:
    """Where Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), has p below and above = 1 - p above; the smaller one
    counts."""
    low, high = 0.0, 80.0
    for _ in range(80):
        x = (low + high) / 2
        # below a half by the series, in which nothing cancels
        less = x * x / 2 - x**3 / 3 + x**4 / 8 - x**5 / 30 < p if x < 0.1 else 1 - (1 + x) * math.exp(-x) < p if p < 0.5 else (1 + x) * math.exp(-x) > above
        low, high = (x, high) if less else (low, x)
    return high


def gamma_table(n: int, log: bool) -> list[float]:
    """Three times n + 1 knots: quantiles of k / n; of k / n / n, below the first of those; of 1 - 1 / n + k / n / n, above the
    last. At the open ends a knot is such that the middle of its share is right."""
    value = lambda p, above: math.log(gamma_quantile(p, above)) if log else gamma_quantile(p, above)
    inner = [0.0, *(value(k / n, 1 - k / n) for k in range(1, n)), 0.0]
    low = [value(k / n / n, 1.0) for k in range(1, n + 1)]
    high = [value(0.99, (n - k) / n / n) for k in range(n)]
    return [*inner, 2 * value(0.5 / n / n, 1.0) - low[0], *low, *high, 2 * value(0.99, 0.5 / n / n) - high[-1]]


def counted(df: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """keys, _h, own, edit: each distinct word's hash with the logarithms of how often it occurs in the texts one and two,
    null for never; a row with a null hash for a row without words. df must be partitioned by a part of keys, so that
    its rows stay where they are."""
    both = df.select(*keys, words(F.col(one)).alias("_a"), words(F.col(two)).alias("_b"))
    each = both.select(*keys, F.size("_a").alias("_n1"), F.posexplode_outer(F.concat("_a", "_b")).alias("_p", "_x"))
    is_one = F.col("_p") < F.col("_n1")
    each = each.select(*keys, F.when(F.col("_x").isNotNull(), F.xxhash64("_x")).alias("_h"), F.when(is_one, 1).otherwise(0).alias("v"), F.when(is_one, 0).otherwise(1).alias("w"))
    sums = each.groupBy(*keys, "_h").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    log = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))
    none = lambda c: F.when(F.col("_h").isNotNull(), log(c))
    return sums.select(*keys, "_h", none("v").alias("own"), none("w").alias("edit"))


def samples(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, own and edit: arrays of SAMPLES ints, null for a text without terms, of terms (keys, _h, own, edit). A sample
    is the least of longs that hold a in the high and the name of (term, t) in the low half.

    A term is read for BLOCK samples at a time, which keeps the generated code small enough to be compiled to machine
    code; the rows stay in their partition."""
    n = 1 << DRAW_BITS
    # spelled as text: folded to one constant array instead of an expression for each value
    constants = lambda xs: F.expr("from_json('[" + ",".join(f"{x:.8g}" for x in xs) + "]', 'array<double>')")
    tables = {log: constants(gamma_table(n, log)) for log in (False, True)}
    rows = terms.withColumn("_b", F.explode(F.array(*[F.lit(i) for i in range(0, SAMPLES, BLOCK)])))
    bits = lambda k, at, size: F.shiftrightunsigned(f"_u{k}", at).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
    share = lambda x, size: (x + 0.5) / float(1 << size)
    rows = rows.select(*keys, "_b", "_h", "own", "edit", *[F.xxhash64("_h", F.col("_b") + k).alias(f"_u{k}") for k in range(BLOCK)])

    def draw(k: int, at: int, rest: Column) -> tuple[Column, Column]:
        """Knot and the part of the way to the next one, for the bits from at on and rest as that part in the tails."""
        place, more = bits(k, at, DRAW_BITS), bits(k, at + DRAW_BITS, DRAW_BITS)
        tail = (place == 0) | (place == n - 1)
        return F.when(place == 0, more + (n + 1)).when(place == n - 1, more + (2 * n + 2)).otherwise(place), F.when(tail, rest).otherwise(share(more, DRAW_BITS))

    draws = []
    for k in range(BLOCK):
        (i, x), (j, y) = draw(k, 0, F.lit(0.5)), draw(k, 2 * DRAW_BITS, share(bits(k, 4 * DRAW_BITS, 8), 8))
        draws += [i.alias(f"_i{k}"), x.alias(f"_x{k}"), j.alias(f"_j{k}"), y.alias(f"_y{k}"), share(bits(k, 4 * DRAW_BITS + 8, 16), 16).alias(f"_d{k}")]
    rows = rows.select(*keys, "_b", "_h", "own", "edit", *draws)
    between = lambda table, at, part: F.get(table, F.col(at)) + (F.get(table, F.col(at) + 1) - F.get(table, F.col(at))) * F.col(part)
    draws = [c for k in range(BLOCK) for c in (between(tables[False], f"_i{k}", f"_x{k}").alias(f"_r{k}"), between(tables[True], f"_j{k}", f"_y{k}").alias(f"_c{k}"), F.col(f"_d{k}"))]
    rows = rows.select(*keys, "_b", "_h", "own", "edit", *draws)
    aggregates = []
    for k in range(BLOCK):

        def packed(weight: str, r: Column = F.col(f"_r{k}"), ln_c: Column = F.col(f"_c{k}"), b: Column = F.col(f"_d{k}")) -> Column:
            t = F.floor(F.col(weight) / r + b)
            grid = F.floor((ln_c - r - r * (t - b)) * float(1 << 22)).cast("long")
            return F.shiftleft(grid, 32).bitwiseOR(F.col("_h").bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF)))

        aggregates += [F.min(packed("own")).alias(f"own{k}"), F.min(F.when(F.col("own") == F.col("edit"), packed("own")).otherwise(packed("edit"))).alias(f"edit{k}")]
    least = rows.groupBy(*keys, "_b").agg(*aggregates)
    name = lambda c: F.array(*[F.shiftleft(F.col(f"{c}{k}"), 32) for k in range(BLOCK)])
    blocks = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", name("own").alias("own"), name("edit").alias("edit")))).alias("_s"))
    low = lambda c: F.transform(F.flatten(F.col(f"_s.{c}")), lambda x: F.shiftright(x, 32).cast("int"))
    return blocks.select(*keys, *[F.when(F.get(F.get(F.col(f"_s.{c}"), 0), 0).isNotNull(), low(c)).alias(c) for c in ("own", "edit")])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without terms are alike, one without is unlike any other."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / F.lit(float(SAMPLES)))


def spelled(a: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def in_ranges(docs: DataFrame, key: str) -> DataFrame:
    """docs with _range: ids of a range are larger than those of the next, about RANGE_ROWS documents in each. One scan
    of the ids estimates KNOTS quantiles, the only thing that reaches the driver; between two of them ranks are
    interpolated, so there can be any number of ranges. Null ids come last."""
    told = docs.agg(F.percentile_approx(key, [k / KNOTS for k in range(KNOTS + 1)], 10_000).alias("q"), F.count(key).alias("n")).first()
    knots = sorted(set(told["q"] or []), reverse=True)
    if len(knots) < 2:
        return docs.withColumn("_range", F.col(key).isNull().cast("long"))
    parts = max(1, -(-told["n"] // (RANGE_ROWS * (len(knots) - 1))))
    bounds = F.array(*[F.lit(x) for x in knots])
    at = F.least(F.greatest(F.size(F.filter(bounds, lambda x: x > F.col(key))), F.lit(1)), F.lit(len(knots) - 1))
    high, low = F.get(bounds, at - 1), F.get(bounds, at)
    share = F.least(F.greatest((high.cast("double") - F.col(key).cast("double")) / (high.cast("double") - low.cast("double")), F.lit(0.0)), F.lit(1.0))
    place = (at - 1) * parts + F.least(F.floor(share * parts), F.lit(parts - 1))
    return docs.withColumn("_range", F.when(F.col(key).isNull(), F.lit(parts * len(knots))).otherwise(place).cast("long"))


def _with_following(rows: DataFrame, heads: DataFrame, value: str) -> DataFrame:
    """rows (_range, ..) with _head: value of heads (_range, value: one row a range) of the next range that there is, of
    the first one for the last. Only numbers of ranges are put in order, within blocks, and then one row a block."""
    ranges = heads.select("_range", F.floor(F.col("_range") / BLOCK_RANGES).alias("_block"))
    turn = W.partitionBy(F.lit(0)).orderBy("_block")
    every = turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = ranges.groupBy("_block").agg(F.min("_range").alias("_m")).select("_block", F.coalesce(F.lead("_m").over(turn), F.first("_m").over(every)).alias("_then"))
    after = ranges.withColumn("_next", F.lead("_range").over(W.partitionBy("_block").orderBy("_range"))).join(blocks, "_block")
    after = after.select("_range", F.coalesce("_next", "_then").alias("_after"))
    found = after.join(heads.select(F.col("_range").alias("_after"), F.col(value).alias("_head")), "_after").select("_range", "_head")
    return rows.join(found, "_range")


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    Terms are words, weights how often they occur. The edited text has the last third of the code points replaced by the
    first as many of the next document by descending key, the last one's by the first document's. near_edited and
    near_next are the shares of samples in common with the edited text's and the next document's fingerprint.

    Null texts are empty and have the empty fingerprint, alike to each other only; rows with an equal or null key are
    ordered by a hash of their text, null keys last; a single document is its own next; no rows give no rows.

    The texts are shuffled once, into ranges of ids; all further steps stay within a range, but for one row a range."""
    ranged = in_ranges(docs.select(F.col(key).alias("_k"), text_of().alias("_t")), "_k").withColumn("_tie", F.xxhash64("_t"))
    first = ranged.groupBy("_range").agg(F.max(F.struct(F.col("_k").alias("k"), F.col("_tie").alias("h"), F.col("_t").alias("t")))["t"].alias("_t"))
    by = W.partitionBy("_range").orderBy(F.col("_k").desc_nulls_last(), F.col("_tie").desc())
    rows = ranged.withColumn("_n", F.row_number().over(by)).withColumn("_next", F.lead("_t").over(by))
    rows = _with_following(rows, first, "_t")
    size = F.length("_t")
    rows = rows.withColumn("_next", F.coalesce("_next", "_head")).drop("_head", "_tie")
    edited = F.concat(F.substr("_t", F.lit(1), size - F.floor(size / 3).cast("int")), F.substr("_next", F.lit(1), F.floor(size / 3).cast("int")))
    rows = rows.select("_range", "_n", "_k", "_t", edited.alias("_e"))
    told = rows.select("_range", "_n", "_k", F.length("_t").cast("long").alias("n_chars"), F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"))
    place = ["_range", "_n"]
    signed = materialize(samples(counted(rows, place, "_t", "_e"), place).join(told, place), "signed")
    heads = signed.filter("_n = 1").select("_range", "own")
    after = F.lead(F.struct("own")).over(W.partitionBy("_range").orderBy("_n"))
    out = _with_following(signed.withColumn("_next", after), heads.select("_range", F.struct("own").alias("own")), "own")
    out = out.withColumn("_next", F.coalesce("_next", "_head")["own"])
    return out.select(
        F.col("_k").alias(key), "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("_next")).alias("near_next"),
    )
