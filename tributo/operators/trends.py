"""Analytic families: outliers of taxes, suppliers' rolling means, unit prices, monthly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Accuracy of the sketch of a group's ranks, and how many of its steps around a rank are kept apart.
SKETCH, REACH = 20_000, 3
#: Groups of more rows are narrowed to what lies near the wanted ranks, and how many of them, so that they can be broadcast.
LARGE, HOTTEST = 1 << 20, 4_096


def _stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"))


def zscores(rows: DataFrame, keys: list[str], value: str, limit: float = 3.0, *, few: bool = False) -> DataFrame:
    """rows with z, the distance from their group's mean in standard deviations, of those beyond the limit.

    Groups are summed first and joined back. Where there are few groups, as the caller knows, the sums go to the rows, which
    otherwise are dealt by group.
    """
    stats = _stats(rows, keys, value)
    joined = rows.join(F.broadcast(stats) if few else stats, keys)
    z = F.when(F.col("_sd") > 0, (F.col(value).cast("double") - F.col("_mean")) / F.col("_sd"))
    return joined.withColumn("z", F.round(z, 6)).where(F.abs("z") > limit).drop("_mean", "_sd")


def _narrowed(rows: DataFrame, keys: list[str], at: dict[str, float], large: int) -> DataFrame:
    """keys, _v, _c and _gap of each group: counted values, those of a large group only around its wanted ranks.

    Groups are counted first, and only large ones are sketched, which gives values that surely lie below and above each
    rank. What lies between two such brackets is counted under the upper end of the one before it, as one row with _gap
    set, so ranks stay what they are. Only the HOTTEST largest groups are narrowed; each of the others has less than a
    HOTTEST-th of the rows. Without large groups the sketch is of nothing, which Spark sees when it has counted.
    """
    reach = REACH / SKETCH
    points = [x for p in at.values() for x in (max(0.0, p - reach), min(1.0, p + reach))]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    largest = sizes.where(F.col("_size") > large).orderBy(F.desc("_size"), *keys).limit(HOTTEST).select(*keys)
    hot = rows.join(F.broadcast(largest), keys).groupBy(*keys).agg(F.percentile_approx("_v", [float(x) for x in points], SKETCH).alias("_points"))
    bound = lambda i, p, out: F.lit(float("-inf" if i % 2 == 0 else "inf")) if out else F.col("_points")[i]
    ends = [bound(i, x, (x <= 0.0) if i % 2 == 0 else (x >= 1.0)) for i, x in enumerate(points)]
    brackets = list(zip(ends[::2], ends[1::2], strict=True))
    # A row for each of at most HOTTEST groups.
    marked = rows.join(F.broadcast(hot), keys, "left")
    inside = F.col("_points").isNull()
    for low, high in brackets:
        inside = inside | F.col("_v").between(low, high)
    before = [F.when(high < F.col("_v"), high).otherwise(float("-inf")) for _, high in brackets]
    passed = F.greatest(*before) if len(before) > 1 else before[0]
    return marked.select(*keys, F.when(inside, F.col("_v")).otherwise(passed).alias("_v"), (~inside).alias("_gap")).groupBy(*keys, "_v", "_gap").agg(F.count("*").alias("_c"))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], *, large: int = LARGE) -> DataFrame:
    """keys, n and the exact quantiles (between two values in proportion) under their names.

    Nulls don't count, and groups with a null key have none. Ranks are selected, not sorted for: a first pass sketches
    each group, a second counts all values but keeps apart only those near the wanted ranks of groups of over ``large``
    rows, so no window goes over such a group. A rank that the sketch had misplaced would fall into a gap; that raises an
    error and never gives another value.
    """
    own = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = _narrowed(own, keys, at, large)
    up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v", "_gap").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_up", up_to).join(counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    first = lambda rank: F.min(F.when(F.col("_up") > rank, F.struct("_v", "_gap")))
    sides = [x for q, p in at.items() for x in (first(F.floor(place(p))).alias(f"_a_{q}"), first(F.ceil(place(p))).alias(f"_b_{q}"))]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *sides)
    sure = lambda c: F.when(F.col(f"{c}._gap"), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col(f"{c}._v"))
    between = lambda q, p: sure(f"_a_{q}") + (sure(f"_b_{q}") - sure(f"_a_{q}")) * (place(p) - F.floor(place(p)))
    return found.select(*keys, F.col("_n").alias("n"), *[between(q, p).alias(q) for q, p in at.items()])


def quartile_outliers(rows: DataFrame, keys: list[str], value: str, reach: float = 1.5, *, few: bool = False) -> DataFrame:
    """rows beyond reach interquartile ranges from their group's quartiles, with the two fences; few as in zscores."""
    v = F.col(value).cast("double")
    q = quantiles(rows, keys, value, {"_a": 0.25, "_b": 0.75})
    fences = q.select(*keys, F.round(F.col("_a") - reach * (F.col("_b") - F.col("_a")), 6).alias("abaixo"), F.round(F.col("_b") + reach * (F.col("_b") - F.col("_a")), 6).alias("acima"))
    return rows.join(F.broadcast(fences) if few else fences, keys).where((v < F.col("abaixo")) | (v > F.col("acima")))


def price_quantiles(items: DataFrame, key: str = "ncm") -> DataFrame:
    """key, n (all items of it) and three quantiles of the unit price."""
    of = quantiles(items, [key], "valor_unitario", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).drop("n")
    count = items.groupBy(key).agg(F.count("*").alias("n"))
    return count.join(of, key, "left").select(key, "n", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


def monthly(docs: DataFrame, key: str | None = None) -> DataFrame:
    keys = [key] if key else []
    return docs.groupBy(*keys, text.month_key(F.col("data_emissao")).alias("mes")).agg(F.sum(F.coalesce(F.col("valor_total").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).alias("total"))


def against_before(docs: DataFrame, months: int, key: str | None = None) -> DataFrame:
    """Each month's total against the one so many months before: 1 a month on month, 12 year on year.

    A join on the month's number, so a gap in the months isn't taken for the month before.
    """
    sums = monthly(docs, key).where("mes is not null")
    number = F.substring("mes", 1, 4).cast("int") * 12 + F.substring("mes", 6, 2).cast("int")
    now = sums.withColumn("_m", number)
    keys = ["_m", *([key] if key else [])]
    then = now.select((F.col("_m") + months).alias("_m"), *([key] if key else []), F.col("total").alias("antes"))
    change = F.when(F.col("antes") > 0, F.round((F.col("total").cast("double") - F.col("antes").cast("double")) / F.col("antes").cast("double"), 6))
    return now.join(then, keys, "left").select(*([key] if key else []), "mes", F.col("total").cast("double").alias("total"), F.col("antes").cast("double").alias("antes"), change.alias("variacao"))


def supplier_rolling(docs: DataFrame, key: str = "emitente_nome", months: int = 3) -> DataFrame:
    """Each supplier's monthly total against the mean of its months before (by rows, so many at most)."""
    w = Window.partitionBy(key).orderBy("mes").rowsBetween(-months, -1)
    mean = F.avg(F.col("total").cast("double")).over(w)
    return monthly(docs, key).where("mes is not null").select(key, "mes", F.col("total").cast("double").alias("total"), F.round(mean, 4).alias("media_movel"), F.round(F.when(mean > 0, F.col("total").cast("double") / mean - 1), 6).alias("desvio"))


def ewma(docs: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of each key's monthly totals, in order; a key has a row a month at most."""
    packed = monthly(docs, key).where("mes is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mes", F.col("total").cast("double").alias("x")))).alias("s"))
    smooth = F.aggregate("s", F.lit(None).cast("double"), lambda a, r: F.when(a.isNull(), r["x"]).otherwise((1 - alpha) * a + alpha * r["x"]))
    return packed.select(key, F.size("s").alias("meses"), F.round(smooth, 4).alias("ewma"))
