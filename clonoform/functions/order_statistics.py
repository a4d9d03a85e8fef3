"""Exact order statistics of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.functions.grouped import join_groups
from clonoform.sources.staging import stage


def exact_quantiles(rows: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, float], ranges: int | None = None) -> DataFrame:
    """(groups, one column for each of ``wanted``: its quantile between 0 and 1, interpolated
    between the two values around it). NULLs don't count; a group without values is absent.

    Equal values are counted first and the counts dealt to ranges of (group, value), so a
    large group fills many of them. What each range holds of a group is a histogram, as long
    as there are ranges; it tells which range a wanted rank is in, and only the rows of such
    ranges are put in order, each range of a group by itself.
    """
    if not wanted or any(not 0 <= q <= 1 for q in wanted.values()):
        raise ValueError("quantiles must lie between 0 and 1")
    keys = [f"__g{i}" for i in range(len(groups))]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(groups, keys, strict=True)], F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    # -0.0 and 0.0 are one value
    counts = named.groupBy(*keys, (F.col("__v") + F.lit(0.0)).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = stage(counts.repartitionByRange(*([ranges] if ranges else []), *[F.col(k) for k in keys], F.col("__v")).withColumn("__range", F.spark_partition_id()), "value-ranges")
    histogram = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__n"))
    # a row a range
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    before = histogram.select(*keys, "__range", (F.sum("__n").over(own.orderBy("__range")) - F.col("__n")).alias("__before"), F.col("__n").alias("__size"), F.sum("__n").over(own).alias("__total"))
    place = F.array(*[F.lit(float(q)) for q in wanted.values()])
    # the places, from 0, of the values below and above each quantile
    at = F.flatten(F.transform(place, lambda q: F.array(F.floor(q * (F.col("__total") - 1)), F.ceil(q * (F.col("__total") - 1)))))
    holds = F.filter(F.array_distinct(at), lambda i: (i >= F.col("__before")) & (i < F.col("__before") + F.col("__size")))
    asked = before.withColumn("__at", holds).where(F.size("__at") > 0).select(*keys, "__range", "__before", "__total", "__at")
    some = join_groups(ranged, asked, [*keys, "__range"], "inner")
    end = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__v"))
    found = some.withColumn("__end", end).select(*keys, "__v", "__total", F.explode(F.filter("__at", lambda i: (i >= F.col("__end") - F.col("__n")) & (i < F.col("__end")))).alias("__i"))
    # two values at most for each quantile
    values = found.groupBy(*keys).agg(F.max("__total").alias("__total"), F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__m"))
    out = []
    for name, q in wanted.items():
        exact = F.lit(float(q)) * (F.col("__total") - 1)
        low, high = (F.element_at("__m", f(exact)) for f in (F.floor, F.ceil))
        share = exact - F.floor(exact)
        out.append(F.when(share == 0, low).otherwise((1 - share) * low + share * high).alias(name))
    return values.select(*[F.col(k).alias(c) for c, k in zip(groups, keys, strict=True)], *out)


def gini(counts: DataFrame, groups: Sequence[str], n: str) -> DataFrame:
    """Gini coefficient of the counts of each group (groups, gini).

    Only how often each count occurs is put in order. A group whose counts add up to N has
    less than the square root of 2 N different ones.
    """
    often = counts.groupBy(*groups, F.col(n).alias("__n")).agg(F.count(F.lit(1)).alias("__c"))
    number, often_d = F.col("__n").cast("double"), F.col("__c").cast("double")
    upto = often.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*groups).orderBy("__n")))
    # the places of c equal counts add up to c times the middle one
    places = often_d * (F.col("__upto") - (often_d - 1) / 2)
    total, size = F.sum(number * often_d), F.sum(often_d)
    value = 2 * F.sum(places * number) / (size * total) - (size + 1) / size
    return upto.groupBy(*groups).agg(F.coalesce(F.when(total > 0, value), F.lit(0.0)).alias("gini"))
