"""Cost per component: what queries cost, split over what they touch, to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from billweave.operators.ranking import numbered
from billweave.operators.store import stored

EXACT = "decimal(38,0)"
# A query of more components than this is dealt out over tasks; others are looked at in one.
MANY = 100_000


def _shares(rows: DataFrame, weight: str) -> DataFrame:
    """Rows with _cents, _total and _parts of their query -> what each gets rounded down, and what is left."""
    weighted = F.when(F.col("_total") > 0, F.col(weight)).otherwise(F.lit(1).cast("bigint"))
    whole = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.col("_parts"))
    rows = rows.withColumns({"_size": F.abs("_cents"), "_weighted": weighted, "_whole": whole})
    # Integers where the product fits into 64 bits, else decimals, which take much longer.
    fits = (F.col("_size") < 1 << 31) & (F.col("_weighted") < 1 << 31)
    product = f"CAST(CAST(_size AS decimal(19,0)) * CAST(_weighted AS decimal(18,0)) AS {EXACT})"
    left = F.when(fits, F.expr("_size * _weighted % _whole")).otherwise(
        F.expr(f"CAST({product} % CAST(_whole AS {EXACT}) AS bigint)"))
    down = F.when(fits, F.expr("_size * _weighted div _whole")).otherwise(
        F.expr(f"CAST(({product} - CAST(_left AS {EXACT})) div CAST(_whole AS {EXACT}) AS bigint)"))
    return (rows.withColumn("_left", left).withColumn("_down", down)
            # the largest fraction first
            .withColumn("_rest", -F.col("_left")))


def apportion(parts: DataFrame, query: list[str], component: str = "component", cents: str = "cents",
              weight: str = "bytes", ranges: int | None = None) -> DataFrame:
    """``query``, component, weight and the whole cents that fall to each component of a query.

    ``parts`` has a row for each component of a query and the query's cents on each. Shares go by weight;
    what rounding down leaves over goes cent by cent to the largest fractions (ties: by name), so the
    parts of a query add up to its cents. Credits are split like costs. Without any weight the
    components count alike; a negative or missing weight counts as 0, missing cents as 0. A component
    named twice in a query is one. Parts are written once (``stored``) and shuffled by query; queries of more
    than ``MANY`` components are spread over tasks, in ``ranges`` (see ``numbered``).
    """
    grain = [*query, component]
    rows = stored(parts.groupBy(*grain).agg(
        F.max(F.coalesce(cents, F.lit(0))).cast("bigint").alias("_cents"),
        F.sum(F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0))).cast("bigint").alias(weight)))
    key = F.struct(*query).alias("_query")
    of_query = {"_cents": F.max("_cents"), "_total": F.sum(weight), "_parts": F.count(F.lit(1))}
    large = (rows.groupBy(*query).agg(*[value.alias(name) for name, value in of_query.items()])
             .filter(F.col("_parts") > MANY).select(key, "_cents", "_total", "_parts"))
    some = bool(large.take(1))
    few = rows.select("*", key).join(large, "_query", "left_anti").drop("_query") if some else rows
    one = W.partitionBy(*query)
    few = _shares(few.withColumns({name: value.over(one) for name, value in of_query.items()}), weight)
    ranked = few.withColumns({"_spare": F.abs("_cents") - F.sum("_down").over(one),
                              "_rank": F.row_number().over(one.orderBy("_rest", component))})
    columns = [*grain, weight, "_cents", "_down", "_spare", "_rank"]
    ranked = ranked.select(*columns)
    if some:
        many = _shares(rows.drop("_cents").select(key, "*").join(large, "_query").drop("_query"), weight)
        many = many.select(*grain, weight, "_cents", "_down", "_rest")
        spare = many.groupBy(*query).agg((F.max(F.abs("_cents")) - F.sum("_down")).alias("_spare"))
        ranked = ranked.unionByName(numbered(many, spare, query, ["_rest", component], {"_rank": F.lit(1)}, ranges)
                                    .select(*columns))
    part = F.col("_down") + F.when(F.col("_rank") <= F.col("_spare"), 1).otherwise(0)
    return ranked.select(*grain, weight, (F.signum(F.col("_cents")).cast("bigint") * part).alias("cents"))


def component_costs(parts: DataFrame, query: list[str], by: list[str], component: str = "component",
                    cents: str = "cents", weight: str = "bytes") -> DataFrame:
    """Per ``by`` (columns of ``query``) and component: queries that touch it, weight and cents."""
    return apportion(parts, query, component, cents, weight).groupBy(*by, component).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum(weight).alias(weight), F.sum("cents").alias("cents"))
