"""Numbers out of Markdown tables found in retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.functions.tables import numeric_value, parse_markdown_table
from folioscope.functions.text import contains_any
from folioscope.lexicon import TABLE_AGGREGATE_TRIGGERS
from folioscope.operators.verify import is_table_like


def column_stats(cells: DataFrame, keys: list[str], cell: str = "cell", *more: Column) -> DataFrame:
    """count, sum, avg, min, max of the numbers in ``cell``; zeros when none.  ``more``
    aggregates ride along."""
    value = F.col("_value")
    zero = F.lit(0.0)
    # Noise of the addition order is cut off before the two-digit rounding.
    total = rounded(F.sum(value), 6)
    return (
        cells.withColumn("_value", numeric_value(F.col(cell)))
        .groupBy(*keys)
        .agg(
            F.count(value).alias("n_values"),
            F.coalesce(rounded(total, 2), zero).alias("sum_value"),
            F.coalesce(rounded(total / F.count(value), 2), zero).alias("avg_value"),
            F.coalesce(F.min(value), zero).alias("min_value"),
            F.coalesce(F.max(value), zero).alias("max_value"),
            *more,
        )
    )


def parsed_tables(ranked: DataFrame) -> DataFrame:
    """Table-like chunks with their parsed ``rows``."""
    return ranked.where(is_table_like()).withColumn("rows", parse_markdown_table(F.coalesce("content", F.lit(""))))


def wants_aggregates(question: Column) -> Column:
    return contains_any(F.lower(question), TABLE_AGGREGATE_TRIGGERS)


def table_aggregates(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Stats of every numeric column, all tables of a query pooled.

    Which columns are numeric is read off the first row of the first table.  Tables are
    parsed once: the first cell of every column is kept next to its stats, so a query
    with very many rows is combined on the map side.
    """
    asking = queries.where(wants_aggregates(F.col("question"))).select("query_id")
    tables = parsed_tables(ranked.join(asking, "query_id", "left_semi"))
    # an inner explode would parse every table a second time, for a filter on its rows
    cells = tables.select("query_id", "rank", F.posexplode_outer("rows").alias("row_no", "row")).select(
        "query_id", "rank", "row_no", F.posexplode("row").alias("column_no", "column", "cell")
    )
    first = F.min(F.struct("rank", "row_no", "column_no", "cell")).alias("_first")
    stats = column_stats(cells, ["query_id", "column"], "cell", first)
    place = F.struct("_first.rank", "_first.row_no")
    top = F.min(place).over(Window.partitionBy("query_id"))  # one row per column
    return (
        stats.withColumn("_top", top)
        .where((place == F.col("_top")) & F.rlike(F.col("_first.cell"), F.lit(r"\d+")))
        .withColumn("column_no", F.col("_first.column_no"))
        .drop("_first", "_top")
    )


def table_summary(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """has_tables, tables_found, total_rows and the stacked sources per query."""
    source = F.concat(
        F.lit("**Source: ["), F.col("document_name"), F.lit(", Page "), F.col("page_number").cast("string"), F.lit("]**\n"), F.col("content")
    )
    found = (
        parsed_tables(ranked)
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("tables_found"),
            F.sum(F.size("rows")).alias("total_rows"),
            F.array_sort(
                F.collect_list(F.when(F.size("rows") > 0, F.struct("rank", source.alias("text"))))
            ).alias("_parts"),
        )
    )
    return (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            F.col("tables_found").isNotNull().alias("has_tables"),
            F.coalesce("tables_found", F.lit(0)).alias("tables_found"),
            F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
            F.coalesce(F.array_join(F.transform("_parts", lambda p: p["text"]), "\n\n"), F.lit("")).alias("matrix_markdown"),
        )
    )


def collected_aggregates(aggregates: DataFrame) -> DataFrame:
    """(query_id, aggregates array) in column order, for prompts and answers."""
    return aggregates.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("column_no", "column", "n_values", "sum_value", "avg_value"))
        ).alias("aggregates")
    )
