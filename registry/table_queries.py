"""Markdown tables of order lines: rendered, parsed back, aggregated."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.tables import format_markdown_table, parse_markdown_table
from folioscope.operators.tables import column_stats, table_aggregates, table_summary
from registry import inputs as I

PAGE = 50


def order_tables(spark, sf):
    """One Markdown table per order and page of at most fifty line numbers."""
    line = I.table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.floor(F.col("l_linenumber") / PAGE).alias("page"),
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"
        ).alias("r"),
    )
    cells = lambda r: F.array(
        r["l_linenumber"].cast("string"),
        r["l_quantity"].cast("int").cast("string"),
        r["l_extendedprice"].cast("decimal(12,2)").cast("string"),
        r["l_returnflag"],
    )
    header = F.array(F.array(*[F.lit(c) for c in ("Line", "Quantity", "Price", "Flag")]))
    return line.groupBy("l_orderkey", "page").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(
        "l_orderkey", "page", format_markdown_table(F.concat(header, F.transform("rs", cells))).alias("content")
    )


def md_table_format(spark, sf):
    return order_tables(spark, sf).select("l_orderkey", "page", F.md5("content").alias("table_md5"))


def md_table_parse(spark, sf):
    rows = order_tables(spark, sf).select("l_orderkey", F.explode(parse_markdown_table(F.col("content"))).alias("row"))
    return rows.select("l_orderkey", *[F.col("row")[c].alias(c.lower()) for c in ("Line", "Quantity", "Price", "Flag")])


def numeric_col_agg(spark, sf):
    rows = order_tables(spark, sf).select("l_orderkey", F.explode(parse_markdown_table(F.col("content"))).alias("row"))
    return column_stats(rows.select("l_orderkey", F.col("row")["Price"].alias("cell")), ["l_orderkey"])


def _questions(spark, sf):
    k = F.col("c_custkey") % 3
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.when(k == 0, "What is the total cost of these orders?").when(k == 1, "Describe these orders").otherwise("average price please").alias("question"),
    )


def _ranked(spark, sf):
    """Every order table of a customer, ranked by order."""
    owner = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query_id"))
    return order_tables(spark, sf).join(owner, "l_orderkey").select(
        "query_id",
        (F.col("l_orderkey") * 1000 + F.col("page")).alias("rank"),
        F.lit("table").alias("modality"),
        "content",
        F.concat(F.lit("order_"), "l_orderkey", F.lit(".pdf")).alias("document_name"),
        (F.col("page") + 1).alias("page_number"),
    )


def aggregates(spark, sf):
    out = table_aggregates(_questions(spark, sf), _ranked(spark, sf))
    return out.select("query_id", "column", "n_values", "sum_value", "avg_value", "min_value", "max_value")


def matrix(spark, sf):
    """Stacked sources of all tables of every customer."""
    out = table_summary(_questions(spark, sf), _ranked(spark, sf))
    return out.select("query_id", "has_tables", "tables_found", "total_rows", F.md5("matrix_markdown").alias("matrix_md5"))


QUERIES = {
    "md_table_format": md_table_format, "md_table_parse": md_table_parse, "numeric_col_agg": numeric_col_agg,
    "table_aggregates": aggregates, "table_matrix": matrix,
}
TABLES = """t AS (SELECT l_orderkey, l_linenumber // 50 AS page, count(*) AS n, '| Line | Quantity | Price | Flag |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || l_linenumber || ' | ' || l_quantity::INT || ' | ' || l_extendedprice::DECIMAL(12,2) || ' | ' || l_returnflag || ' |', chr(10)
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS content FROM lineitem GROUP BY ALL)"""
SQL = {
    "md_table_format": f"WITH {TABLES} SELECT l_orderkey, page, md5(content) AS table_md5 FROM t",
    "md_table_parse": "SELECT l_orderkey, l_linenumber::VARCHAR AS line, l_quantity::INT::VARCHAR AS quantity, l_extendedprice::DECIMAL(12,2)::VARCHAR AS price, l_returnflag AS flag FROM lineitem",
    "numeric_col_agg": """SELECT l_orderkey, count(*) AS n_values, sum(p)::DOUBLE AS sum_value, round_even(sum(p)::DOUBLE / count(*), 2) AS avg_value, min(p)::DOUBLE AS min_value, max(p)::DOUBLE AS max_value
      FROM (SELECT l_orderkey, l_extendedprice::DECIMAL(12,2) AS p FROM lineitem) GROUP BY l_orderkey""",
    "table_aggregates": """WITH b AS (SELECT o_custkey AS query_id, unnest(['Line', 'Quantity', 'Price']) AS "column", unnest([l_linenumber::DECIMAL(12,2), l_quantity::INT::DECIMAL(12,2), l_extendedprice::DECIMAL(12,2)]) AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 1)
      SELECT query_id, "column", count(*) AS n_values, sum(v)::DOUBLE AS sum_value, round_even(sum(v)::DOUBLE / count(*), 2) AS avg_value, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value FROM b GROUP BY ALL""",
    "table_matrix": f"""WITH {TABLES}, r AS (SELECT o_custkey, l_orderkey, page, n, content FROM t JOIN orders ON o_orderkey = l_orderkey),
      g AS (SELECT o_custkey, count(*) AS c, sum(n) AS n, string_agg('**Source: [order_' || l_orderkey || '.pdf, Page ' || (page + 1) || ']**' || chr(10) || content, chr(10) || chr(10) ORDER BY l_orderkey, page) AS m FROM r GROUP BY o_custkey)
      SELECT c_custkey AS query_id, c IS NOT NULL AS has_tables, coalesce(c, 0) AS tables_found, coalesce(n, 0) AS total_rows, md5(coalesce(m, '')) AS matrix_md5 FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
}
