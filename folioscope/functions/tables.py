"""Markdown tables: rendering a cell grid and parsing one back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import let, strip


def clean_cell(cell: Column) -> Column:
    flat = F.regexp_replace(strip(F.coalesce(cell, F.lit(""))), r"(?U)\s+", " ")
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def format_markdown_table(grid: Column) -> Column:
    """``array<array<string>>`` to a Markdown table; '' when nothing is left."""
    cleaned = F.filter(
        F.transform(F.filter(grid, lambda r: r.isNotNull()), lambda r: F.transform(r, clean_cell)),
        lambda r: F.exists(r, lambda c: c != ""),
    )

    def padded(rows: Column) -> Column:
        return let(
            F.array_max(F.transform(rows, F.size)),
            lambda width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))),
        )

    def rendered(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        generic = F.when(width == 2, F.array(F.lit("Property"), F.lit("Record"))).otherwise(
            F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Col "), i.cast("string")))
        )
        single = F.size(rows) == 1
        header = F.when(single, generic).otherwise(F.get(rows, F.lit(0)))
        data = F.when(single, rows).otherwise(F.slice(rows, F.lit(2), F.size(rows)))
        rule = _line(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.array(_line(header), rule), F.transform(data, _line)), "\n")

    return let(cleaned, lambda rows: F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(let(padded(rows), rendered)))


def _cells(line: Column) -> Column:
    """Trimmed cells between the first and the last pipe."""
    return let(
        F.split(line, r"\|"),
        lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), strip),
    )


def parse_markdown_table(text: Column) -> Column:
    """``array<map<string,string>>``: one map per row as wide as the header.

    Repeated header names keep the last cell, as a dictionary would.
    """
    table = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda l: F.contains(l, F.lit("|")))

    def maps(lines: Column, header: Column, names: Column) -> Column:
        data = F.filter(
            F.transform(F.slice(lines, F.lit(3), F.size(lines)), _cells), lambda r: F.size(r) == F.size(header)
        )
        repeated = F.size(names) < F.size(header)

        def last_of(r: Column, n: Column) -> Column:
            return F.element_at(F.filter(r, lambda _, i: F.get(header, i) == n), -1)

        return F.transform(
            data,
            lambda r: F.map_from_arrays(
                names, F.when(repeated, F.transform(names, lambda n: last_of(r, n))).otherwise(r)
            ),
        )

    def parsed(lines: Column) -> Column:
        header = F.filter(_cells(F.get(lines, F.lit(0))), lambda h: h != "")
        return let(header, lambda h: let(F.array_distinct(h), lambda names: maps(lines, h, names)))

    empty = F.array().cast("array<map<string,string>>")
    return let(table, lambda lines: F.when(F.size(lines) >= 3, parsed(lines)).otherwise(empty))


def numeric_value(cell: Column) -> Column:
    """Digits, dots and minus signs of a cell read as one number, else null."""
    return F.regexp_replace(cell, r"[^\d.\-]", "").try_cast("double")
