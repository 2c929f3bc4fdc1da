"""Tables whose cells have rows and columns: the filled grid, its confidence and its gaps.  Finding them is in ``regions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scores import clamp

TABLE = ["doc_id", "table_no"]


def piped_cells(documents: DataFrame) -> DataFrame:
    """Cells of texts with `` | `` between them: lines are rows, places follow from row and column."""
    lines = documents.where(F.col("text").contains(" | ")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = lines.where(F.col("line").contains(" | ")).withColumn("row_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    cells = rows.select("doc_id", F.lit(1).alias("table_no"), "row_index", F.posexplode(F.split("line", r" \| ", -1)).alias("column_index", "source_text"))
    x0, y0 = 72.0 + 60.0 * F.col("column_index"), 100.0 + 24.0 * F.col("row_index")
    return cells.withColumns({"x0": x0, "y0": y0, "x1": x0 + F.greatest(F.lit(8.0), F.least(F.lit(50.0), 5.0 * F.length("source_text"))), "y1": y0 + 14.0})


def columns(cells: DataFrame) -> DataFrame:
    """Columns of a table: extent, centre, support and number of distinct heights, left to right."""
    c = cells.groupBy(*TABLE, "column_index").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("support"), F.countDistinct(F.rint(F.col("y0") / 8)).alias("vertical_repetition")
    )
    return c.withColumn("center", (F.col("x0") + F.col("x1")) / 2)


def boundaries(cells: DataFrame) -> DataFrame:
    """Logical edges of columns: half way between neighbours' centres, but outside the column's own cells by 3 and its
    neighbours' by 2 and 3; x0 - 4 and x1 + 10 at the outer edges."""
    order = Window.partitionBy(*TABLE).orderBy("x0", "column_index")
    middle = lambda other: (other("center").over(order) + F.col("center")) / 2
    left = F.greatest(F.lag("x1").over(order) + 2, F.least(F.col("x0") - 3, middle(F.lag)))
    right = F.least(F.lead("x0").over(order) - 3, F.greatest(F.col("x1") + 3, middle(F.lead)))
    # greatest and least skip nulls: the outer edges are told by the neighbour's absence
    first, last = F.lag("x1").over(order).isNull(), F.lead("x0").over(order).isNull()
    c = columns(cells).withColumns({"__l": F.when(first, F.col("x0") - 4).otherwise(left), "__r": F.when(last, F.col("x1") + 10).otherwise(right)})
    crossed = F.col("__r") <= F.col("__l")
    c = c.withColumns({"left_boundary": F.when(crossed, F.col("x0") - 3).otherwise(F.col("__l")), "right_boundary": F.when(crossed, F.col("x1") + 6).otherwise(F.col("__r"))}).drop("__l", "__r")
    return c.withColumn("logical_width", F.col("right_boundary") - F.col("left_boundary"))


def grid(cells: DataFrame) -> DataFrame:
    """Every row and column of a table, absent cells as empty ones: rows times columns of one table, never of two."""
    rows, cols = cells.select(*TABLE, "row_index").distinct(), cells.select(*TABLE, "column_index").distinct()
    full = rows.join(cols, TABLE).join(cells.select(*TABLE, "row_index", "column_index", "source_text"), [*TABLE, "row_index", "column_index"], "left")
    text = F.coalesce("source_text", F.lit(""))
    return full.select(*TABLE, "row_index", "column_index", text.alias("source_text"), (F.trim(text) == "").alias("empty_cell"))


def diagnostics(cells: DataFrame) -> DataFrame:
    """Expected, present and missing cells of each table, with the missing places in order."""
    missing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("empty_cell"), F.struct("row_index", "column_index")))), lambda x: F.concat_ws(":", x["row_index"].cast("string"), x["column_index"].cast("string"))), ",")
    return grid(cells).groupBy(*TABLE).agg(
        F.countDistinct("row_index").alias("rows"), F.countDistinct("column_index").alias("columns"), F.count("*").alias("expected"),
        F.count_if(~F.col("empty_cell")).alias("mapped"), missing.alias("missing"),
    )


def confidence(cells: DataFrame) -> DataFrame:
    """Grid confidence: .25 rows of the usual width, .22 filled cells, .23 columns found of the usual width, .3 grid less its
    gaps; 0 under two rows or where a row has fewer than two cells.  Of equally usual widths the least counts."""
    widths = cells.groupBy(*TABLE, "row_index").agg(F.count("*").alias("w"))
    usual = widths.groupBy(*TABLE, "w").agg(F.count("*").alias("k")).groupBy(*TABLE).agg(
        F.max("k").alias("usual"), F.max_by("w", F.struct("k", -F.col("w"))).alias("expected"), F.min("w").alias("narrowest"), F.sum("k").alias("n_rows")
    )
    g = grid(cells).groupBy(*TABLE).agg(F.count("*").alias("n"), F.count_if("empty_cell").alias("empty"), F.countDistinct("column_index").alias("n_columns"))
    t = g.join(usual, TABLE)
    hole = F.col("empty") / F.col("n")
    score = 0.25 * F.col("usual") / F.col("n_rows") + 0.22 * (1 - hole) + 0.23 * F.least(F.lit(1.0), F.col("n_columns") / F.col("expected")) + 0.3 * (1 - F.least(F.lit(0.45), 0.8 * hole) - F.least(F.lit(0.3), 0.5 * hole))
    return t.select(*TABLE, F.col("n_rows"), F.col("n_columns"), F.when((F.col("n_rows") < 2) | (F.col("narrowest") < 2), 0.0).otherwise(clamp(score)).alias("confidence"))
