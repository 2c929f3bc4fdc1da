"""Table regions of a page: rows and columns by running means, the filled grid, and how sure it is.

The clusters follow the order of the cells and the means of the cells taken so far, which column expressions cannot
say; so a page's candidates, a bounded group, meet in one call of ``applyInPandas``.  Everything else (which blocks are
candidates, scores, totals, blocks left near a table) are column expressions over its rows.

Edge cases: null texts are no cells; pages without candidates give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.scores import clamp
from quire.functions.text import among

#: Distances in points and shares (fixed values).
ROW_START, ROW_MEAN, GAP_LEAST, GAP_MOST, LEFT_ALIGNED, CENTER_ALIGNED = 5, 7, 4, 32, 18, 24
COLUMN_NEAR, COLUMN_END, COLUMN_FAR, WIDTH_LEAST, WIDTH_SHARE = 10, 12, 34, 14, 0.45
WEAK, CELL_MOST, SURE = 18, 52, 0.6
TABLE = ["doc_id", "page_number", "table_no"]


def is_candidate(t: str, kind: str) -> Column:
    """Whether a block can be a cell: one to six words in a small box, no page edge, picture or noise."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    words = F.size(X.words_split(t))
    usual = ~F.coalesce(among(F.col(kind), ["header", "footer", "image", "noise"]), F.lit(False))
    return F.coalesce(usual & (X.normalize(t) != "") & words.between(1, 6) & w.between(8, 180) & h.between(5, 28), F.lit(False))


@dataclass(slots=True)
class Cell:
    pos: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    cx: float = field(init=False)
    cy: float = field(init=False)

    def __post_init__(self):
        self.cx, self.cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


class Cluster:
    """Cells with the running means of some of their measures."""

    def __init__(self, measures: tuple[float, ...]):
        self.cells, self.sums = [], [0.0] * len(measures)

    def take(self, cell: Cell, measures: tuple[float, ...]) -> None:
        self.cells.append(cell)
        self.sums = [a + b for a, b in zip(self.sums, measures)]

    def mean(self, k: int) -> float:
        return self.sums[k] / len(self.cells)


def clusters(cells: list[Cell], measure: Callable[[Cell], tuple[float, ...]], joins: Callable[[Cluster, tuple[float, ...]], bool]) -> list[Cluster]:
    """Each cell joins the first cluster that takes it, else opens one."""
    found: list[Cluster] = []
    for cell in cells:
        own = measure(cell)
        home = next((c for c in found if joins(c, own)), None)
        if home is None:
            found.append(home := Cluster(own))
        home.take(cell, own)
    return found


def candidate_rows(cells: list[Cell]) -> list[list[Cell]]:
    """Rows of two or more cells whose centres are near that of the row's first cell, left to right."""
    order = sorted(cells, key=lambda c: (c.y0, c.x0))
    rows = clusters(order, lambda c: (c.cy,), lambda row, own: abs(own[0] - row.cells[0].cy) <= ROW_START)
    return [sorted(r.cells, key=lambda c: c.x0) for r in rows if len(r.cells) >= 2]


def follows(above: list[Cell], below: list[Cell]) -> bool:
    """Whether two rows belong to one table: as many cells, a usual gap, and all but one of them below each other."""
    if len(above) != len(below) or not GAP_LEAST <= min(c.y0 for c in below) - max(c.y1 for c in above) <= GAP_MOST:
        return False
    pairs = list(zip(above, below))
    left, middle = sum(abs(a.x0 - b.x0) <= LEFT_ALIGNED for a, b in pairs), sum(abs(a.cx - b.cx) <= CENTER_ALIGNED for a, b in pairs)
    return max(left, middle) >= max(2, len(above) - 1)


def row_groups(rows: list[list[Cell]]) -> list[list[list[Cell]]]:
    """Runs of two or more rows that follow each other."""
    runs: list[list[list[Cell]]] = []
    for row in rows:
        if runs and follows(runs[-1][-1], row):
            runs[-1].append(row)
        else:
            runs.append([row])
    return [r for r in runs if len(r) >= 2]


def _same_column(column: Cluster, own: tuple[float, ...]) -> bool:
    x0, x1, center, width = own
    off = abs(x0 - column.mean(0))
    if off <= COLUMN_NEAR:
        return True
    same_end = abs(x1 - column.mean(1)) <= COLUMN_END and abs(width - column.mean(3)) <= max(WIDTH_LEAST, column.mean(3) * WIDTH_SHARE)
    return off <= COLUMN_FAR and (abs(center - column.mean(2)) <= COLUMN_NEAR or same_end)


@dataclass(slots=True)
class Band:
    """A column: extent, mean centre, logical edges."""

    x0: float
    x1: float
    center: float
    left: float = 0.0
    right: float = 0.0

    def holds(self, c: Cell) -> bool:
        inside = self.left - 3 <= c.cx <= self.right + 3 or abs(c.x0 - self.x0) <= 16
        return inside or abs(c.cx - self.center) <= 18 and self.left - 18 <= c.x0 <= self.right + 18

    def off(self, c: Cell) -> float:
        return min(abs(c.cx - self.center), abs(c.x0 - self.x0))


def bands(cells: list[Cell]) -> list[Band]:
    found = clusters(sorted(cells, key=lambda c: c.x0), lambda c: (c.x0, c.x1, c.cx, max(0.0, c.x1 - c.x0)), _same_column)
    out = [Band(round(min(c.x0 for c in k.cells), 2), round(max(c.x1 for c in k.cells), 2), round(k.mean(2), 2)) for k in sorted(found, key=lambda k: k.mean(0))]
    out.sort(key=lambda b: b.x0)
    for b, before, after in zip(out, [None, *out], [*out[1:], None]):
        b.left = b.x0 - 4 if before is None else max(before.x1 + 2, min(b.x0 - 3, (before.center + b.center) / 2))
        b.right = b.x1 + 10 if after is None else min(after.x0 - 3, max(b.x1 + 3, (b.center + after.center) / 2))
        if b.right <= b.left:
            b.left, b.right = b.x0 - 3, b.x1 + 6
        b.left, b.right = round(b.left, 2), round(b.right, 2)
    return out


def row_clusters(cells: list[Cell]) -> list[tuple[float, float, list[Cell]]]:
    """(top, bottom, cells) of the rows by the running mean of their centres, from above."""
    found = clusters(sorted(cells, key=lambda c: (c.cy, c.x0)), lambda c: (c.cy,), lambda row, own: abs(own[0] - row.mean(0)) <= ROW_MEAN)
    found.sort(key=lambda r: r.mean(0))
    return [(round(min(c.y0 for c in r.cells), 2), round(max(c.y1 for c in r.cells), 2), sorted(r.cells, key=lambda c: c.x0)) for r in found]


def edges(rows: list[tuple[float, float, list[Cell]]], k: int) -> tuple[float, float]:
    """Top and bottom of a row's logical cells."""
    y0, y1, _ = rows[k]
    if k + 1 < len(rows):
        bottom = max(y1 + 2, rows[k + 1][0] - 3)
    else:
        gap = max(0.0, y0 - rows[k - 1][0]) if k else 0.0
        bottom = y1 + max(8.0, min(gap - 3, 20.0) if gap else 10.0)
    return round(y0 - 2, 2), round(bottom if bottom > y0 - 2 else y1 + 8, 2)


def matrix(cells: list[Cell]) -> list[list[tuple]]:
    """The grid: for each row and column (cell or None, box, weak)."""
    rows, columns, out = row_clusters(cells), bands(cells), []
    for k, (_, _, own) in enumerate(rows):
        top, bottom = edges(rows, k)
        line, free = [], list(own)
        for b in columns:
            box = (b.left, top, round(max(b.right, b.left + 8), 2), round(max(bottom, top + 8), 2))
            near = min((c for c in free if b.holds(c)), key=b.off, default=None)
            if near is None or b.off(near) > CELL_MOST:
                line.append((None, box, True))
            else:
                free = [c for c in free if c is not near]
                line.append((near, box, b.off(near) > WEAK))
        out.append(line)
    return out


def sureness(grid: list[list[tuple]]) -> float:
    """Confidence in a grid of equal rows: .25 and .23 for rows and columns that agree, .22 filled cells, .3 less gaps and weak cells."""
    if len(grid) < 2 or len(grid[0]) < 2:
        return 0.0
    n = len(grid) * len(grid[0])
    empty, weak = sum(c is None for row in grid for c, _, _ in row) / n, sum(w for row in grid for _, _, w in row) / n
    return round(min(1.0, 0.25 + 0.22 * (1 - empty) + 0.23 + 0.3 * (1 - min(0.45, empty * 0.8) - min(0.3, weak * 0.5))), 3)


SCHEMA = (
    "doc_id long, page_number int, table_no int, row_index int, column_index int, pos int, source_text string, x0 double, y0 double, x1 double, y1 double, "
    "empty_cell boolean, weak_alignment boolean, confidence double"
)


def table_cells(blocks: DataFrame) -> DataFrame:
    """The cells of the tables of each page, empty ones too (``pos`` is null), with the table's confidence.

    ``blocks``: doc_id, page_number, pos, type, source_text, x0, y0, x1, y1.
    """

    def page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells, out, number = [Cell(*r) for r in rows[["pos", "source_text", "x0", "y0", "x1", "y1"]].itertuples(index=False)], [], 0
        cells.sort(key=lambda c: c.pos)
        for group in row_groups(candidate_rows(cells)):
            grid = matrix([c for row in group for c in row])
            sure = sureness(grid)
            if sure < SURE:
                continue
            number += 1
            for i, row in enumerate(grid):
                for j, (c, box, weak) in enumerate(row):
                    out.append((*key, number, i, j, c and c.pos, c.text if c else "", *box, c is None, weak, sure))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"pos": "Int32"})

    kept = blocks.where(is_candidate("source_text", "type")).select(
        F.col("doc_id").cast("long"), F.col("page_number").cast("int"), F.col("pos").cast("int"), "source_text", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    )
    return kept.groupBy("doc_id", "page_number").applyInPandas(page, SCHEMA)


def table_blocks(cells: DataFrame) -> DataFrame:
    """One row for each table: its size, box and confidence at detection."""
    return cells.groupBy(*TABLE).agg(
        F.countDistinct("row_index").alias("n_rows"), F.countDistinct("column_index").alias("n_columns"), F.count_if(~F.col("empty_cell")).alias("n_cells"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("confidence").alias("confidence"),
    )


def without_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The page's blocks that no table took: its prose."""
    taken = cells.where("pos IS NOT NULL").select("doc_id", "page_number", "pos")
    return blocks.join(taken, ["doc_id", "page_number", "pos"], "left_anti")


def near_tables(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidates that no table took, whose top is within 42 points of a table's bottom and that lie over its width
    (20 points wider): with the first such table of the page."""
    t = table_blocks(cells).select(*TABLE, F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("y1").alias("__y1"))
    rest = without_cells(blocks, cells).where(is_candidate("source_text", "type"))
    near = (F.abs(F.col("y0") - F.col("__y1")) <= 42) & (F.col("x1") >= F.col("__x0") - 20) & (F.col("x0") <= F.col("__x1") + 20)
    return rest.join(t, ["doc_id", "page_number"]).where(near).groupBy("doc_id", "page_number", "pos").agg(F.first("source_text").alias("source_text"), F.min("table_no").alias("table_no"))


def table_quality(cells: DataFrame) -> DataFrame:
    """The score of a table when quality is judged, over its cells (``source_text``, ``empty_cell``, ``weak_alignment`` and, where
    there is one, ``translated_text``), with the warnings a low score brings and the counts of cells to translate and still open."""
    text = F.trim(F.coalesce("source_text", F.lit(""))) != ""
    open_ = text & (F.trim(F.coalesce("translated_text", F.lit(""))) == "") if "translated_text" in cells.columns else text
    t = cells.groupBy(*TABLE).agg(
        F.count("*").alias("n"), F.count_if(text).alias("cells"), F.count_if(open_).alias("open_cells"), F.count_if("empty_cell").alias("e"), F.count_if("weak_alignment").alias("w"),
        F.count_if(F.col("empty_cell") & F.col("weak_alignment")).alias("b"), F.countDistinct("row_index").alias("r"), F.countDistinct("column_index").alias("c"),
    )
    share = lambda c, k, most: F.least(F.lit(most), F.col(c) / F.col("n") * k)
    grid = F.greatest(F.lit(0.0), 1 - share("e", 0.55, 0.3) - share("w", 0.45, 0.25))
    score = 0.25 + 0.2 * F.col("cells") / F.col("n") + 0.2 + 0.2 + 0.15 * grid - share("b", 0.35, 0.2)
    score = F.when((F.col("r") < 2) | (F.col("c") < 2), 0.0).otherwise(clamp(score))
    warnings = F.array_compact(F.array(F.when(F.col("score") < 0.65, "table_detection_uncertain"), F.when(F.col("score") < 0.6, "weak_table_grid")))
    return t.withColumn("score", score).select(*TABLE, "score", "cells", "open_cells", warnings.alias("warnings"), (F.col("score") < 0.6).alias("is_weak"))


def table_totals(cells: DataFrame) -> DataFrame:
    """The sums of a document's tables that its report takes."""
    return table_quality(cells).groupBy("doc_id").agg(
        F.count("*").alias("tables"), F.sum("cells").alias("cells"), F.sum("open_cells").alias("open_cells"), F.round(F.avg("score"), 3).alias("table_score")
    )
