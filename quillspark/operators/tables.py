"""Tables of documents: chunks that never cut a row, continuation over pages, cells from the places of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fields as f

#: Rows and characters of a chunk.
ROWS, CHARS = 50, 8000


def chunked(rows: DataFrame, table: str, order: str, text: str, most_rows: int = ROWS, most_chars: int = CHARS, header: bool = True) -> DataFrame:
    """table, chunk_no, first_row, n_rows, body: the rows of each table in chunks of at most `most_rows` rows and `most_chars` characters (a longer row stands alone), the first row repeated on top of the later ones.

    Chunks are found by one fold over a table's row lengths; a table is bounded by its document.
    """
    arrays = rows.groupBy(table).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))), lambda r: r["x"]).alias("r"))
    head = F.when(F.lit(header) & (F.size("r") > 1), F.element_at("r", 1))
    body = F.when(head.isNotNull(), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(1)))).otherwise(F.col("r"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most_rows) | (s["chars"] + F.length(x) + 1 > most_chars))
        no = s["no"] + F.when(full | (s["no"] == 0), 1).otherwise(0)
        return F.struct(F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, F.length(x)).otherwise(s["chars"] + F.length(x) + 1).alias("chars"), no.alias("no"), F.concat(s["of"], F.array(no)).alias("of"))

    placed = arrays.select(table, head.alias("head"), body.alias("body")).withColumn("of", F.aggregate("body", start, step, lambda s: s["of"]))
    each = placed.select(table, "head", F.posexplode(F.arrays_zip("body", "of")).alias("i", "z")).groupBy(table, F.col("z.of").alias("chunk_no")).agg(F.min("i").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("i", "z.body"))).alias("rows"))
    return each.select(table, "chunk_no", (F.col("first_row") + 1).alias("first_row"), "n_rows", F.concat_ws("\n", "head", F.array_join(F.transform("rows", lambda r: r["body"]), "\n")).alias("body"))


def markdown(rows: Column) -> Column:
    """A table (array of rows, each an array of cells) as Markdown; its first row is the header."""
    cell = lambda c: F.replace(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), r"([|])", r"\\$1"), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    lines = F.transform(rows, line)
    return F.concat_ws("\n", F.element_at(lines, 1), rule, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))), "\n"))


def has_header(rows: Column) -> Column:
    """Does the first row name the columns: hardly a number in it, while the others have some?"""
    numbers = lambda r: F.size(F.filter(r, f.numeric_cell))
    first, rest = F.element_at(rows, 1), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(1)))
    return (F.size(rows) > 1) & (numbers(first) * 2 < F.size(first)) & (F.exists(rest, lambda r: numbers(r) > 0))


def merged_over_pages(tables: DataFrame, doc: str = "doc", page: str = "page", rows: str = "rows") -> DataFrame:
    """doc, first_page, last_page, rows: a table at the top of a page continues one at the bottom of the page before if it has as many columns; a repeated header goes.

    tables: doc, page, at_top, at_bottom, rows. Continued tables are islands of consecutive pages.
    """
    w = Window.partitionBy(doc).orderBy(page, F.desc("at_top"))
    width = F.size(F.element_at(rows, 1))
    t0 = tables.withColumn("_w", width)
    goes = F.col("at_top") & F.lag("at_bottom").over(w) & (F.lag(page).over(w) == F.col(page) - 1) & (F.lag("_w").over(w) == F.col("_w"))
    t1 = t0.withColumn("_new", F.when(F.coalesce(goes, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w)).withColumn("_head", F.first(F.element_at(rows, 1)).over(Window.partitionBy(doc, "_g").orderBy(page)))
    kept = F.when((F.col("_new") == 0) & F.element_at(rows, 1).eqNullSafe(F.col("_head")), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(F.col(rows))
    g = t1.withColumn("_kept", kept).groupBy(doc, "_g").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_kept").alias("r")))), lambda x: x["r"])).alias("rows"))
    return g.drop("_g")


def visual_rows(words: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """words with `row`: words of a page in one line if their heights overlap by `share` of the lower one. words: page columns, x0, x1, y0, y1, text.

    A word opens a row if it overlaps the one before it (from top to bottom) by less.
    """
    w = Window.partitionBy(*page).orderBy("y0", "x0")
    over = F.least("y1", F.lag("y1").over(w)) - F.greatest("y0", F.lag("y0").over(w))
    low = F.least(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(w))
    opens = F.when(F.lag("y1").over(w).isNotNull() & (over >= share * low), 0).otherwise(1)
    return words.withColumn("_o", opens).withColumn("row", F.sum("_o").over(w)).drop("_o")


def cells(rows: DataFrame, page: list[str], gap: float = 8.0) -> DataFrame:
    """page, row, cell_no, x0, x1, text: words of a row joined while the blank between them is at most `gap` wide."""
    w = Window.partitionBy(*page, "row").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cell = rows.withColumn("_n", F.when(F.coalesce(F.col("x0") - before <= gap, F.lit(False)), 0).otherwise(1)).withColumn("cell_no", F.sum("_n").over(w))
    return cell.groupBy(*page, "row", "cell_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"))


def columns(found: DataFrame, page: list[str], share: float = 0.5, least: int = 2) -> DataFrame:
    """page, column, x0, x1: bands of the page that cells of many rows cover, from left to right: runs of whole points covered in a share of the rows with several cells."""
    many = found.join(found.groupBy(*page, "row").agg(F.count(F.lit(1)).alias("_c")).where(f"_c >= {least}"), [*page, "row"])
    total = many.groupBy(*page).agg(F.count_distinct("row").alias("_r"))
    points = many.select(*page, "row", F.explode(F.sequence(F.floor("x0").cast("int"), F.greatest(F.ceil("x1").cast("int") - 1, F.floor("x0").cast("int")))).alias("x")).distinct().groupBy(*page, "x").agg(F.count(F.lit(1)).alias("n"))
    covered = points.join(total, page).where(F.col("n") >= share * F.col("_r"))
    w = Window.partitionBy(*page).orderBy("x")
    runs = covered.withColumn("_s", F.col("x") - F.row_number().over(w)).groupBy(*page, "_s").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return runs.withColumn("column", F.row_number().over(Window.partitionBy(*page).orderBy("x0"))).drop("_s")


def grid(found: DataFrame, bands: DataFrame, page: list[str]) -> DataFrame:
    """page, row, column, text: every cell in the column it overlaps most, the left one among equals; cells beside all columns are left out."""
    b = bands.select(*page, "column", F.col("x0").alias("_l"), F.col("x1").alias("_r"))
    over = F.least("x1", "_r") - F.greatest("x0", "_l")
    best = found.join(b, page).where((F.col("x0") < F.col("_r")) & (F.col("_l") < F.col("x1"))).groupBy(*page, "row", "cell_no", "text").agg(F.max_by("column", F.struct(over, -F.col("column"))).alias("column"))
    return best.groupBy(*page, "row", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]), " ").alias("text"))
