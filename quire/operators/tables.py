"""Tables in positioned text, and bank, invoice and time-sheet rows out of them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.values import CATEGORIES, amount, bound, chosen, iso_date


def grid_rows(items: pd.DataFrame) -> list[list[str]]:
    """Rows of cells: items near the head of a row belong to it, a wide gap opens a cell, cells go to the nearest column."""
    if items.empty:
        return []
    height, width = items["h"].mean(), (items["w"] / items["str"].str.len().clip(lower=1)).mean()
    rows: list[list[tuple]] = []
    for item in items.sort_values(["y", "x"]).itertuples(index=False):
        if rows and abs(item.y - rows[-1][0].y) <= 0.6 * height:
            rows[-1].append(item)
        else:
            rows.append([item])
    cells: list[list[tuple[float, str]]] = []
    for row in rows:
        made: list[list] = []
        for item in sorted(row, key=lambda r: r.x):
            if made and item.x - made[-1][2] <= 2.2 * width:
                made[-1][1] += " " + item.str
                made[-1][2] = item.x + item.w
            else:
                made.append([item.x, item.str, item.x + item.w])
        cells.append([(x, text.strip()) for x, text, _ in made])
    anchors: list[float] = []
    for x in sorted(x for row in cells for x, _ in row):
        if not anchors or x - anchors[-1] > 4 * width:
            anchors.append(x)
    out = []
    for row in cells:
        line = [""] * len(anchors)
        for x, text in row:
            k = min(range(len(anchors)), key=lambda i: (abs(anchors[i] - x), i))
            line[k] = f"{line[k]} {text}".strip()
        out.append(line)
    return out


def reconstructed(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, cells) from items (doc_id, page_no, str, x, y, w, h); a group is one page."""

    def page(held: pd.DataFrame) -> pd.DataFrame:
        rows = grid_rows(held)
        return pd.DataFrame({"doc_id": held["doc_id"].iloc[0], "page_no": held["page_no"].iloc[0], "row_no": range(len(rows)), "cells": rows})

    return items.groupBy("doc_id", "page_no").applyInPandas(page, "doc_id long, page_no int, row_no int, cells array<string>")


def header_columns(rows: DataFrame, groups: list[list[str]], within: int = 30) -> DataFrame:
    """(doc_id, header_row, columns): the first of a document's first rows whose cells hold words of at least half of the groups.

    columns: for each group the place of the first cell that holds one of its words, from 0; null: none does.
    """
    low = F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))))
    holds = lambda c, group: reduce(lambda a, b: a | b, [c.contains(word) for word in group])
    place = lambda low, group: F.nullif(F.array_position(F.transform(low, lambda c: holds(c, group)), True), F.lit(0)) - 1
    columns = bound(low, lambda low: F.array(*[place(low, group).cast("int") for group in groups]))
    # a look at the row as one text first (its signs between cells are in no word), for few rows are headers
    met = bound(F.lower(F.concat_ws("\0", "cells")), lambda row: reduce(lambda a, b: a + b, [holds(row, group).cast("int") for group in groups]))
    enough = rows.where((F.col("row_no") < within) & F.col("cells").isNotNull() & (met >= (len(groups) + 1) // 2)).withColumn("columns", columns)
    return enough.groupBy("doc_id").agg(F.min("row_no").alias("header_row"), F.min_by("columns", "row_no").alias("columns"))


def invoice_rows(rows: DataFrame, groups: list[list[str]], european: bool = False) -> DataFrame:
    """(doc_id, entry, description, qty, unit_price, amount, tax): line items below the header, with a description and an amount.

    Without a header the first cell describes and the widest row's last one is the amount.
    """
    heads = header_columns(rows, groups)
    widest = rows.groupBy("doc_id").agg(F.max(F.size("cells")).alias("_wide"))
    known = rows.join(widest, "doc_id").join(heads, "doc_id", "left").where(F.col("header_row").isNull() | (F.col("row_no") > F.col("header_row")))
    at = lambda i, other=None: F.coalesce(F.get("columns", F.lit(i)), F.lit(None).cast("int") if other is None else other)
    cell = lambda place: F.when(place.isNotNull(), F.get("cells", place))
    money = lambda place: amount(cell(place), european)
    read = known.select("doc_id", "row_no", F.trim(cell(at(0, F.lit(0)))).alias("description"), money(at(1)).alias("qty"), money(at(2)).alias("unit_price"), money(at(3, F.col("_wide") - 1)).alias("amount"), money(at(4)).alias("tax"))
    items = read.where((F.col("description") != "") & F.col("amount").isNotNull())
    return items.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no"))).drop("row_no")


def header_fields(text: Column, fields: dict[str, str]) -> dict[str, Column]:
    """The first match of each field's pattern, trimmed; null if there is none."""
    return {name: F.nullif(F.trim(F.regexp_extract(text, P.java(p), 1)), F.lit("")) for name, p in fields.items()}


def document_type(text: Column) -> Column:
    """``ledes``, ``bank_statement``, ``invoice`` or ``generic``, and how sure that is: high, medium or low."""
    holds = lambda group: reduce(lambda a, b: a & b, [text.rlike(P.java(p)) for p in group]).cast("int")
    bank, timed, invoice = (reduce(lambda a, b: a + b, map(holds, P.TYPE_SIGNS[kind])) for kind in ("bank", "ledes", "invoice"))
    ledes = timed - F.when(bank == 0, 0.0).otherwise(0.5)
    sure = lambda kind, score, high: F.when(score >= high, f"{kind} high").otherwise(f"{kind} medium")
    return chosen(
        [
            (text.rlike(P.LEDES_BLOCK), F.lit("ledes high")),
            ((ledes >= 3) & (ledes > invoice), sure("ledes", ledes, 4)),
            ((bank >= 2) & (bank >= invoice), sure("bank_statement", bank, 3)),
            (invoice >= 2, sure("invoice", invoice, 3)),
            (bank >= 1, F.lit("bank_statement low")), (invoice >= 1, F.lit("invoice low")), (ledes >= 1, F.lit("ledes low")),
        ],
        "generic low",
    )


def signed_by_balance(rows: DataFrame, keys: list[str], order: str, tolerance: float = 0.02) -> DataFrame:
    """``rows`` (amount, balance) with signed: the sign of the balance's change where that has the amount's size."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    change = F.col("balance") - F.last("balance", ignorenulls=True).over(w)
    fits = F.abs(F.abs(change) - F.abs(F.col("amount"))) <= tolerance
    return rows.withColumn("signed", F.when(fits, F.signum(change) * F.abs("amount")).otherwise(F.col("amount")))


def category(description: Column) -> Column:
    low = F.lower(description)
    return chosen([(low.rlike(p), c) for p, c in CATEGORIES], "")


def bank_rows(rows: DataFrame, ref_year: int, european: bool = False) -> DataFrame:
    """Typed transactions from rows (doc_id, row_no, cells: date, description, amount, balance); lines without a date go on with the one before."""
    cell = lambda i: F.get("cells", i)
    read = rows.select("doc_id", "row_no", iso_date(cell(0), european, ref_year).alias("date"), cell(1).alias("part"), amount(cell(2), european).alias("amount"), amount(cell(3), european).alias("balance"))
    own = Window.partitionBy("doc_id").orderBy("row_no")
    numbered = read.withColumn("entry", F.count("date").over(own)).where("entry > 0")
    parts = F.array_sort(F.collect_list(F.struct("row_no", "part")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(c)
    entries = numbered.groupBy("doc_id", "entry").agg(F.min("date").alias("date"), F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("description"), first("amount"), first("balance"))
    return signed_by_balance(entries, ["doc_id"], "entry").withColumn("category", category(F.col("description")))


# Words by which a time sheet's columns are known, in this order.
TIME_GROUPS = [["date"], ["timekeeper", "atty", "attorney", "initials"], ["task"], ["activity", "act"], ["hours", "hrs"], ["rate"], ["amount", "value"], ["description", "narrative", "notes"]]
TIME_COLUMNS = ["date", "timekeeper_id", "task_code", "activity_code", "hours", "rate", "amount", "narrative"]
# The same columns in a pipe-separated block.
PIPE_NAMES = ["LINE_ITEM_DATE", "TIMEKEEPER_ID", "LINE_ITEM_TASK_CODE", "LINE_ITEM_ACTIVITY_CODE", "LINE_ITEM_NUMBER_OF_UNITS", "LINE_ITEM_UNIT_COST", "LINE_ITEM_TOTAL", "LINE_ITEM_DESCRIPTION"]


def _time_entries(rows: DataFrame, kept: list[Column | str], cells: list[Column], ref_year: int, european: bool) -> DataFrame:
    """kept, and the typed columns of time sheets' lines that have a date; cells are columns of their own first, for they are read often."""
    named = [f"_cell{i}" for i in range(len(cells))]
    held = rows.select(*kept, *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, named, strict=True)])
    dates = F.array_compact(F.array(iso_date(F.col(named[0]), european, ref_year)))  # a date is worked out once, and the rest only where there is one
    dated = held.select(*[c for c in held.columns if c != named[0]], F.explode(dates).alias(TIME_COLUMNS[0]))
    return dated.select(*[c for c in held.columns if c not in named], TIME_COLUMNS[0], *_time_entry([F.col(n) for n in named[1:]], european))


def _time_entry(cells: list[Column], european: bool) -> list[Column]:
    """Typed columns of a time sheet's line, but for its date."""
    keeper, task, activity, hours, rate, total, said = cells
    codes = F.upper(F.regexp_replace(task, r"\s+", "")), F.upper(F.trim(activity))
    typed = [F.trim(keeper), *codes, amount(hours, european), amount(rate, european), amount(total, european), F.trim(said)]
    return [c.alias(name) for c, name in zip(typed, TIME_COLUMNS[1:], strict=True)]


def time_sheet_rows(rows: DataFrame, ref_year: int, european: bool = False) -> DataFrame:
    """(doc_id, row_no, date, timekeeper_id, task_code, activity_code, hours, rate, amount, narrative): dated lines below the header.

    Without a header the first cell is the date, the last of the widest row the amount, the one before it the narrative.
    """
    heads = header_columns(rows, TIME_GROUPS)
    widest = rows.groupBy("doc_id").agg(F.max(F.size("cells")).alias("_wide"))
    known = rows.join(widest, "doc_id").join(heads, "doc_id", "left").where(F.col("header_row").isNull() | (F.col("row_no") > F.col("header_row")))
    other = {0: F.lit(0), 6: F.greatest(F.lit(0), F.col("_wide") - 1), 7: F.greatest(F.lit(0), F.col("_wide") - 2)}
    place = lambda i: F.coalesce(F.get("columns", F.lit(i)), other.get(i, F.lit(None).cast("int")))
    cells = [F.when(place(i).isNotNull(), F.get("cells", place(i))) for i in range(len(TIME_GROUPS))]
    return _time_entries(known, ["doc_id", "row_no"], cells, ref_year, european)


def pipe_rows(texts: DataFrame, ref_year: int, european: bool = False) -> DataFrame:
    """The same columns, line_no and invoice from texts (doc_id, text) with pipe-separated lines, by the names in the first of these."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda line: line.contains("|"))
    cut = lambda line: F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
    read = texts.select("doc_id", F.transform(lines, cut).alias("_rows")).where(F.size("_rows") >= 2)
    names = F.transform(F.get("_rows", F.lit(0)), lambda c: F.upper(c))
    held = read.select("doc_id", names.alias("_names"), F.posexplode(F.slice("_rows", F.lit(2), F.size("_rows"))).alias("_n", "_cells"))
    cell = lambda name: F.when(F.array_position("_names", F.lit(name)) > 0, F.get("_cells", F.array_position("_names", F.lit(name)).cast("int") - 1))
    return _time_entries(held, ["doc_id", (F.col("_n") + 1).alias("line_no"), cell("INVOICE_NUMBER").alias("invoice")], [cell(n) for n in PIPE_NAMES], ref_year, european)


def time_sheet_warnings(entries: DataFrame, codes: list[str], checks: int = 3, share: float = 0.3) -> DataFrame:
    """(doc_id, known, checked): documents with more than ``checks`` task codes of which less than ``share`` are known."""
    counts = entries.where(F.col("task_code") != "").groupBy("doc_id").agg(F.count_if(F.col("task_code").isin(codes)).alias("known"), F.count("*").alias("checked"))
    return counts.where((F.col("checked") > checks) & (F.col("known") / F.col("checked") < share))


def invoice_warnings(items: DataFrame, heads: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(doc_id, warning) from items (doc_id, amount) and heads (doc_id, subtotal): sums that differ, and documents without items."""
    sums = items.groupBy("doc_id").agg(F.sum("amount").alias("_sum"), F.count("*").alias("_n"))
    both = heads.select("doc_id", "subtotal").join(sums, "doc_id", "left").withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    shown = lambda c: F.format_string("%.2f", c)
    differs = F.when(F.abs(F.col("_sum") - F.col("subtotal")) > tolerance, F.concat(F.lit("items "), shown(F.col("_sum")), F.lit(", subtotal "), shown(F.col("subtotal"))))
    empty = F.when(F.col("_n").isNull(), "no items")
    return both.select("doc_id", F.explode(F.array_compact(F.array(differs, empty))).alias("warning"))


def invoice_head(text: Column, european: bool, ref_year: int) -> dict[str, Column]:
    """An invoice's head as typed columns; any date stands in for a missing invoice date."""
    found = header_fields(text, P.INVOICE_FIELDS)
    dated = F.coalesce(found["invoice_date"], F.nullif(F.trim(F.regexp_extract(text, P.java(P.ANY_DATE), 1)), F.lit("")))
    money = {k: amount(found[k], european) for k in ("subtotal", "tax", "total")}
    return found | money | {"invoice_date": iso_date(dated, european, ref_year), "due_date": iso_date(found["due_date"], european, ref_year)}


def field_map(fields: DataFrame, headers: DataFrame) -> DataFrame:
    """(field, header): fields with the header that has the same letters and digits, the first by name of several; null if none has."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    held = headers.groupBy(bare("header").alias("_key")).agg(F.min("header").alias("header"))
    return fields.select("field", bare("field").alias("_key")).join(held, "_key", "left").select("field", "header")
