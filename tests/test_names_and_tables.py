from pyspark.sql import functions as F

from quire.operators import tables
from quire.operators.names import names
from quire.plans.extraction_queries import NON_NAMES


def test_names(spark):
    rows = [(0, "CONFIDENTIAL CLIENT FILE – JOHN SMITH – SSN 123-45-6789"), (1, "Client Name: John Smith"), (2, "EXECUTIVE SUMMARY"), (3, "UNITED STATES DISTRICT COURT"), (4, "it was signed by Mary O'Neil, Esq. in May"), (5, None)]
    df = spark.createDataFrame(rows, "line_no int, line string").withColumn("doc_id", F.lit(1).cast("long"))
    found = {}
    for r in names(df, NON_NAMES).collect():
        found.setdefault(r.line_no, []).append(r.text)
    assert "JOHN SMITH" in found[0] and any("John Smith" in t for t in found[1]) and any(t.startswith("Mary") for t in found[4])
    assert 2 not in found and 3 not in found and 5 not in found


def test_grid(spark):
    items = [(1, 1, t, x, y, len(t) * 5.0, 10.0) for t, x, y in [("Date", 0.0, 0.0), ("Amount", 200.0, 1.0), ("Jan", 0.0, 20.0), ("5", 16.0, 20.0), ("12.50", 205.0, 21.0), ("note", 0.0, 40.0)]]
    got = tables.reconstructed(spark.createDataFrame(items, "doc_id long, page_no int, str string, x double, y double, w double, h double")).orderBy("row_no").collect()
    assert [r.cells for r in got] == [["Date", "Amount"], ["Jan 5", "12.50"], ["note", ""]]
    heads = tables.header_columns(spark.createDataFrame(got), [["date"], ["amount", "total"], ["balance"]]).collect()
    assert [(r.doc_id, r.header_row, r["columns"]) for r in heads] == [(1, 0, [0, 1, None])]


def test_bank_rows(spark):
    rows = [(1, 0, ["Date", "Description", "Amount", "Balance"]), (1, 1, ["01/02/2024", "Payroll", "100.00", "100.00"]), (1, 2, ["", "of Acme", "", ""]), (1, 3, ["01/03/2024", "ATM", "40.00", "60.00"])]
    got = tables.bank_rows(spark.createDataFrame(rows, "doc_id long, row_no int, cells array<string>"), 2024).orderBy("entry").collect()
    assert [(r.date, r.description, r.signed, r.category) for r in got] == [("2024-01-02", "Payroll of Acme", 100.0, "payroll"), ("2024-01-03", "ATM", -40.0, "atm")]


def test_names_with_nulls(spark):
    rows = [(None, "Mr. John Smith and JOHN SMITH, name: MARY POE"), (None, "Mr. John Smith and JOHN SMITH, name: MARY POE"), (1, "Dr. ANN LEE")]
    found = names(spark.createDataFrame(rows, "doc_id long, line string"), NON_NAMES).collect()
    assert sorted((str(r.doc_id), r.start, r.text) for r in found) == [("1", 4, "ANN LEE")] + [("None", 4, "John Smith"), ("None", 4, "John Smith"), ("None", 19, "JOHN SMITH"), ("None", 19, "JOHN SMITH"), ("None", 37, "MARY POE"), ("None", 37, "MARY POE")]
    empty = spark.createDataFrame([], "doc_id long, line string")
    assert names(empty, NON_NAMES).count() == 0


def test_time_sheets(spark):
    rows = [(1, 0, ["Sheet"]), (1, 1, ["Date", "Atty", "Task", "Act", "Hrs", "Rate", "Value", "Notes"]), (1, 2, ["01/02/2024", "AB ", "l 110", "a101", "1.5", "$200", "300.00", "wrote"]), (1, 3, ["", "", "", "", "", "", "300", "total"]), (2, 0, ["02/03/2024", "read", "50"])]
    got = [tuple(r) for r in tables.time_sheet_rows(spark.createDataFrame(rows, "doc_id long, row_no int, cells array<string>"), 2024).orderBy("doc_id").collect()]
    assert got == [(1, 2, "2024-01-02", "AB", "L110", "A101", 1.5, 200.0, 300.0, "wrote"), (2, 0, "2024-02-03", "", "", "", None, None, 50.0, "read")]
    text = "Head\r\nLINE_ITEM_TOTAL|line_item_date| INVOICE_NUMBER \r\n100.50|2024-01-05|77\r\n1|none|78\r\n|2024-01-06|"
    block = tables.pipe_rows(spark.createDataFrame([(1, text), (2, "a|b"), (3, None)], "doc_id long, text string"), 2024).collect()
    assert [(r.line_no, r.invoice, r.date, r.amount, r.hours) for r in block] == [(1, "77", "2024-01-05", 100.5, None), (3, "", "2024-01-06", None, None)]
    codes = spark.createDataFrame([(1, c) for c in ("L110", "X", "Y", "Z")] + [(2, c) for c in ("L110", "L120", "X", "Y")] + [(3, "X")], "doc_id long, task_code string")
    assert [tuple(r) for r in tables.time_sheet_warnings(codes, ["L110", "L120"]).collect()] == [(1, 1, 4)]
    items = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "doc_id long, amount double")
    heads = spark.createDataFrame([(1, 5.01), (2, 1.5), (3, 2.0), (4, None)], "doc_id long, subtotal double")
    assert sorted((r.doc_id, r.warning) for r in tables.invoice_warnings(items, heads).collect()) == [(2, "items 1.00, subtotal 1.50"), (3, "items 0.00, subtotal 2.00"), (3, "no items"), (4, "no items")]
    fields = tables.field_map(spark.createDataFrame([("Cust Key",), ("x",)], "field string"), spark.createDataFrame([("custkey",), ("CUST_KEY",), ("y",)], "header string"))
    assert sorted(map(tuple, fields.collect()), key=str) == [("Cust Key", "CUST_KEY"), ("x", None)]


def test_masks(spark):
    from quire.functions.values import masked

    rows = [("ssn", "123-45-6789"), ("phone", "5551234567"), ("creditCard", "4111 1111 1111 1111"), ("email", "bob@x.org"), ("email", "b@x.org"), ("iban", "DE89370400440532013000"), ("date", "01/02/2024"), ("iban", "DE8")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, t string").select(masked(F.col("c"), F.col("t"))).collect()]
    assert got == ["123-45-6789", "••••••4567", "•••• •••• •••• 1111", "b••@x.org", "b@x.org", "DE89••••••••••••••3000", "01/02/2024", "DE8DE8"]


def test_names_in_long_lines(spark):
    """Signs far along a line, and beyond long blanks, count as they do in a short one."""
    line = "x " * 400 + "Signed by Ann Lee Park and Tom Ray Hill, Jr. and by" + " " * 700 + "Sue Kay Moon and Max Low Field" + " " * 700 + ", Esq. but Una May Reed" + " y" * 400
    found = names(spark.createDataFrame([(1, line)], "doc_id long, line string"), NON_NAMES).collect()
    assert all(line[r.start : r.start + r.length] == r.text for r in found)
    assert {"Tom Ray Hill", "Sue Kay Moon", "Max Low Field"} <= {r.text for r in found} and "Una May Reed" not in {r.text for r in found}
