import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators import layout as L

SCHEMA = "doc_id string, page int, line_no int, text string, size double, x0 double, y0 double, x1 double, y1 double"


def line(page, no, text, size, y, height=10.0, doc="d"):
    return (doc, page, no, text, size, 0.0, float(y), 100.0, y + height)


@pytest.fixture()
def lines(spark):
    body = [line(1, k, f"body text number {k}.", 10.0, 100 + 20 * k) for k in range(5, 12)]
    return spark.createDataFrame([line(1, 1, "before", 10.0, 10), line(1, 2, "Heat", 16.0, 98), line(1, 3, "and Work", 16.5, 112), line(1, 4, "twelve", 15.9, 300), *body, line(2, 1, "on page two", 10.0, 10), line(2, 2, "more", 10.0, 30), line(2, 3, "near the title", 10.0, 98.0), line(2, 4, "Light", 20.0, 100.0), line(2, 5, "after", 10.0, 120)], SCHEMA)


def test_titles_and_sections(lines):
    got = {(r.page, r.line_no): r for r in L.with_sections(L.titled(lines)).collect()}
    assert got[1, 2].is_title and got[1, 2].text == "Heat and Work" and not got[1, 3].is_title
    assert not got[1, 4].is_title and got[1, 1].section is None
    assert got[1, 5].section == "Heat and Work" == got[2, 1].section
    assert got[2, 3].section == "Light" and got[2, 4].section == "Light" == got[2, 5].section
    blocks = {r.unit: r.blocks for r in L.line_blocks(L.with_sections(L.titled(lines))).collect()}
    assert blocks[1][1].block_type == "heading" and blocks[1][1].section_path == ["Heat and Work"] and blocks[1][0].section_path == []


def test_titles_are_carried_over_many_pages(spark):
    pages = [-5, 0, 1, 1023, 1024, 1025, 5000, 2**21 - 1, 2**21, 2**21 + 3, 2**25, 2**31 - 1]
    for titled_pages in ([], [0], [-5, 1024], [1, 5000, 2**21], [1023, 2**21 - 1, 2**25]):
        marks = spark.createDataFrame([(d, p, f"{d}{p}" if p in titled_pages else None) for d in ("a", None) for p in pages], "doc string, page int, title string")
        got = {(r.doc, r.page): r.title for r in L.carried(marks, "doc", "page", "title").collect()}
        assert got == {(d, p): next((f"{d}{q}" for q in reversed(pages) if q < p and q in titled_pages), None) for d in ("a", None) for p in pages}
        assert got == {(r.doc, r.page): r.title for r in L.carried(marks, "doc", "page", "title", (2, 4, 9)).collect()}


def test_null_documents_and_pages(spark):
    null_page = spark.createDataFrame([(None, None, 1, "Early", 20.0, 0.0, 0.0, 1.0, 9.0, True), (None, 1, 1, "body.", 10.0, 0.0, 0.0, 1.0, 9.0, False)], "doc_id string, page int, line_no int, text string, size double, x0 double, y0 double, x1 double, y1 double, is_title boolean")
    assert {r.page: r.section for r in L.with_sections(null_page).collect()} == {None: "Early", 1: "Early"}


def test_lines_are_dealt_once_for_a_page_and_once_for_a_group(lines):
    plan = L.with_sections(L.titled(lines))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("percentile(") == 1 and "Generate" not in plan
    plan = L.with_sections(L.titled(lines.where("page = 2")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sections_on_pages_of_many_groups(spark):
    pages = [None, -(2**31), -1, 0, 1, 1023, 1024, 2**21, 2**31 - 1]
    titled = [(d, p, 2, f"{d}{p}", 20.0, True) for d in ("a", None) for p in (None, -1, 1023, 2**21)]
    rows = [*titled, *[(d, p, n, "body", y, False) for d in ("a", None) for p in pages for n, y in ((1, 17.9), (3, 18.0))]]
    got = L.with_sections(spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, y0 double, is_title boolean")).where("NOT is_title").collect()
    place = {p: n for n, p in enumerate(pages)}
    before = lambda d, p, here: next((f"{d}{q}" for q in (2**21, 1023, -1, None) if place[q] < place[p] or (here and q == p)), None)
    assert {(r.doc_id, r.page, r.line_no): r.section for r in got} == {(d, p, n): before(d, p, n == 3) for d in ("a", None) for p in pages for n in (1, 3)}


@pytest.mark.parametrize(("text", "size", "want"), [("Heat", 16.0, True), ("Heat", 15.99, False), ("Heat.", 20.0, False), ("H", 20.0, False), ("12.3", 20.0, False), ("x" * 120, 20.0, True), ("x" * 121, 20.0, False), ("  ", 20.0, False), ("Heat”", 20.0, False), (None, 20.0, False)])
def test_title_rule(spark, text, size, want):
    row = spark.createDataFrame([(text, size)], "t string, s double")
    assert row.select(L.is_title(F.col("t"), F.col("s"), F.lit(10.0)).alias("x")).first().x is want


def test_three_title_lines_join_by_pairs(spark):
    rows = spark.createDataFrame([line(1, 1, "One", 20.0, 0), line(1, 2, "Two", 20.0, 12), line(1, 3, "Three", 20.0, 24), *[line(1, k, "body text.", 10.0, 40 * k) for k in range(4, 9)]], SCHEMA)
    assert [r.text for r in L.titled(rows).where("is_title").collect()] == ["One Two"]


def test_outside_tables(spark, lines):
    boxes = spark.createDataFrame([("d", 1, 50.0, 205.0, 60.0, 225.0), ("d", 2, 0.0, 90.0, 100.0, 111.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    left = {(r.page, r.line_no) for r in L.outside_tables(L.titled(lines), boxes).collect()}
    everything = {(r.page, r.line_no) for r in lines.collect()}
    assert everything - left == {(1, 5), (1, 6), (2, 3)}


def test_table_markdown(spark):
    rows = [("d", 1, 1, [["a", "b|c"], ["", " "], ["d"]]), ("d", 1, 2, [["a", "b|c"], ["d", ""]]), ("d", 1, 3, [[""]]), ("d", 2, 1, [["x", None]])]
    got = {(r.page, r.table_no): r.markdown for r in L.tables(spark.createDataFrame(rows, "doc_id string, page int, table_no int, rows array<array<string>>")).collect()}
    assert got == {(1, 1): "| a | b\\|c |\n| --- | --- |\n| d |  |", (2, 1): "| x |  |\n| --- | --- |"}


def test_assembly(spark):
    spans = [("d", 1, 1, 1, "abc", 10.0, True), ("d", 1, 1, 2, "  ", 99.0, False), ("d", 1, 1, 3, "de", 20.0, False), ("d", 1, 2, 1, " ", 1.0, True)]
    got = L.assemble_lines(spark.createDataFrame(spans, "doc_id string, page int, line_no int, span_no int, text string, size double, bold boolean")).collect()
    assert [(r.line_no, r.text, r.size, r.bold) for r in got] == [(1, "abc  de", 10.0, True)]


def test_medians(spark):
    sizes = [10.0, 12.0, 8.0, 11.0]
    rows = spark.createDataFrame([line(1, k, "x", s, k) for k, s in enumerate(sizes)], SCHEMA)
    assert L.titled(rows).first().body == statistics.median(sizes)


def test_images_and_recognition(spark):
    rows = [("d", 1, x, x, 200, 200, 50.0 if x != 3 else 1.0, 1000.0) for x in range(12)] + [("d", 1, 20, 0, 119, 500, 900.0, 1000.0), ("d", 1, 0, 30, 200, 200, 60.0, 1000.0)]
    got = L.images(spark.createDataFrame(rows, "doc_id string, page int, xref int, order_no int, width int, height int, area double, page_area double")).collect()
    assert sorted(r.xref for r in got) == [0, 1, 2, 4, 5, 6, 7, 8]
    blocks = spark.createDataFrame([("d", 1, " " * 90), ("d", 2, "x" * 80), ("d", 3, None)], "doc_id string, page int, text string")
    assert sorted(r.page for r in L.needs_recognition(blocks).collect()) == [1, 3]


def test_lines_of_one_place_stand_by_the_named_columns(spark):
    rows = [line(1, 1, "Upper", 20.0, 0), line(1, 2, "Left", 20.0, 12), (*line(1, 2, "Right", 20.0, 12)[:5], 50.0, 12.0, 100.0, 22.0), *[line(1, k, "body text.", 10.0, 40 * k) for k in range(4, 12)]]
    for some in (rows, rows[::-1]):
        got = {r.text for r in L.titled(spark.createDataFrame(some, SCHEMA).coalesce(1)).where("is_title").collect()}
        assert got == {"Upper Left", "Right"}


def test_of_places_of_one_area_the_first_counts(spark):
    rows = [("d", 1, 7, 1, 50, 200, 400.0, 1000.0), ("d", 1, 7, 2, 200, 200, 400.0, 1000.0), ("d", 1, 8, 3, 200, 200, 400.0, 1000.0), ("d", 1, 8, 4, 50, 200, 400.0, 1000.0), ("d", 1, 9, 5, 200, 200, None, 1000.0)]
    schema = "doc_id string, page int, xref int, order_no int, width int, height int, area double, page_area double"
    for some in (rows, rows[::-1]):
        assert [(r.xref, r.order_no) for r in L.images(spark.createDataFrame(some, schema).coalesce(1)).collect()] == [(8, 3)]
