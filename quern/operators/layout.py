"""Lines of a page as headings and paragraphs of lessons, tables apart; on a DataFrame of lines.

Lines have doc_id, page, line_no, text, size, x0, y0, x1, y1; boxes of tables doc_id, page, x0, y0, x1, y1. What a
page or document needs together is a window over it; every other step is an expression or an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Bits by which pages are grouped to carry a title from page to page.
CARRY = (10, 21)
TITLE_RATIO, TITLE_CHARS, MERGE_GAP, SAME_SIZE, TITLE_SLACK = 1.60, 120, 1.8, 0.6, 2.0
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MOST_IMAGES, LEAST_CHARS = 120, 120, 0.02, 8, 80


def converted(spans: DataFrame, convert: Callable[[str, str], object] | None = None, font: str = "font") -> DataFrame:
    """``spans`` with texts of fonts that have codes of their own turned to Unicode by ``convert``, a function of text and
    font's name. It may return a text, a tuple that begins with one, or an object with a field ``text``,
    ``converted_text`` or ``output``; anything else is an error. Without it texts stay as they are, as blank ones do."""
    if convert is None:
        return spans

    def unicode(text: str | None, name: str | None) -> str | None:
        if text is None or not text.strip():
            return text
        found = convert(text, name or "")
        tried = (found, found[0] if isinstance(found, tuple) and found else None, *(getattr(found, a, None) for a in ("text", "converted_text", "output")))
        for value in tried:
            if isinstance(value, str):
                return value
        raise TypeError(f"a font's conversion gave {type(found).__name__}")

    @F.arrow_udf("string")
    def run(texts: pa.Array, fonts: pa.Array) -> pa.Array:
        return pa.array([unicode(t, f) for t, f in zip(texts.to_pylist(), fonts.to_pylist(), strict=True)], pa.string())

    return spans.withColumn("text", run(F.col("text"), F.col(font)))


def assemble_lines(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, line_no, span_no, text, size, bold) as lines: text in order, size as the median weighted
    by characters (the first size at which half of them are reached), bold from 60 % of bold characters on."""
    spans = spans.withColumn("chars", F.length(T.strip(F.coalesce("text", F.lit("")))))
    line = ["doc_id", "page", "line_no"]
    w = Window.partitionBy(*line)
    running = spans.where("chars > 0").withColumn("upto", F.sum("chars").over(w.orderBy("size").rangeBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("chars").over(w))
    sizes = running.where("upto >= all / 2").groupBy(*line).agg(F.min("size").alias("size"))
    texts = spans.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text"), (F.sum(F.when(F.col("bold"), F.col("chars")).otherwise(0)) >= 0.6 * F.sum("chars")).alias("bold"))
    return texts.where(T.strip(F.col("text")) != "").join(sizes, line, "left").withColumn("size", F.coalesce("size", F.lit(0.0)))


def is_title(text: Column, size: Column, body: Column) -> Column:
    """Whether a line is a lesson's title: short, not only numbers or signs, no final stop, well above body size. Texts are
    read of lines of that size only."""
    plain = T.normalise_space(text)
    worded = (plain != "") & (F.length(plain) <= TITLE_CHARS) & plain.rlike(r"[^\d\W_]|[\x{0D80}-\x{0DFF}]") & (F.length(F.replace(plain, F.lit(" "))) >= 2) & ~F.substring(plain, -1, 1).isin(*'.,;:!?”"')
    return F.coalesce(F.when(size >= body * TITLE_RATIO, worded), F.lit(False))


def titled(lines: DataFrame, ties: tuple[str, ...] = ("x0", "text", "size")) -> DataFrame:
    """``lines`` with body (median size of the page), is_title, and titles that were split over two lines joined.

    Each title is compared with the next one down the page as both were before any joining. Lines of one height and
    number stand in the order of the columns ``ties``. The page's median and its titles' neighbours are windows of one
    order, so lines are dealt and sorted once.
    """
    down = Window.partitionBy("doc_id", "page").orderBy("y0", "line_no", *ties)
    rows = lines.where("doc_id IS NOT NULL AND page IS NOT NULL")
    rows = rows.withColumn("body", F.percentile("size", F.lit(0.5)).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("is_title", is_title(F.col("text"), F.col("size"), F.col("body")))
    fits = lambda upper, lower: F.coalesce((F.abs(upper["size"] - lower["size"]) <= SAME_SIZE) & (lower["y0"] - upper["y1"]).between(0, (lower["y1"] - lower["y0"]) * MERGE_GAP), F.lit(False))
    rows = rows.withColumn("own", F.when(F.col("is_title"), F.struct("size", "y0", "y1", "text")))
    of_page = f"OVER (PARTITION BY doc_id, page ORDER BY {', '.join(('y0', 'line_no', *ties))})"
    rows = rows.withColumn("above", F.expr(f"lag(own) IGNORE NULLS {of_page}")).withColumn("below", F.expr(f"lead(own) IGNORE NULLS {of_page}"))
    joined_up = F.col("is_title") & fits(F.col("above"), F.col("own"))
    with_below = F.concat_ws(" ", T.strip(F.col("text")), T.strip(F.col("below.text")))
    rows = rows.withColumn("text", F.when(F.col("is_title") & fits(F.col("own"), F.col("below")), with_below).otherwise(F.col("text"))).withColumn("is_title", F.col("is_title") & ~joined_up)
    return rows.drop("above", "below", "own")


def outside_tables(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Titles, and lines whose centre is in no table box of their page (edges are inside).

    The boxes of a page are one array beside its lines: an equi-join on the page, not a range join.
    """
    by_page = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.exists("__boxes", lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))
    return lines.join(by_page, ["doc_id", "page"], "left").where(F.col("is_title") | ~F.coalesce(inside, F.lit(False))).drop("__boxes")


def carried(marks: DataFrame, key: str, at: str, value: str, shifts: tuple[int, ...] = CARRY) -> DataFrame:
    """(key, at, value) of ``marks``, one for each key and whole number ``at``: the last value before, null without one.

    Numbers are taken in groups of those that share their higher bits: values are carried within a group, and the last
    value of each group is carried over to the next in the same way. No window has more than some thousand rows,
    however many numbers a key has.
    """
    group = f"__group{len(shifts)}"  # each level has a column of its own
    rows = marks.withColumn(group, F.shiftright(at, shifts[0]) if shifts else F.lit(0))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(key, group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    own = rows.select(key, at, group, within.alias("__own"))
    if not shifts:
        return own.select(key, at, F.col("__own").alias(value))
    last = rows.groupBy(key, group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias(value))
    above = carried(last, key, group, value, tuple(s - shifts[0] for s in shifts[1:])).select(F.col(key).alias("__key"), F.col(group).alias("__above"), F.col(value).alias("__value"))
    both = own.join(above, F.col(key).eqNullSafe(F.col("__key")) & (F.col(group) == F.col("__above")))
    return both.select(key, at, F.coalesce("__own", "__value").alias(value))


def with_sections(lines: DataFrame) -> DataFrame:
    """``lines`` with section: the last title that begins no more than a little below the line, on its page or an
    earlier one; null before the first title. An as-of join of three parts: a window over the lines of a page up to a
    height, one over the earlier pages of a group, and the last title of earlier groups carried from group to group. The
    first and the last page's number are read beforehand, so that no lines are dealt for parts which no page can need.
    A null page comes before the others."""
    lines = lines.withColumn("__page", F.coalesce(F.col("page").cast("bigint"), F.lit(-(1 << 31) - 1))).withColumn("__group", F.shiftright("__page", CARRY[0]))
    first, last = lines.agg(F.min("__page"), F.max("__page")).first()
    rows = lines.withColumn("__title", F.when(F.col("is_title"), T.strip(F.col("text")))).withColumn("__at", F.when(F.col("__title").isNotNull(), F.struct("__page", "y0", "text", "line_no")))
    out = rows.withColumn("section", F.expr(f"max_by(__title, __at) OVER (PARTITION BY doc_id, page ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND {TITLE_SLACK}D FOLLOWING)"))
    if first != last:
        earlier = Window.partitionBy("doc_id", "__group").orderBy("__page").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("section", F.coalesce("section", F.max_by("__title", "__at").over(earlier)))
    if first != last and first >> CARRY[0] != last >> CARRY[0]:
        groups = rows.groupBy("doc_id", "__group").agg(F.max_by("__title", "__at").alias("__last"))
        before = carried(groups, "doc_id", "__group", "__last", tuple(s - CARRY[0] for s in CARRY[1:])).where("__last IS NOT NULL")
        before = before.select(F.col("doc_id").alias("__doc"), F.col("__group").alias("__above"), "__last")
        out = out.join(before, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__group") == F.col("__above")), "left")
        out = out.withColumn("section", F.coalesce("section", "__last")).drop("__doc", "__above", "__last")
    return out.drop("__page", "__group", "__title", "__at")


def line_blocks(lines: DataFrame) -> DataFrame:
    """Lines with sections as units of blocks, in order of the lines."""
    b = F.struct(F.when(F.col("is_title"), "heading").otherwise("paragraph").alias("block_type"), "text", F.when(F.col("section").isNull(), F.array().cast("array<string>")).otherwise(F.array("section")).alias("section_path"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.lit(None).cast("map<string,string>").alias("metadata"))
    grouped = lines.withColumn("b", b).groupBy("doc_id", F.col("page").alias("unit")).agg(F.sort_array(F.collect_list(F.struct("line_no", "b.block_type", "b.text", "b.section_path", "b.bbox"))).alias("bs"))
    return grouped.select("doc_id", "unit", F.transform("bs", lambda x: F.struct(x["block_type"].alias("block_type"), x["text"].alias("text"), x["section_path"].alias("section_path"), x["bbox"].alias("bbox"), F.lit(None).cast("map<string,string>").alias("metadata"))).alias("blocks"))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a markdown table: blank rows dropped, short rows padded; null without a row."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), T.markdown_cell), " | "), F.lit(" |"))
    lines = F.transform(clean, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(clean) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))), "\n"))


def tables(found: DataFrame) -> DataFrame:
    """Tables (doc_id, page, table_no, rows) with their markdown, equal ones of a page once, those without text never."""
    shown = found.withColumn("markdown", table_markdown(F.col("rows"))).where("markdown is not null")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "markdown").orderBy("table_no"))
    return shown.withColumn("__n", nth).where("__n = 1").drop("__n")


def needs_recognition(blocks: DataFrame) -> DataFrame:
    """Pages (doc_id, page) whose blocks hold so few characters that their text should be recognised."""
    return blocks.groupBy("doc_id", "page").agg(F.sum(F.length(T.strip(F.coalesce("text", F.lit(""))))).alias("chars")).where(F.col("chars") < LEAST_CHARS)


def images(placed: DataFrame, ties: tuple[str, ...] = ("order_no", "width", "height", "page_area")) -> DataFrame:
    """Placed images (doc_id, page, xref, order_no, width, height, area, page_area): the largest place of each,
    wide, high and large enough, the first eight of a page. Of places of one area the first by the columns ``ties``
    counts; images of one order stand by ``xref``."""
    place = F.when(F.col("area").isNotNull(), F.struct((-F.col("area")).alias("area"), *ties))
    largest = placed.groupBy("doc_id", "page", "xref").agg(F.min("order_no").alias("order_no"), F.min_by(F.struct("width", "height", "area", "page_area"), place).alias("p")).select("doc_id", "page", "xref", "order_no", "p.*")
    good = largest.where((F.col("width") >= MIN_WIDTH) & (F.col("height") >= MIN_HEIGHT) & (F.col("area") / F.greatest("page_area", F.lit(1.0)) >= MIN_AREA))
    return good.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("order_no", "xref"))).where(F.col("__n") <= MOST_IMAGES).drop("__n")


def section_of(blocks: Column, label: Column) -> Column:
    """The first section path of a unit's blocks, else its label."""
    paths = F.filter(F.transform(blocks, lambda b: b["section_path"]), lambda p: F.size(p) > 0)
    return F.coalesce(F.try_element_at(paths, F.lit(1)), F.array(label))
