"""Text units of pages: cells, flipped cells, prose, re-cased and flipped prose, with an order that dedupe relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.operators.minors import column_role

_LABEL = r"(?im)^\s*(?:" + "|".join(r"\s+".join(p.split()) for p in vocab.PROSE_LABELS) + r")\s*[:\-]\s*([^\n\r]{3,80})"


def column_facts(cells: DataFrame) -> DataFrame:
    """(file, page_num, table_id, c, col_role, is_name_column): from the header in row 0 and the shape of the data cells."""
    keys = ["file", "page_num", "table_id", "c"]
    header = F.max(F.when(F.col("r") == 0, F.coalesce("cell", F.lit("")))).alias("header")
    shaped = F.sum(F.when((F.col("r") > 0) & T.flipped_name(F.coalesce("cell", F.lit(""))).isNotNull(), 1).otherwise(0)).alias("shaped")
    facts = cells.groupBy(*keys).agg(header, shaped)
    named = T.normalize_context(F.coalesce("header", F.lit(""))).rlike(T.phrase_pattern(vocab.NAME_COLUMN)) | (F.col("shaped") >= 2)
    return facts.select(*keys, column_role(F.col("header")).alias("col_role"), named.alias("is_name_column"))


def cell_units(cells: DataFrame) -> DataFrame:
    """A unit of each cell that isn't blank, and a flipped one after it in name columns; header cells have no role."""
    text = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"(?U)\s*\n\s*", " "))
    rows = cells.join(column_facts(cells), ["file", "page_num", "table_id", "c"]).withColumn("t", text).filter("t != ''")
    role = F.when(F.col("r") == 0, "").otherwise(F.col("col_role"))
    flipped = F.when(F.col("is_name_column"), T.flipped_name(F.col("t")))
    one = F.struct(F.lit("cell").alias("kind"), F.col("t").alias("analysis_text"))
    two = F.struct(F.lit("flipped").alias("kind"), flipped.alias("analysis_text"))
    rows = rows.withColumn("role", role).withColumn("u", F.explode(F.when(flipped.isNotNull() & (flipped != F.col("t")), F.array(one, two)).otherwise(F.array(one))))
    return rows.select("file", "page_num", F.col("u.kind"), F.col("u.analysis_text"), F.col("t").alias("source_text"), F.col("role").alias("col_role"), F.struct(F.lit(0).alias("g"), "table_id", "r", "c", F.when(F.col("u.kind") == "cell", 0).otherwise(1).alias("k")).alias("seq"))


def _seq(group: int, line, k: int = 0):
    return F.struct(F.lit(group).alias("g"), F.lit(0).alias("table_id"), line.cast("int").alias("r"), F.lit(0).alias("c"), F.lit(k).alias("k"))


def truecase_units(units: DataFrame, group: int = 2) -> DataFrame:
    """A re-cased twin of each predominantly upper-case line; same length, the source keeps its casing."""
    lines = units.select("file", "page_num", "col_role", F.posexplode(F.split("source_text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    twin = lines.filter((F.col("line") != "") & T.is_uppercase_line(F.col("line"))).withColumn("t", T.titlecase(F.col("line"))).filter("t != line")
    return twin.select("file", "page_num", F.lit("truecase").alias("kind"), F.col("t").alias("analysis_text"), F.col("line").alias("source_text"), "col_role", _seq(group, F.col("n")).alias("seq"))


def flipped_fragments(pages: DataFrame, text: str = "text") -> DataFrame:
    """(file, page_num, flipped, fragment): surname-first names after labels, then in short lines with a comma and in the
    parts of these between semicolons; each flipped name once a page, the first one found."""
    t = F.col(text)
    labels = F.transform(F.regexp_extract_all(t, F.lit(_LABEL), F.lit(1)), lambda v: F.struct(F.lit(0).alias("g"), v.alias("f")))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(3, 60) & x.contains(","))
    of_line = F.transform(lines, lambda x: F.concat(F.array(x), F.when(x.contains(";"), F.split(x, ";")).otherwise(F.expr("cast(array() as array<string>)"))))
    rows = pages.select("file", "page_num", F.posexplode(F.concat(labels, F.transform(F.flatten(of_line), lambda v: F.struct(F.lit(1).alias("g"), v.alias("f"))))).alias("n", "o"))
    rows = rows.withColumn("fragment", F.regexp_replace(F.trim("o.f"), r"[.;]+$", "")).filter("fragment != ''")
    tail = lambda p: F.when(F.col("fragment").rlike(p), F.trim(F.regexp_extract("fragment", f"(?s)^.*{p}(.*)$", 1)))
    tries = [F.col("fragment"), tail(":"), tail(" - "), tail("\t")]
    flips = F.transform(F.array_compact(F.array(*tries)), lambda x: F.struct(T.flipped_name(x).alias("flipped"), x.alias("fragment")))
    pick = F.get(F.filter(flips, lambda p: p["flipped"].isNotNull()), 0)
    rows = rows.withColumn("p", pick).filter("p is not null and p.flipped != p.fragment").select("file", "page_num", "n", "p.*")
    best = F.min(F.struct("n", "fragment")).alias("b")
    return rows.groupBy("file", "page_num", "flipped").agg(best).select("file", "page_num", "flipped", "b.fragment", "b.n")


def page_units(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(file, page_num, kind, analysis_text, source_text, col_role, seq) of pages (file, page_num, text) and their cells.

    A reader that finds tables may give pages a column prose, the text outside them, which then is what prose units hold.
    A page that has a cell with an error falls back to its whole text, upper-case lines re-cased."""
    none = F.lit("").alias("col_role")
    body, flips = pages, flipped_fragments(pages)
    if cells is not None and "error" in cells.columns:
        failed = cells.filter("error IS NOT NULL").select("file", "page_num").distinct()
        cells, flips = (x.join(failed, ["file", "page_num"], "left_anti") for x in (cells, flips))
        body = pages.join(failed.withColumn("failed", F.lit(True)), ["file", "page_num"], "left")
    if "prose" in pages.columns:
        outside = F.coalesce("prose", "text")
        body = body.withColumn("text", F.when(F.col("failed"), F.col("text")).otherwise(outside) if "failed" in body.columns else outside)
    prose = body.filter(F.trim("text") != "").select("file", "page_num", F.lit("prose").alias("kind"), F.col("text").alias("analysis_text"), F.col("text").alias("source_text"), none, _seq(1, F.lit(0)).alias("seq"))
    flips = flips.select("file", "page_num", F.lit("flipped").alias("kind"), F.col("flipped").alias("analysis_text"), F.col("fragment").alias("source_text"), none, _seq(3, F.col("n")).alias("seq"))
    units = prose if cells is None else cell_units(cells).unionByName(prose)
    return units.unionByName(truecase_units(units)).unionByName(flips)


def page_problems(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(file, page_num, reason): pages that couldn't be read (column error, where there is one, names what was raised),
    blank ones, those with over 30% of broken characters, and those whose tables couldn't be read (error of a cell)."""
    text = F.coalesce("text", F.lit(""))
    reason = F.when(F.trim(text) == "", "empty_text_layer").when(T.page_garbage_ratio(text) > 0.30, "ocr_garbage_suspected")
    if "error" in pages.columns:
        reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("extract_error: "), F.col("error"))).otherwise(reason)
    found = pages.select("file", "page_num", reason.alias("reason")).filter("reason is not null")
    if cells is not None and "error" in cells.columns:
        tables = cells.filter("error IS NOT NULL").groupBy("file", "page_num").agg(F.concat(F.lit("table_fallback: "), F.min("error")).alias("reason"))
        found = found.unionByName(tables)
    return found


def first_variants(hits: DataFrame) -> DataFrame:
    """Originals all stay; a variant hit stays only if no original and no earlier variant of its page has its key."""
    first = hits.filter("not is_variant").select("file", "page_num", "name_key").distinct()
    variants = hits.filter("is_variant").join(first, ["file", "page_num", "name_key"], "left_anti")
    order = Window.partitionBy("file", "page_num", "name_key").orderBy("seq")
    variants = variants.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return hits.filter("not is_variant").unionByName(variants)


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks (file, start_page, end_page) that aren't done."""
    return chunks.join(done, ["file", "start_page", "end_page"], "left_anti")
