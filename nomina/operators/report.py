"""The review list, what it holds back, its totals, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina import vocab
from nomina.functions import text as T
from nomina.operators.names import duplicate_flags, merge_inverted, roll_up
from nomina.operators.scoring import tier_for
from nomina.sources.tables import stored

#: The columns in their order.
COLUMNS = [
    "name", "tier", "confidence", "possible_minor", "occurrence_count", "file_count", "locations", "possible_duplicate_of",
    "recognizer", "minor_tier", "minor_binding", "minor_reason", "suppressed", "suppress_reason", "also_reported_as",
    "suppressed_fraction", "rescued_from",
]


def name_table(hits: DataFrame) -> DataFrame:
    """Names after inverted ones were folded into their plain form."""
    to = merge_inverted(hits).select(F.col("name_key").alias("_k"), "target", F.when(F.col("target") != F.col("name_key"), F.col("display")).alias("_form"))
    keyed = hits.withColumn("_k", T.dedup_key(F.col("raw_name"))).join(to.hint("merge"), "_k")
    return roll_up(keyed.drop("_k"), F.col("target"), F.col("_form"))


def report_rows(hits: DataFrame, certain: float = vocab.CERTAIN, light: float = vocab.LIGHT, fuzzy: float | None = vocab.FUZZY) -> DataFrame:
    """The 17 columns for every name, held-back ones too; tier rank and key are kept for the order."""
    names = stored(name_table(hits))  # read by both sides of the duplicate pairs
    if fuzzy is not None:
        names = names.join(duplicate_flags(names.select("name_key", "display"), fuzzy).hint("merge"), "name_key", "left")
    else:
        names = names.withColumn("possible_duplicates", F.lit(None).cast("array<string>"))
    fraction = F.col("suppressed_count") / F.col("occurrence_count")
    tier = tier_for(F.col("confidence"), fraction, certain, light)
    held = F.col("suppressed_count") == F.col("occurrence_count")
    files = F.array_sort(F.array_distinct(F.transform("locations", lambda x: x["file"])))
    place = F.transform(files, lambda f: F.concat(f, F.lit(":"), T.compress_pages(F.transform(F.filter("locations", lambda x: x["file"] == f), lambda x: x["page_num"].cast("long")))))
    yes = lambda c: F.when(c, "yes").otherwise("")
    joined = lambda a, sep="; ": F.array_join(F.coalesce(a, F.expr("cast(array() as array<string>)")), sep)
    recognizer = F.when(F.array_contains("recognizers", "both") | (F.size("recognizers") > 1), "both").otherwise(F.element_at("recognizers", 1))
    rows = names.select(
        "name_key",
        T.csv_safe(F.col("display")).alias("name"),
        tier.alias("tier"),
        F.bround("confidence", 3).alias("confidence"),
        yes(F.col("possible_minor") > 0).alias("possible_minor"),
        "occurrence_count",
        F.size(files).alias("file_count"),
        F.array_join(place, "; ").alias("locations"),
        joined(F.transform("possible_duplicates", T.csv_safe), ", ").alias("possible_duplicate_of"),
        recognizer.alias("recognizer"),
        "minor_tier",
        "minor_binding",
        F.left(joined(F.col("minor_reasons")), F.lit(500)).alias("minor_reason"),
        yes(held).alias("suppressed"),
        F.when(held, F.left(joined(F.col("suppress_reasons")), F.lit(300))).otherwise("").alias("suppress_reason"),
        F.left(joined(F.array_sort(F.transform("surfaces", T.csv_safe)), ", "), F.lit(500)).alias("also_reported_as"),
        F.when(F.col("suppressed_count") > 0, F.bround(fraction, 2)).alias("suppressed_fraction"),
        F.when((F.col("suppressed_count") > 0) & ~held, F.left(joined(F.col("suppress_reasons")), F.lit(300))).otherwise("").alias("rescued_from"),
    )
    rank = F.when(F.col("tier") == "essentially_certain", 0).when(F.col("tier") == "light_review", 1).otherwise(2)
    return rows.withColumn("tier_rank", rank)


def split_rows(rows: DataFrame, include_suppressed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(main, held back); with include_suppressed all rows and none."""
    return (rows, rows.limit(0)) if include_suppressed else (rows.filter("suppressed = ''"), rows.filter("suppressed = 'yes'"))


def totals(rows: DataFrame) -> DataFrame:
    """One row of counters over all names."""
    one = F.count_if
    return rows.agg(
        F.count(F.lit(1)).alias("names"),
        F.coalesce(F.sum("occurrence_count"), F.lit(0)).cast("long").alias("occurrences"),
        *[one(F.col("tier") == t).alias(t) for t in ("essentially_certain", "light_review", "extensive_review")],
        one(F.col("suppressed") == "yes").alias("suppressed"),
        one(F.col("rescued_from") != "").alias("rescued"),
        one(F.col("possible_minor") == "yes").alias("possible_minors"),
        *[one(F.col("minor_tier") == t).alias(f"minor_{t}") for t in ("high", "medium")],
        *[one(F.col("minor_binding") == b).alias(f"bound_by_{b}") for b in ("column", "label", "dob", "relation")],
        *[one(F.col("recognizer") == r).alias(f"recognizer_{r}") for r in ("spacy", "gazetteer", "both")],
    )


def file_stats(hits: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(file, hits, suppressed, problems): problems as reason:count joined."""
    out = hits.groupBy("file").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("suppressed").cast("int")).cast("long").alias("suppressed"))
    if problems is None:
        return out.withColumn("problems", F.lit(""))
    per = problems.groupBy("file", "reason").count().groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", "count"))), "; ").alias("problems"))
    return out.join(per, "file", "full_outer").select("file", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("suppressed", F.lit(0)).alias("suppressed"), F.coalesce("problems", F.lit("")).alias("problems"))


def scanned_files(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, status, page_count, pages_scanned, chunks_completed, hits, suppressed, problems) by the pages that a scan
    tells of; status is `complete` once every page up to the last was scanned, else `partial`."""
    n = F.countDistinct("page_num")
    per = pages.groupBy("file").agg(F.max("end_page").alias("page_count"), n.alias("pages_scanned"), F.countDistinct("start_page").alias("chunks_completed"))
    problems = pages.select("file", "page_num", F.explode("reasons").alias("reason"))
    status = F.when(F.col("pages_scanned") >= F.col("page_count"), "complete").otherwise("partial").alias("status")
    out = per.join(file_stats(hits, problems), "file", "left").na.fill({"hits": 0, "suppressed": 0, "problems": ""})
    return out.select("file", status, "page_count", "pages_scanned", "chunks_completed", "hits", "suppressed", "problems")


def manifest(main: DataFrame, held: DataFrame, out: str, files: DataFrame | None = None, include_suppressed: bool = False, certain: float = vocab.CERTAIN, light: float = vocab.LIGHT, fuzzy: float | None = vocab.FUZZY) -> DataFrame:
    """One row: when and from what the lists were made, what they count, and what was held back for which reason."""
    one = lambda c, *values: F.struct(*[F.count_if(F.col(c) == v).alias(v) for v in values])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = main.agg(
        F.struct(
            F.count(F.lit(1)).alias("unique_names"),
            total("occurrence_count").alias("total_occurrences"),
            F.count_if(F.col("possible_minor") == "yes").alias("possible_minor_names"),
            one("minor_tier", "high", "medium", "low").alias("by_minor_tier"),
            one("minor_binding", "column", "label", "dob", "relation").alias("by_minor_binding"),
            one("tier", "essentially_certain", "light_review", "extensive_review").alias("by_tier"),
            one("recognizer", "spacy", "gazetteer", "both").alias("by_recognizer"),
        ).alias("totals"),
        F.count_if(F.col("rescued_from") != "").alias("names_rescued"),
    )
    reason = F.coalesce(F.nullif(F.substring_index("suppress_reason", "|", 1), F.lit("")), F.lit("unknown"))
    by = held.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))  # a row a reason
    kept = held.agg(F.count(F.lit(1)).alias("names_withheld"), total("occurrence_count").alias("occurrences_withheld"), F.count_if(F.col("possible_minor") == "yes").alias("possible_minor_withheld"))
    body = counted.crossJoin(by).crossJoin(kept)  # one row each
    pages = F.lit(None).cast("long")
    if files is not None:
        body, pages = body.crossJoin(files.agg(total("page_count").alias("pages"))), F.col("pages")
    return body.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_utc"),
        F.lit(out).alias("output_csv"),
        F.lit(f"{out}.suppressed").alias("suppressed_csv"),
        F.struct(F.lit(certain).alias("certain"), F.lit(light).alias("light"), F.lit(fuzzy).cast("double").alias("fuzzy_similarity"), F.lit(fuzzy is not None).alias("fuzzy_enabled")).alias("thresholds"),
        F.struct(F.lit(include_suppressed).alias("include_suppressed"), "names_rescued", "names_withheld", "by_reason", "occurrences_withheld", "possible_minor_withheld").alias("suppression"),
        F.col("totals").withField("pages_in_corpus", pages).alias("totals"),
    )


def write_report(hits: DataFrame, out: str, pages: DataFrame | None = None, include_suppressed: bool = False, **settings) -> None:
    """CSV of the main list, CSV of what is held back (with a header even when empty), JSON lines of the files scanned
    and a JSON manifest, as folders."""
    rows = stored(report_rows(hits, **settings))
    main, held = split_rows(rows, include_suppressed)
    for part, where in ((main, out), (held, f"{out}.suppressed")):
        ordered = part.orderBy("tier_rank", F.lower("name"), "name_key").select(*COLUMNS)
        ordered.write.mode("overwrite").csv(where, header=True, quote='"', escape='"', emptyValue="")
    files = None if pages is None else scanned_files(hits, pages)
    (file_stats(hits) if files is None else files).write.mode("overwrite").json(f"{out}.files")
    manifest(main, held, out, files, include_suppressed, **settings).write.mode("overwrite").json(f"{out}.manifest")
