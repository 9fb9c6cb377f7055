"""Queries over the review engine's operators: whole tables where these hold such text, fixture rows where they don't.

Each has SQL for DuckDB where that can express it. AS_OF fixes the year for what depends on age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.functions import text as T
from nomina.operators import minors, names, report, scoring, spans, suppression, units
from nomina.oracles import oracle_sql
from nomina.plans import scan
from nomina.sources import files
from nomina.sources.tables import stored

AS_OF = 2026
#: Corpus names: words of the part table's names stand in for a dictionary beside these people.
PEOPLE = ["georgia", "bell", "zofia", "kowalska", "autumn", "winters", "sarah", "kowalski", "ann", "lee", "bo", "kim", "al", "roe", "cy", "di", "poe", "ed", "fox", "amara", "osei", "john", "smith"]
COMMON = ["white", "house", "green", "bay", "bell", "summer", "church"]
PAGES = [
    ("a.txt", 1, "Student: Ann Lee\nCase manager: Bo Kim\nthe minor children, Al Roe and Cy Roe\n"),
    ("a.txt", 2, "a classmate, Di Poe. Ed Fox, age 15\nGeorgia Bell of White House\nwith Summer Church. Autumn Winters came"),
    ("a.txt", 3, "RE: Osei, Amara\nSARAH KOWALSKI AND JOHN SMITH\n"),
    ("b.txt", 1, "Dear Sarah Kowalski, Dr. Zofia Kowalska and John Smith Hospital wrote. John Smith syndrome"),
    ("b.txt", 2, ""),
    ("b.txt", 4, "†¶{}|\\^~<> ¬†‡¶ {}{}"),
]
SUPPRESS = [
    ("Stevens Council", "", ""), ("Summer Church", "", ""), ("Mercy Valley Health", "", ""), ("St. John", "", " Hospital"),
    ("St. John", "", "'s Hospital"), ("John Smith", "", " was admitted to Mercy Hospital"), ("Klinefelter", "", " syndrome"),
    ("Bell", "", ""), ("Down's", "", ""), ("John Smith", "", " presented with Down syndrome"), ("Klinefelter", "Dx: ", ""),
    ("Smith John", "", "   E11.9"), ("Dear", "", ""), ("Best", "", ""), ("Foo:///bar", "", ""), ("J0hn", "", ""), ("Ng", "", ""),
]
CELLS = [
    ("a.txt", 1, 0, r, c, x)
    for r, row in enumerate([["Student", "Parent", "Note"], ["Lee, Ann", "Kim, Bo", "tall"], ["Roe, Al", "Fox, Ed", " "], ["Poe,\nDi", "", "x"]])
    for c, x in enumerate(row)
]
SPANS = [
    (1, 0, 12, "PERSON", 0.85, "spacy"), (1, 0, 12, "PERSON", 0.65, "gazetteer"), (2, 0, 5, "PERSON", 0.85, "spacy"), (2, 6, 12, "PERSON", 0.65, "gazetteer"),
    (3, 0, 6, "PERSON", 0.65, "gazetteer"), (3, 4, 10, "PERSON", 0.85, "spacy"), (3, 9, 14, "PERSON", 0.65, "gazetteer"), (1, 3, 9, "ORG", 0.8, "spacy"), (2, 5, 6, "GPE", 0.8, "spacy"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+$", ""))


def _people(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PEOPLE], "token string")


def _common(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in COMMON], "token string")


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "file string, page_num int, text string")


def _hits(spark: SparkSession) -> DataFrame:
    cells = spark.createDataFrame(CELLS, "file string, page_num int, table_id int, r int, c int, cell string")
    deny = spark.createDataFrame([("summer",), ("church",)], "token string")
    return stored(scan.hits(_pages(spark), _people(spark), AS_OF, _common(spark), cells, deny))


def _corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded capitalised words of the documents, as a dictionary."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0)))
    return _docs(spark, sf_dir).select(words.alias("w")).select(F.lower("w").alias("token")).distinct()


def norm_name(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.normalize_name(F.col("line")).alias("name"), T.dedup_key(F.col("line")).alias("name_key"))


def context_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_context(F.col("text"))).alias("flat"))


def page_garbage(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.page_garbage_ratio(F.col("text")), 6).alias("ratio"))


def uppercase_lines(spark, sf_dir):
    return _lines(spark, sf_dir).filter(T.is_uppercase_line(F.col("line"))).select("doc_id", "line_no", "line")


def titlecase_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir).filter(T.is_uppercase_line(F.col("line")))
    return rows.select("doc_id", "line_no", T.titlecase(F.col("line")).alias("line"))


def csv_safe(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.csv_safe(F.col("line")).alias("cell"))


def page_ranges(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("long").alias("page"))
    return scoring.runs_of(rows, ["l_suppkey"], "page")


def page_lists(spark, sf_dir):
    runs = scoring.runs_of(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id")
    one = F.when(F.col("low") == F.col("high"), F.concat(F.lit("p"), "low")).otherwise(F.concat(F.lit("p"), "low", F.lit("-p"), "high"))
    per = runs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("low", one.alias("r")))).alias("rs"))
    return per.select("source", F.array_join(F.transform("rs", lambda x: x["r"]), ",").alias("pages"))


def _words_of(spark, sf_dir):
    words = F.explode(F.array_distinct(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    return _docs(spark, sf_dir).select(words.alias("word")).distinct()


def garbage_signals(spark, sf_dir):
    return _words_of(spark, sf_dir).select("word", F.array_join(suppression.garbage_signals(F.col("word")), ",").alias("signals"))


def garbage_verdicts(spark, sf_dir):
    return _words_of(spark, sf_dir).select("word", suppression.garbage_detail(F.col("word")).alias("detail"))


def latin_words(spark, sf_dir):
    return _words_of(spark, sf_dir).select("word", T.is_latin(F.col("word")).alias("latin"))


def shape_scores(spark, sf_dir):
    shape = scoring.shape_adjustment(F.col("line"))
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", shape.alias("s"))
    conf = scoring.composite(F.lit(0.85), F.lit(0.0), F.col("s"))
    return rows.select("doc_id", "line_no", F.round("s", 6).alias("shape"), F.round(conf, 6).alias("confidence"), scoring.tier_for(F.round(conf, 6), F.lit(0.0)).alias("tier"))


def sanitize_surface(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.sanitize(F.col("line")).alias("name"))


def flipped_names(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("flipped", T.flipped_name(F.col("line")))
    return rows.filter("flipped is not null").select("doc_id", "line_no", "flipped")


def prose_flipped_units(spark, sf_dir):
    pages = files.document_pages(_table(spark, sf_dir, "documents"))
    return units.flipped_fragments(pages).select("file", "page_num", "flipped", "fragment")


def page_problems(spark, sf_dir):
    return units.page_problems(files.document_pages(_table(spark, sf_dir, "documents")).unionByName(_pages(spark)))


def cell_units(spark, sf_dir):
    cells = spark.createDataFrame(CELLS, "file string, page_num int, table_id int, r int, c int, cell string")
    return units.cell_units(cells).drop("seq")


def column_roles(spark, sf_dir):
    cells = spark.createDataFrame(CELLS, "file string, page_num int, table_id int, r int, c int, cell string")
    return units.column_facts(cells)


def gazetteer_runs(spark, sf_dir):
    """Dictionary: the corpus's own capitalised words; spans over whole documents."""
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "unit_id")
    return spans.gazetteer_spans(docs, _corpus_words(spark, sf_dir))


def gazetteer_tokens(spark, sf_dir):
    lines = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("value"))
    return files.dictionary(lines)


def ambiguous_demotion(spark, sf_dir):
    pages = _pages(spark).select(F.concat_ws(":", "file", "page_num").alias("unit_id"), "text")
    return spans.gazetteer_spans(pages, _people(spark), _common(spark))


def denylist_all_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("name"))
    deny = _table(spark, sf_dir, "nation").select(F.explode(F.split(F.lower("n_name"), " ")).alias("token")).filter("token < 'nation_2'")
    return suppression.denylist_detail(rows, ["n_nationkey"], "name", deny)


def suppress_verdict(spark, sf_dir):
    rows = [(n, a + n + b, len(a), len(a) + len(n), []) for n, a, b in SUPPRESS]
    df = spark.createDataFrame(rows, "name string, ctx string, start int, end int, overlaps array<string>")
    return suppression.verdict(df).select("name", "ctx", "suppress_reason", "suppress_detail")


def org_rules(spark, sf_dir):
    """Organisation rule over customer segments and supplier names beside fixture names."""
    rows = spark.createDataFrame([(n,) for n, _, _ in SUPPRESS], "name string").union(_table(spark, sf_dir, "supplier").select("s_name"))
    return rows.distinct().select("name", suppression.org_detail(F.col("name")).alias("detail"))


def minor_bindings(spark, sf_dir):
    h = _hits(spark)
    return h.select("file", "page_num", "raw_name", "minor_binding", "minor_tier", "minor_reason")


def overlap_resolve(spark, sf_dir):
    rows = spark.createDataFrame(SPANS, "unit_id int, start int, end int, entity string, score double, recognizer string")
    return spans.resolve_overlaps(rows)


def suppressor_overlap(spark, sf_dir):
    rows = spark.createDataFrame(SPANS, "unit_id int, start int, end int, entity string, score double, recognizer string")
    out = spans.overlapping_entities(rows.filter("entity = 'PERSON'"), rows.filter("entity != 'PERSON'"))
    return out.select("unit_id", "start", "end", "recognizer", F.array_join("overlaps", ",").alias("overlaps"))


def resume_antijoin(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("file"), (F.floor(F.col("doc_id") / 100) * 100 + 1).cast("int").alias("start_page")).distinct()
    chunks = docs.withColumn("end_page", F.col("start_page") + 99)
    return units.pending_chunks(chunks, chunks.filter("start_page % 200 = 1"))


def relocate_spans(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = docs.withColumn("needle", F.regexp_extract("text", r"\w+\s+\w+", 0))
    return words.select("doc_id", F.explode(spans.locate_all("text", "needle")).alias("p")).select("doc_id", "p.start", "p.end")


def context_boosts(spark, sf_dir):
    """Five characters in the middle of each line as a span: its surroundings, the boost, the words after it."""
    rows = _lines(spark, sf_dir).withColumn("s", F.shiftright(F.length("line"), 1)).withColumn("e", F.col("s") + 5)
    at = F.col("line"), F.col("s"), F.col("e")
    after = F.array_join(suppression.tokens_after(F.col("line"), F.col("e"), 80), ",")
    return rows.select("doc_id", "line_no", T.window(*at, 30, 30).alias("near"), scoring.context_boost(*at).alias("boost"), after.alias("after"))


def boilerplate_words(spark, sf_dir):
    return _words_of(spark, sf_dir).select("word", T.boilerplate_only(F.col("word")).alias("boilerplate"))


def header_roles(spark, sf_dir):
    """The role of a column headed by each word of the documents, and of some that have one."""
    heads = spark.createDataFrame([("Student name",), ("PARENT",), ("Teacher / Pupil",), ("guardians",), ("Child",), ("minor\nchildren",)], "word string")
    return _words_of(spark, sf_dir).union(heads).select("word", minors.column_role(F.col("word")).alias("role"))


def variant_dedupe(spark, sf_dir):
    """Lines as hits named by their first word; every third is an original, the others are variants."""
    key = F.regexp_extract(T.dedup_key(F.col("line")), r"^[^\x20]+", 0)
    hits = _lines(spark, sf_dir).select(F.lit("documents").alias("file"), F.col("doc_id").alias("page_num"), F.col("line_no").alias("seq"), key.alias("name_key"), (F.col("line_no") % 3 != 0).alias("is_variant"))
    return units.first_variants(hits).select("page_num", "seq", "name_key", "is_variant")


def _doc_hits(spark, sf_dir):
    """Each line as a hit, so that the roll-up sees real rows: seq, file, page_num and fixed scores."""
    rows = _lines(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    odd = F.col("doc_id") % 3 == 0
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("line_no")).alias("seq"), F.col("source").alias("file"), F.col("doc_id").cast("int").alias("page_num"), T.normalize_name(F.col("line")).alias("raw_name"),
        F.lit(0.65).alias("boosted"), F.lit(0).alias("minor_ctx"), F.lit("").alias("minor_tier"), F.lit("").alias("minor_reason"), F.when(odd, "gazetteer").otherwise("spacy").alias("recognizer"),
        F.lit("").alias("minor_binding"), odd.cast("int").alias("suppressed"), F.when(odd, "organization|x").otherwise("").alias("suppress_reason"), F.col("line").alias("raw_surface"),
    )


def name_rollup(spark, sf_dir):
    out = names.roll_up(_doc_hits(spark, sf_dir))
    return out.select("name_key", "display", "occurrence_count", "suppressed_count", F.array_join("recognizers", ",").alias("recognizers"), F.size(F.array_distinct(F.transform("locations", lambda x: x["file"]))).alias("file_count"))


def inverted_merge(spark, sf_dir):
    return names.merge_inverted(_doc_hits(spark, sf_dir)).select("name_key", "target")


def duplicate_flags(spark, sf_dir):
    """Each name's class and number of links: numbered names are nearly all alike, so their pairs aren't written."""
    rows = _table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("name_key")).union(spark.createDataFrame([("smith john",), ("john smith",), ("jon smith",), ("amara osei",)], "name_key string"))
    return names.duplicate_classes(rows)


def ngram_counts(spark, sf_dir):
    m = scoring.NgramModel(_corpus_words(spark, sf_dir))
    return m.tri.select(F.substring("tri", 1, 3).alias("tri"), "n_tri")


def ngram_scores(spark, sf_dir):
    words = _corpus_words(spark, sf_dir)
    return scoring.NgramModel(words).score(words).select("token", F.round("score", 6).alias("score"))


def ngram_thresholds(spark, sf_dir):
    limits = scoring.NgramModel(_corpus_words(spark, sf_dir)).thresholds()
    return limits.select("pct", F.round("threshold", 6).alias("threshold"), "n")


def name_report(spark, sf_dir):
    """The whole review list over the documents: dictionary spans, verdicts, names, tiers."""
    pages = files.document_pages(_table(spark, sf_dir, "documents"))
    found = stored(scan.hits(pages, _corpus_words(spark, sf_dir), AS_OF, _common(spark)))
    return report.report_rows(found).select(*report.COLUMNS)


def fixture_report(spark, sf_dir):
    return report.report_rows(_hits(spark)).select(*report.COLUMNS)


def suppressed_rows(spark, sf_dir):
    return report.split_rows(report.report_rows(_hits(spark)))[1].select(*report.COLUMNS)


def manifest_totals(spark, sf_dir):
    return report.totals(report.report_rows(_doc_hits(spark, sf_dir), fuzzy=None))


def file_stats(spark, sf_dir):
    return report.file_stats(_doc_hits(spark, sf_dir), units.page_problems(files.document_pages(_table(spark, sf_dir, "documents"))))


_ALL = [
    norm_name, context_normalize, page_garbage, uppercase_lines, titlecase_lines, csv_safe, page_ranges, page_lists, garbage_signals, latin_words, shape_scores, sanitize_surface, flipped_names,
    prose_flipped_units, page_problems, cell_units, column_roles, gazetteer_runs, gazetteer_tokens, ambiguous_demotion, denylist_all_tokens, suppress_verdict, org_rules, minor_bindings,
    overlap_resolve, suppressor_overlap, resume_antijoin, relocate_spans, name_rollup, inverted_merge, duplicate_flags, ngram_counts, ngram_scores, ngram_thresholds, name_report, fixture_report, suppressed_rows,
    manifest_totals, file_stats, context_boosts, boilerplate_words, header_roles, variant_dedupe, garbage_verdicts,
]
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = oracle_sql(SPANS, PAGES, [n for n, _, _ in SUPPRESS], CELLS, PEOPLE, COMMON)
