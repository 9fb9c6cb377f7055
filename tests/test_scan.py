import json

from pyspark.sql import functions as F

from nomina import cli
from nomina import queries as Q
from nomina.operators import report, spans, units
from nomina.plans import scan
from nomina.sources import files
from nomina.streaming.incremental import scan_stream

PAGES = [("a", 1, "with Zofia Kowalska"), ("a", 2, ""), ("a", 3, "and Sarah Kowalski came"), ("b", 1, "Student: Ann Lee")]
SCHEMA = "file string, page_num int, text string"


def surfaces(spark, path):
    return sorted((r.file, r.page_num, r.raw_name) for r in files.read_hits(spark, path).collect())


def test_scan_goes_on_where_it_stopped(spark, tmp_path):
    path, names = str(tmp_path / "hits"), Q._people(spark)
    some, all_ = spark.createDataFrame(PAGES[:2], SCHEMA), spark.createDataFrame(PAGES, SCHEMA)
    want = [("a", 1, "Zofia Kowalska"), ("a", 3, "Sarah Kowalski"), ("b", 1, "Ann Lee")]
    assert scan.scan(some, names, 2026, path, size=2) == {"hits": 1, "suppressed": 0}
    assert scan.scan(all_, names, 2026, path, size=2)["hits"] == 2 and surfaces(spark, path) == want
    assert scan.scan(all_, names, 2026, path, size=2)["hits"] == 0 and surfaces(spark, path) == want
    assert scan.scan(all_, names, 2026, path, size=100)["hits"] == 2 and surfaces(spark, path) == want  # other chunks; b's is done
    emptied = spark.createDataFrame([("b", 1, "nobody")], SCHEMA)
    files.write_scan(scan.hits(emptied, names, 2026), emptied, units.page_problems(emptied), path)
    assert surfaces(spark, path) == want[:2]
    got = {r.file: r for r in report.scanned_files(files.read_hits(spark, path), files.read_pages(spark, path)).collect()}
    assert (got["a"].status, got["a"].page_count, got["a"].hits, got["a"].problems, got["b"].hits) == ("complete", 3, 2, "empty_text_layer:1", 0)
    assert scan.scan(emptied, names, 2026, path, force=True)["hits"] == 0 and surfaces(spark, path) == []
    assert [r.file for r in files.read_pages(spark, path).collect()] == ["b"]


def test_hits_without_later_columns(spark, tmp_path):
    path, pages = str(tmp_path / "hits"), spark.createDataFrame(PAGES[:1], SCHEMA)
    old = spark.createDataFrame([(1, "a", 1, "Zofia Kowalska", 0.65, 0.65)], "seq long, file string, page_num int, raw_name string, score double, boosted double")
    files.write_scan(old, pages, units.page_problems(pages), path)
    assert report.report_rows(files.read_hits(spark, path)).collect()[0].suppressed == ""


def test_names_folded_into_their_plain_form(spark):
    rows = [("John Smith", 0, "", ""), ("Smith, John", 1, "organization|x", "Smith, John ="), ("smith, john", 0, "", ""), ("John Smyth", 1, "organization|y", "=John Smyth")]
    hits = spark.createDataFrame([(i, "a", i, n, 0.65, 0, "", "", "gazetteer", "", h, why, s) for i, (n, h, why, s) in enumerate(rows)], "seq long, file string, page_num int, raw_name string, boosted double, minor_ctx int, minor_tier string, minor_reason string, recognizer string, minor_binding string, suppressed int, suppress_reason string, raw_surface string")
    got = {r["name"]: r for r in report.report_rows(hits).collect()}
    john, smyth = got["John Smith"], got["John Smyth"]
    assert len(got) == 2 and (john.occurrence_count, john.suppressed, john.rescued_from) == (3, "", "organization|x")
    assert john.also_reported_as == "Smith, John, Smith, John =" and john.possible_duplicate_of == "John Smyth"
    assert (smyth.suppressed, smyth.suppress_reason, smyth.also_reported_as) == ("yes", "organization|y", "'=John Smyth")


def test_readers_that_fail(spark):
    pages = spark.createDataFrame([("a", 1, None, "ValueError"), ("a", 2, "Ann Lee\nSARAH KOWALSKI\nOsei, Amara", None), ("a", 3, "Ann Lee Osei, Amara", None)], "file string, page_num int, text string, error string")
    cells = spark.createDataFrame([("a", 2, 1, 0, 0, "Bo Kim", "KeyError"), ("a", 3, 1, 0, 0, "Osei, Amara", None)], "file string, page_num int, table_id int, r int, c int, cell string, error string")
    pages = pages.withColumn("prose", F.when(F.col("page_num") > 1, "Ann Lee"))
    got = sorted((r.page_num, r.kind, r.analysis_text) for r in units.page_units(pages, cells).collect())
    assert [g for g in got if g[0] == 2] == [(2, "prose", "Ann Lee\nSARAH KOWALSKI\nOsei, Amara"), (2, "truecase", "Sarah Kowalski")]
    assert {g[1:] for g in got if g[0] == 3} >= {("prose", "Ann Lee"), ("cell", "Osei, Amara")}
    assert sorted((r.page_num, r.reason) for r in units.page_problems(pages, cells).collect()) == [(1, "extract_error: ValueError"), (2, "table_fallback: KeyError")]


def test_registered_sources(spark, monkeypatch):
    """A recogniser's entities that weren't asked for speak against a name; those that were are names."""

    def source(u):
        row = lambda word, entity: u.filter(F.col("text").contains(word)).select("unit_id", (F.instr("text", word) - 1).alias("start"), (F.instr("text", word) - 1 + len(word)).alias("end"), F.lit(entity).alias("entity"), F.lit(0.85).alias("score"), F.lit("spacy").alias("recognizer"))
        return row("Oakdale Clinic", "PERSON").unionByName(row("Oakdale Clinic", "ORG")).unionByName(row("Springfield", "LOCATION"))

    monkeypatch.setitem(spans.SOURCES, "stub", source)
    pages = spark.createDataFrame([("a", 1, "in Springfield at Oakdale Clinic")], SCHEMA)
    got = scan.hits(pages, None, 2026).collect()
    assert [(r.raw_name, r.suppressed, r.score) for r in got] == [("Oakdale Clinic", 1, 0.85)] and got[0].suppress_reason.startswith("organization")
    assert sorted(r.raw_name for r in scan.hits(pages, None, 2026, entities=("PERSON", "LOCATION")).collect()) == ["Oakdale Clinic", "Springfield"]
    low = scan.hits(spark.createDataFrame(PAGES[:1], SCHEMA), Q._people(spark), 2026, score=0.5).collect()
    assert [r.score for r in low] == [0.5]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.csv", "name,rank\nSmith,1\nLee,2\n"), ("b.TXT", "Kim\nx\n"), ("c.md", "Nobody\n")):
        (tmp_path / "d" / name).write_text(text)
    load = lambda: sorted(r.token for r in files.load_dictionary(spark, str(tmp_path / "d"), cache=str(tmp_path / "c")).collect())
    assert load() == load() == ["kim", "lee", "smith"] and len(list((tmp_path / "c").iterdir())) == 1
    (tmp_path / "d" / "a.csv").write_text("Osei\n")
    assert load() == ["kim", "osei"] and files.load_dictionary(spark, str(tmp_path / "none")) is None


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Student: Ann Lee\n\fThe Sarah Kowalski Foundation\f")
    (tmp_path / "names.txt").write_text("ann\nlee\nsarah\nkowalski\n")
    out, cache = str(tmp_path / "names"), str(tmp_path / "cache")
    own = spark.sparkContext
    assert cli.main(["all", str(tmp_path / "in"), "--gazetteer", str(tmp_path / "names.txt"), "--as-of", "2026", "--cache", cache, "--out", out, "--chunk-size", "2"]) == 0
    assert own is not None and spark.read.csv(out, header=True).filter("name = 'Ann Lee' AND minor_binding = 'label'").count() == 1
    told = json.loads(spark.read.text(f"{out}.manifest").collect()[0].value)
    held = spark.read.csv(f"{out}.suppressed", header=True).count()
    assert told["totals"]["pages_in_corpus"] == 3 and told["totals"]["unique_names"] + told["suppression"]["names_withheld"] == 2
    assert told["suppression"]["names_withheld"] == sum(told["suppression"]["by_reason"].values()) == held
    assert spark.read.json(f"{out}.files").collect()[0].chunks_completed == 2
    assert cli.main(["clear", "--cache", cache, "--yes"]) == 0 and not (tmp_path / "cache").exists()


def test_scan_of_a_stream(spark, tmp_path):
    where, path = tmp_path / "in", str(tmp_path / "hits")

    def go(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(where))
        pages = spark.readStream.schema(SCHEMA).parquet(str(where))
        scan_stream(pages, Q._people(spark), 2026, path, str(tmp_path / "state")).awaitTermination()

    go(PAGES, "first")
    assert len(surfaces(spark, path)) == 3
    go([("a", 1, "nobody here")], "second")  # the file a is now one page without names
    assert surfaces(spark, path) == [("b", 1, "Ann Lee")]
