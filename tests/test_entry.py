import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from against_sql import of_spark, of_sql
from nomina import queries as Q

REPO = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_names_match_columns():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    assert of_spark(Q.QUERIES[name](spark, SF)) == of_sql(Q.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["gazetteer_runs", "duplicate_flags", "prose_flipped_units"])
def test_queries_find_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_lines_of_any_length(spark, tmp_path):
    text = "Ann Lee\n\nAl\n" + "Sarah Kowalski " * 10 + "\nKim, Bo " + "x" * 60
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: Q.QUERIES[n](spark, str(tmp_path)) for n in ("shape_scores", "sanitize_surface", "inverted_merge", "file_stats", "manifest_totals")}
    assert got["shape_scores"].count() == got["sanitize_surface"].count() == got["file_stats"].collect()[0].hits == 5
    assert got["inverted_merge"].count() == 4 and got["manifest_totals"].collect()[0]["names"] == 4


@pytest.mark.parametrize("name", ["sanitize_surface", "context_boosts", "garbage_verdicts", "garbage_signals", "variant_dedupe", "relocate_spans", "boilerplate_words", "norm_name", "gazetteer_runs", "flipped_names", "titlecase_lines", "shape_scores"])
def test_odd_lines_against_sql(spark, tmp_path, name):
    lines = ["Dear Mr. John Smith", "Good morning, Dr. Lee", "To whom it may concern Ann Lee", "Hello Hello Dear Ms. O'Neil-Roe", "Mr.", "Dear Hello", "†¶Ann| Lee†", "{}|", "", "   ", "Sincerely, Al Roe"]
    lines += ["Lee, Ann", "Lee Smith, Ann Jr.", "Student, Parent", "X Lee, the guardian  ad litem, came; then left", "ÉCOLE ÉTÉ ÑANDÚ", "his coachés ran", "a next\u00a0friend of Ann. Bo", "J0hn Smiiith bcdfghjk", "Ann Lee\tAnn  Lee Ann Lee"]
    texts = [(i, "\n".join(lines[i:] + lines[:i]), "s") for i in range(len(lines))] + [(50, None, "s"), (51, "", None), (52, "\n\n", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert of_spark(Q.QUERIES[name](spark, str(tmp_path))) == of_sql(Q.ORACLE_SQL[name], str(tmp_path))


def test_works_without_llm():
    code = "import sys; sys.modules['corpus_pipeline'] = None\ntry:\n    import corpus_pipeline\nexcept ModuleNotFoundError as e:\n    assert e.name == 'corpus_pipeline'\nimport __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=60)


def test_nothing_else_imports_llm():
    for p in (REPO / "nomina").rglob("*.py"):
        if "llm" not in p.parts:
            assert "nomina.llm" not in p.read_text()
