import pytest

from nomina.llm import fingerprints


def test_few_shingles_before_many(spark, tmp_path):
    """A text of one shingle, a quarter of which is replaced by hundreds: the union's sketch may hold none of its own."""
    texts = [" ".join(f"{w}{i}" for i in range(1500)) if i % 2 else " ".join([f"word{i}"] * 4000) for i, w in enumerate("abcdefghijklmnop")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in fingerprints.op4_bottom_k_fingerprints(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        if i % 2 == 0:
            assert r.n_distinct == 1 and r.kept_by_edit == 1.0 and 0 <= r.near_edited <= 1
        else:  # three quarters of its 1496 shingles stay
            assert r.kept_by_edit == pytest.approx(0.75, abs=0.2)
