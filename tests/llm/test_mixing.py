import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.llm import mixing

DOCS = "doc_id long, text string, source string"


def texts(rng, n, most=60):
    return [" ".join(["w"] * int(k)) for k in np.minimum(rng.lognormal(2.5, 1.0, n).astype(int), most)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t, ["a", "b", "c", "d", None][min(int(k), 4)]) for i, (t, k) in enumerate(zip(texts(rng, 600), rng.geometric(0.5, 600) - 1, strict=True))]
    rows += [(700, "w " * 30, "a")] * 9 + [(701, None, "b"), (702, "", "b"), (None, "w w w", "c"), (None, "w w w", "c"), (703, None, "empty")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_against_sql(docs):
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").toPandas()
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(f"SELECT doc_id, source, size, source_size, target, copies FROM ({mixing.sql()})").df()
    key = lambda d: sorted((str(r.doc_id).split(".")[0].replace("<NA>", "nan"), str(r.source), int(r["size"]), int(r.source_size), round(float(r.target), 6), int(r.copies)) for _, r in d.iterrows())
    assert key(got) == key(want)


def test_sources_come_near_their_targets(docs):
    got = mixing.mix(docs).toPandas().fillna({"source": "null"})
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "size"))
    assert ((per.taken - per.target).abs() <= np.where(per.n > 50, 3, 30)).all()


def test_inclusion_frequencies_match_the_chances(spark):
    """Over seeds, each document's extra copy comes as often as its chance says; the certain come always."""
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.lognormal(3, 0.7, 150).astype(int) + 1, 90)
    rows = [(i, " ".join(["w"] * int(n)), "a" if i % 2 else "b") for i, n in enumerate(sizes)] + [(1000, "w " * 700, "a")]
    df = spark.createDataFrame(rows, DOCS).coalesce(2).cache()
    per = mixing.targets(df.select("doc_id", "source", F.regexp_count("text", F.lit("w")).cast("long").alias("size"))).toPandas().set_index("source")
    want = {}
    for s, r in per.iterrows():
        mine = {i: len(t.split()) for i, t, x in rows if x == s}
        rest, certain = r.target - np.floor(r.target / r.source_size) * r.source_size, set()
        while True:
            left = {i: n for i, n in mine.items() if i not in certain}
            c = (rest - sum(mine[i] for i in certain)) / sum(n * n for n in left.values())
            over = {i for i, n in left.items() if c * n > 1}
            if not over:
                break
            certain |= {max(over, key=lambda i: (mine[i], i))}
        want |= {i: 1.0 if i in certain else c * n for i, n in mine.items()}
    runs = 8
    took = dict.fromkeys(want, 0)
    for seed in range(runs):
        for r in mixing.mix(df, seed=f"{seed}:").selectExpr("doc_id", "copies - floor(target / source_size) AS more").collect():
            took[r.doc_id] += int(r.more)
    p, f = np.array([want[i] for i in want]), np.array([took[i] / runs for i in want])
    assert (f[p >= 1] == 1).all() and abs(f.mean() - p.mean()) < 0.03
    for lo, hi in ((0, 0.2), (0.2, 0.4), (0.4, 0.7), (0.7, 1.0)):
        at = (p > lo) & (p < hi)
        if at.sum() >= 5:
            assert abs(f[at].mean() - p[at].mean()) < 0.08
