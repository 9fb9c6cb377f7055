import random

import pytest
from pyspark.sql import functions as F

from nomina import queries as Q
from nomina.functions import text as T
from nomina.functions.similarity import eponym_of, indel_ratio
from nomina.operators import minors, names, scoring, spans, suppression
from nomina.plans import scan

VERDICTS = ["organization", "", "organization", "organization", "", "", "medical_term", "", "medical_term", "", "medical_term", "", "salutation_only", "", "ocr_garbage", "ocr_garbage", ""]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_verdicts(spark):
    rows = [(i, n, a + n + b, len(a), len(a) + len(n), []) for i, (n, a, b) in enumerate(Q.SUPPRESS)]
    df = spark.createDataFrame(rows, "i int, name string, ctx string, start int, end int, overlaps array<string>")
    assert [r.suppress_reason for r in suppression.verdict(df).orderBy("i").collect()] == VERDICTS


def test_surfaces(spark):
    raw = ["Sarah Kowalski†¶", "Hello Sarah", "Dr. Sarah Kowalski", "Ejike C. Okonkwo", "Smith, John", "Best", "", None]
    assert column(spark, raw, T.sanitize) == ["Sarah Kowalski", "Sarah", "Sarah Kowalski", "Ejike C Okonkwo", "Smith John", "Best", "", ""]
    cells = ["Osei, Amara", "Last, First", "Pettigrew, Jr.", "Council, Stevens", "Room 214, Bed 12", "however, we agree"]
    assert column(spark, cells, T.flipped_name) == ["Amara Osei", None, None, None, None, "we agree however"]
    assert column(spark, ["O'FAOLÁIN OKONKWO-ADEYEMI"], T.titlecase) == ["O'Faoláin Okonkwo-Adeyemi"]


def test_page_lists(spark):
    df = spark.createDataFrame([([9, 3, 4, 5, 3],), ([7],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(T.compress_pages(F.col("p"))).collect()] == ["p3-p5,p9", "p7", ""]


def test_minors(spark):
    cases = [("Student: ", "Ann Lee", "", "", "label"), ("Case manager: ", "Bo Kim", "", "", ""), ("a classmate, ", "Di Poe", "", "", "relation"), ("", "Ed Fox", ", age 15", "", "label"), ("", "Fay Orr", " 63 years old", "", ""), ("", "X", "", "minor", "column"), ("", "X", "", "adult", "")]
    rows = [(i, a + n + b, len(a), len(a) + len(n), [(len(a), len(a) + len(n))], r) for i, (a, n, b, r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, ctx string, start int, end int, spans array<struct<s:int,e:int>>, role string")
    c = [F.col(x) for x in ("ctx", "spans", "start", "end")]
    df = df.withColumn("reasons", minors.reasons(c[0], c[2], c[3], 2026))
    got = df.select("i", minors.binding(*c, F.col("reasons"), F.col("role"), 2026).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [x[4] for x in cases]


def test_similarity():
    assert indel_ratio("john smith", "john smith") == 100 and indel_ratio("ab", "ba") == 50
    assert eponym_of("klinfelter") == "kleinfelter" and eponym_of("dawn") is None


def test_overlaps_and_runs(spark):
    got = {(r.unit_id, r.start, r.end, r.recognizer) for r in Q.overlap_resolve(spark, "").filter("entity = 'PERSON'").collect()}
    assert (1, 0, 12, "both") in got and (2, 0, 5, "spacy") in got and (2, 6, 12, "gazetteer") in got
    runs = Q.ambiguous_demotion(spark, "").join(Q._pages(spark).selectExpr("concat_ws(':', file, page_num) unit_id", "text"), "unit_id")
    found = {r.s for r in runs.selectExpr("substring(text, start + 1, end - start) s").collect()}
    assert "Georgia Bell" in found and "Autumn Winters" in found and "White House" not in found and "Summer Church." not in found


def test_implausible_tokens_reach_scores_and_verdicts(spark):
    pages = spark.createDataFrame([("a", 1, "Georgia Kowalska Zqixjo came"), ("a", 2, "Sarah Kowalski Qzxwv came"), ("a", 3, "with Zofia Kowalska")], "file string, page_num int, text string")
    got = {r.page_num: r for r in scan.hits(pages, Q._people(spark), 2026).collect()}
    assert round(got[1].boosted, 6) == 0.5 and got[1].suppressed == 0
    assert got[2].suppress_reason == "ocr_garbage|implausible_ngrams,vowelless_token"
    assert round(got[3].boosted, 6) == 0.65 and got[3].suppressed == 0


def test_condemned_names(spark, monkeypatch):
    names = spark.createDataFrame([("georgia",), ("kowalska",), ("lopez",)], "token string")
    rows = spark.createDataFrame([(1, "Zqixjo Wxiqzu"), (2, "Zqixjo Georgia"), (3, "Zqixjo Lopez-Wxiqzu"), (4, "Georgia Kowalska"), (5, "Bo")], "i int, name string")
    told = lambda: {r.i: (r.implausible, r.condemned) for r in scoring.implausible_names(rows, ["i"], "name", names).collect()}
    assert told() == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, False)}
    monkeypatch.setattr(scoring, "LEAST_NAMES", 3)
    assert told() == {1: (True, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, False)}


def test_prose_is_judged_where_it_stands(spark):
    text = "Student: Ann Lee\nlong after that somebody found a coat whose badge read Ann Lee"
    pages = spark.createDataFrame([("a", 1, text), ("a", 2, "seen: SARAH KOWALSKI\nStudent: JOHN SMITH\n"), ("a", 3, "Ann ††† LEE\n" + "x " * 600 + "Student: Bo Kim and Ann Lee")], "file string, page_num int, text string")
    got = scan.hits(pages, Q._people(spark), 2026).collect()
    assert sorted(r.minor_binding for r in got if r.page_num == 1) == ["", "label"]
    assert {r.raw_name: r.minor_binding for r in got if r.page_num == 2}["John Smith" if any(r.raw_name == "John Smith" for r in got) else "JOHN SMITH"] == "label"
    assert {r.raw_name: r.minor_binding for r in got if r.page_num == 3}["Bo Kim"] == "label" and {r.raw_name: r.minor_binding for r in got if r.page_num == 3}["Ann Lee"] == "label"


def test_runs_of_capitalised_tokens(spark):
    text = "iPhone Ann Lee's x-Ray Bo\tKim, Mr. O'Hara\nSt. John Smith. Jane Doe 9Al Roe _Cy Poe ÉLAN Ünal"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no capitals")], "unit_id int, text string")
    runs: dict = {}
    for r in spans.capitalised_runs(df).orderBy("unit_id", "run", "start").collect():
        assert text[r.start : r.start + len(r.token)] == r.token
        runs.setdefault(r.run, []).append(r.token)
    assert list(runs.values()) == [["Ann", "Lee's"], ["Bo", "Kim"], ["Mr.", "O'Hara"], ["St.", "John", "Smith."], ["Jane", "Doe"], ["Al", "Roe"], ["Cy", "Poe", "ÉLAN", "Ünal"]]


@pytest.mark.parametrize("threshold", [70.0, 75.0, 88.0, 97.0])
def test_duplicate_pairs_against_brute_force(spark, threshold):
    draw = random.Random(3)
    keys = {"".join(draw.choice("abc ") for _ in range(draw.randint(1, 7))).strip() for _ in range(150)}
    for base in ("sarah kowalski", "john smith", "amara osei", "customer#000000012"):
        for _ in range(25):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(["", "x", "00", " "])
            keys.add(" ".join("".join(own).split()))
    keys = sorted({" ".join(k.split()) for k in keys} - {""})
    form = {k: " ".join(sorted(k.split())) for k in keys}
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if indel_ratio(form[a], form[b]) >= threshold}
    got = names.duplicate_pairs(spark.createDataFrame([(k,) for k in keys], "name_key string"), threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_duplicate_classes_against_brute_force(spark):
    draw = random.Random(5)
    keys = {f"supplier#{i:09d}" for i in range(150)} | {f"customer {draw.randint(0, 99999):05d} {c}" for c in "abcdefgh"}
    keys |= {"".join(draw.choice("abc ") for _ in range(draw.randint(1, 8))) for _ in range(80)} | {"john smith", "smith john", "jon smith", "amara osei", "é" * 70, "é" * 66 + "xy", "b" * 64, "b" * 60, " ", ""}
    keys = sorted({" ".join(k.split()) for k in keys} - {""})
    form = {k: " ".join(sorted(k.split())) for k in keys}
    for threshold, block in ((88.0, 40), (70.0, 1000), (97.0, 16)):
        near = {a: {b for b in keys if b != a and indel_ratio(form[a], form[b]) >= threshold} for a in keys}
        want = {}
        for k in keys:  # ascending: the first to reach a key is its least
            todo = [k]
            while todo:
                if (x := todo.pop()) not in want:
                    want[x] = (k, len(near[x]))
                    todo += near[x]
        rows = spark.createDataFrame([(k,) for k in [*keys, *keys[:40], ""]], "name_key string")
        got = names.duplicate_classes(rows, threshold, block).collect()
        assert len(got) == len(keys) and {r.name_key: (r.class_id, r.n_links) for r in got} == want


def test_duplicate_pairs_of_repeated_words_stay_off_the_driver(spark):
    """Such names are small in a file and large in memory: 1.4 MB were 916 MB, and were sent to the driver."""
    keys = [" ".join([w] * n) for w in ("the", "and", "los") for n in range(2, 60)]
    got = names.duplicate_pairs(spark.createDataFrame([(k,) for k in keys], "name_key string"))
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    keys.sort()
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if indel_ratio(a, b) >= 88}
    assert {(r.a, r.b) for r in got.collect()} == want and want
