"""Deep search (X8) group semantics, BRE translation, line ranges."""

import pytest
from pyspark.sql import functions as F

from treeline.operators import grep


def _files(spark, rows):
    return spark.createDataFrame([(p, path, path.split("/")[-1], c) for p, path, c in rows],
                                 "project string, path string, name string, content string")


def test_bre_translation():
    assert grep.bre_to_java("a+b") == r"a\+b"
    assert grep.bre_to_java(r"a\+b") == "a+b"
    assert grep.bre_to_java("f(x)") == r"f\(x\)"
    assert grep.bre_to_java(r"\(ab\)*") == "(ab)*"
    assert grep.bre_to_java("*star") == r"\*star"
    assert grep.bre_to_java("[[:digit:]]+") == r"[\d]\+"


def _lines(n, hits):
    return "\n".join(("MATCH" if i in hits else f"l{i}") for i in range(1, n + 1)) + "\n"


def test_reference_groups(spark):
    # matches at 1, 2 (distance 1), 7 (distance 5 = 2C+1), 13 (distance 6), 20 (last line)
    f = _files(spark, [("p", "a.py", _lines(20, {1, 2, 7, 13, 20}))])
    r = {x.line_no: x for x in grep.search(f, "MATCH", 2, None, "reference").collect()}
    assert sorted(r) == [1, 2, 7, 13, 20]
    assert r[1].before == [] and r[1].after == []          # next match adjacent
    assert r[2].before == [] and r[2].after == ["l3", "l4"]
    assert r[7].before == [] and r[7].after == ["l8", "l9"]  # same group as 2
    assert r[13].before == ["l11", "l12"] and r[13].after == ["l14", "l15"]
    assert r[20].before == ["l18", "l19"] and r[20].after == []
    full = {x.line_no: x for x in grep.search(f, "MATCH", 2, None, "full").collect()}
    assert full[7].before == ["l5", "l6"] and full[1].after == ["MATCH", "l3"]


def test_limit_exact_and_language(spark):
    f = _files(spark, [("p", "b.py", _lines(10, {2, 3, 4})), ("p", "a.md", _lines(3, {1})),
                       ("p", "c.bin", _lines(3, {1})), ("p", "node_modules/x.js", _lines(3, {1}))])
    r = grep.search(f, "MATCH", 1, 2, "reference").orderBy("path", "line_no").collect()
    assert [(x.path, x.line_no, x.language) for x in r] == [("a.md", 1, "markdown"), ("b.py", 2, "python")]
    off = grep.search(f, "MATCH", 1, None, "reference", apply_exclude=False)
    assert off.where(F.col("path") == "node_modules/x.js").count() == 1


def test_regex_specials_are_literal(spark):
    f = _files(spark, [("p", "a.py", "x = a+b\nf(x)\nab\n")])
    assert [x.line for x in grep.search(f, "a+b", 0, None).collect()] == ["x = a+b"]
    assert [x.line for x in grep.search(f, "f(x", 0, None).collect()] == ["f(x)"]


def test_line_ranges(spark):
    f = _files(spark, [("p", "a.py", _lines(5, set()))]).withColumn("size_bytes", F.lit(1))
    req = spark.createDataFrame([(1, "p", "a.py", 2, 3), (2, "p", "a.py", 4, 99), (3, "p", "a.py", 3, 2)],
                                "request_id long, project string, path string, line_from int, line_to int")
    got = sorted((r.request_id, r.line_no) for r in grep.line_ranges(f, req).collect())
    assert got == [(1, 2), (1, 3), (2, 4), (2, 5)]
    assert grep.parse_line_spec("3-7") == (3, 7) and grep.parse_line_spec("x") is None


def test_lf_line_numbering(spark):
    f = _files(spark, [("p", "a.py", "one\r\ntwo MATCH\rtail\nthree MATCH\n")])
    uni = [(x.line_no, x.line) for x in grep.search(f, "MATCH", 0, None, newline="universal").collect()]
    lf = [(x.line_no, x.line) for x in grep.search(f, "MATCH", 0, None, newline="lf").collect()]
    assert sorted(uni) == [(2, "two MATCH"), (4, "three MATCH")]
    assert sorted(lf) == [(2, "two MATCH"), (3, "three MATCH")]


def test_context_line_with_colon_number(spark):
    f = _files(spark, [("p", "we-12-ird.py", "x:12:y\nMATCH\nz\n")])
    r = grep.search(f, "MATCH", 1, None).collect()
    assert [(x.line_no, x.before, x.after) for x in r] == [(2, ["x:12:y"], ["z"])]


def test_brackets_and_anchors(spark):
    f = _files(spark, [("p", "a.py", "a.x\nb\\x\na&c\nend$\nfa\n")])

    def hits(q):
        return [x.line for x in grep.search(f, q, 0, None).collect()]
    assert hits(r"[\.]x") == ["a.x", "b\\x"]
    assert hits("a[a&&b]c") == ["a&c"]
    assert hits(r"\(fa$\)") == ["fa"]
    assert hits("[[]") == [] and hits("d[$]") == ["end$"]


def test_limits_are_not_cut(spark):
    f = _files(spark, [("p", "a.py", "MATCH\n" * 1200)])
    assert grep.search(f, "MATCH", 7, 1000).count() == 1000
    import pytest

    for bad in ({"limit": 501}, {"context": 6}, {"limit": 0}):
        with pytest.raises(ValueError):
            grep.check_request(**bad)


def test_search_is_one_pass(spark):
    path = "/root/testdata/sf0.001"
    from treeline.plans.registry import REGISTRY, load_all

    load_all()
    for key in ("x8_deep_search", "w2_context"):
        plan = REGISTRY[key](spark, path)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Window" not in plan and "SortMergeJoin" not in plan
