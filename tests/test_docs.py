"""Documentation ingestion."""

from pyspark.sql import functions as F

from treeline.functions import exprs
from treeline.operators import docs
from treeline.sources import manifests


def test_metadata_replies(spark):
    rows = [
        ("p1", '{"name": "X", "keywords": [" API ", "Web"], "short_description": "d"}'),
        ("p2", 'Sure! Here it is: {"keywords": ["a"]} hope it helps'),
        ("p3", '{"result": {"name": "R", "primary_language": "go"}}'),
        ("p4", '{"short_description": "only"}'),
        ("p5", "no json at all"),
        ("p6", '{"broken": '),
    ]
    df = spark.createDataFrame(rows, "project string, text string")
    m = {r.project: r for r in docs.parse_metadata(df, F.array(F.lit("python"), F.lit("go"))).collect()}
    assert m["p1"].name == "X" and m["p1"].keywords == ["api", "web"] and m["p1"].primary_language == "python"
    assert m["p2"].status == "ok" and m["p2"].name == "p2" and m["p2"].keywords == ["a"]
    assert m["p3"].name == "R" and m["p3"].primary_language == "go" and m["p3"].languages == ["python", "go"]
    assert m["p4"].keywords == [] and m["p4"].short_description == "only"
    assert m["p5"].status == "error" and m["p5"].error_text == "no json at all"
    assert m["p6"].status == "error"


def test_clean_replies(spark):
    cases = [
        ("plain text", "plain text"),
        ("```markdown\n# T\n```", "# T"),
        ("```md\n# T\n```", "# T"),
        ("```\n# T\n```", "# T"),
        ('{"result": "# R"}', "# R"),
        ('{"content": "# C"}', "# C"),
        ('{"readme": "# D"}', "# D"),
        ('{"usage": "# U"}', "# U"),
        ("```markdown\n# open fence", "# open fence"),
        ("", ""),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = [r[0] for r in df.select(docs.clean_markdown(F.col("t"))).collect()]
    assert got == [w for _, w in cases]


def test_readme_pick_and_gaps(spark):
    files = spark.createDataFrame([
        ("a", "README", "README", 200, "x" * 200), ("a", "README.md", "README.md", 10, "short"),
        ("b", "readme.md", "readme.md", 100, "y" * 100), ("b", "METADATA.json", "METADATA.json", 60, "{}"),
        ("c", "src/README.md", "README.md", 100, "z" * 100),
    ], "project string, path string, name string, size_bytes long, content string")
    pick = {r.project: r.readme_name for r in docs.pick_readme(files).collect()}
    assert pick == {"a": "README.md", "b": "readme.md"}
    projs = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    g = {r.project: r for r in docs.doc_gaps(projs, docs.pick_readme(files), docs.doc_state(files)).collect()}
    assert g["a"].needs_readme and not g["b"].needs_readme and g["c"].needs_readme
    assert g["a"].needs_metadata and not g["b"].needs_metadata and g["b"].has_metadata
    miss = {(r.project, r.kind) for r in docs.missing_docs(projs, docs.doc_state(files), ["metadata", "readme"]).collect()}
    assert miss == {("a", "metadata"), ("b", "readme"), ("c", "metadata"), ("c", "readme")}


def test_module_and_keyword_dedup(spark):
    meta = spark.createDataFrame([
        ("p", '[{"name": "a", "path": "x"}, {"name": "b", "path": "x"}, {"name": "c"}, {"path": "y"}, {"name": "d", "path": "z"}]'),
    ], "project string, modules_json string")
    mods = sorted((r.path, r.name) for r in docs.dedup_modules(meta).collect())
    assert mods == [("x", "a"), ("z", "d")]
    kw = spark.createDataFrame([([" API ", "api", "", "Web", " "],)], "k array<string>")
    assert kw.select(exprs.normalize_keywords(F.col("k"))).collect()[0][0] == ["api", "web"]


def test_manifests(spark):
    rows = [
        ("n", "package.json", '{"name": "n", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'),
        ("bad", "package.json", '{"name": '),
        ("py", "pyproject.toml", '[project]\nname = "py"\ndependencies = ["requests>=2", "rich"]\n[tool.poetry]\nname = "old"\n'),
        ("po", "pyproject.toml", '[tool.poetry]\nname = "po"\n[tool.poetry.dependencies]\npython = "^3.11"\n'),
        ("sp", "setup.py", "from setuptools import setup\n"),
        ("rs", "Cargo.toml", '[package]\nname = "rs"\nversion = "0.1.0"\n'),
        ("go", "go.mod", "// c\nmodule example.com/m\n\ngo 1.22\n"),
        ("rb", "Gemfile", "source 'x'\n"),
        ("php", "composer.json", '{"name": "v/p", "description": "d"}'),
    ]
    m = spark.createDataFrame(rows, "project string, name string, content string")
    deps = {(r.project, r.name, r.dep_type) for r in manifests.dependencies(m).collect()}
    assert deps == {("n", "a", "dependencies"), ("n", "b", "devDependencies"), ("py", "requests>=2", "dependencies"),
                    ("py", "rich", "dependencies"), ("po", "python", "dependencies")}
    info = {(r.project, r.ecosystem): r.name for r in manifests.package_info(m).collect()}
    assert info[("py", "python")] == "py" and info[("rs", "cargo")] == "rs" and info[("go", "go")] == "example.com/m"
    assert info[("sp", "python")] == "sp" and ("rb", "ruby") in info and info[("php", "composer")] == "v/p"
    assert not any(p == "bad" for p, _ in info)


def test_doc_sink_and_report_expressions(spark):
    import os
    import uuid

    from treeline.session import ensure_checkpoint_dir

    root = os.path.join(ensure_checkpoint_dir(spark), f"docs-{uuid.uuid4().hex[:8]}")
    d = spark.createDataFrame([("p", "readme", "# p"), ("p", "usage", "use")], "project string, kind string, text string")
    docs.write_docs(d, root)
    assert sorted(r.kind for r in spark.read.parquet(root).collect()) == ["readme", "usage"]
    docs.write_docs(spark.createDataFrame([("q", "readme", "# q"), ("r", "readme", "# r")], d.schema), root)
    docs.write_docs(spark.createDataFrame([("q", "readme", "# new")], d.schema), root)
    assert sorted((r.project, r.kind, r.text) for r in spark.read.parquet(root).collect()) == [
        ("p", "readme", "# p"), ("p", "usage", "use"), ("q", "readme", "# new"), ("r", "readme", "# r")]
    df = spark.createDataFrame([(512, 0, 3, 4), (2048, 90, 1, 0), (5 * 1024 ** 3, 7200, 0, 0)],
                               "b long, age long, x long, n long")
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    ts = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("age"))
    got = df.select(exprs.size_text(F.col("b")), exprs.relative_age(ts, as_of), exprs.percent(F.col("x"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("512 B", "just now", 75.0), ("2.0 KB", "1 minute ago", 100.0),
                                      ("5.0 GB", "2 hours ago", 0.0)]
    ages = spark.createDataFrame([(45,), (1,), (None,), (8 * 86400,), (40 * 86400,), (800 * 86400,)], "age long")
    ts = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("age"))
    assert [r[0] for r in ages.select(exprs.relative_age(ts, as_of)).collect()] == [
        "45 seconds ago", "1 second ago", "", "1 week ago", "1 month ago", "2 years ago"]
    assert spark.range(1).select(exprs.size_text(F.lit(1020 * 1024))).first()[0] == "1020.0 KB"


def test_reply_envelope(spark):
    cases = [('{"result": "r", "content": "c"}', "r"), ('{"content": "c"}', "c"), ('{"response": "x"}', "x"),
             ('{"other": 1}', '{"other": 1}'), ("plain", "plain")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    assert [r[0] for r in df.select(docs.unwrap_reply(F.col("t"))).collect()] == [w for _, w in cases]


def test_generator_worklist(spark):
    def factory():
        def gen(project, kind, ctx):
            if project == "bad":
                raise RuntimeError("model down")
            return f"```markdown\n# {project} {kind}: {ctx}\n```"
        return gen

    wl = spark.createDataFrame([("p", "readme", "ctx"), ("bad", "usage", "c")], "project string, kind string, context string")
    got = {(r.project, r.kind): (r.text, r.error) for r in docs.generate_with(wl, factory).collect()}
    assert got[("p", "readme")] == ("# p readme: ctx", None)
    assert got[("bad", "usage")][0] is None and "model down" in got[("bad", "usage")][1]


def test_breadcrumbs(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("",), ("x",)], "p string")
    got = [r[0] for r in df.select(exprs.breadcrumbs(F.col("p"))).collect()]
    assert got == [["a", "a/b", "a/b/c.py"], [], ["x"]]
    df2 = spark.createDataFrame([("/base/proj/a.py",), ("/other/b.py",)], "p string")
    assert [r[0] for r in df2.select(exprs.relative_to(F.col("p"), "/base/proj")).collect()] == ["a.py", "/other/b.py"]


def test_export_docs(spark):
    import os
    import tempfile

    base = tempfile.mkdtemp(prefix="docs-export-")
    d = spark.createDataFrame([("p", "readme", "# p"), ("p", "metadata", "{}"), ("q", "usage", "u")],
                              "project string, kind string, text string")
    docs.export_docs(d, base)
    assert sorted(os.listdir(os.path.join(base, "p"))) == ["METADATA.json", "README.md"]
    assert open(os.path.join(base, "q", "USAGE.md")).read() == "u"
