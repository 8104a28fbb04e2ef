"""File-tree inventory through the repo_tree source."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.operators import scan
from treeline.sources.repo_tree import read_tree


@pytest.fixture(scope="module")
def tree(spark):
    base = tempfile.mkdtemp(prefix="treeline-tree-")

    def w(rel, data):
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    w("alpha/__init__.py", "a\nb\n")
    w("alpha/_x.py", "one")                      # no trailing newline
    w("alpha/.hidden.py", "h\n")
    w("alpha/node_modules/z.js", "z\n")
    w("alpha/node_modules/deep/q.js", "q\n")
    w("alpha/.git/config", "[core]\n")
    w("alpha/a.egg-info/PKG-INFO", "x\n")
    w("alpha/A.PY", "x\r\ny\r\n")                 # CRLF, upper-case suffix
    w("alpha/s.R", "r\rr\r")                      # lone CR
    w("alpha/noext", "plain\n")
    w("alpha/empty.py", "")
    w("alpha/bin.py", b"ab\x00cd\n")
    w("alpha/bad.py", b"ok\xff\xfe\n")
    w("alpha/src/lib/m.rs", "fn main(){}\n")
    w("alpha/big.txt", "x" * (1024 * 1024 + 10))
    w("deep_only/a/b/c.py", "print(1)\n")         # sources only at depth 3: not a project
    w("marker_only/Makefile", "all:\n")           # marker only: project
    w("node_modules/x.js", "x\n")                 # excluded folder name at the base
    files = read_tree(spark, base).cache()
    yield base, files
    files.unpersist()


def test_hidden_and_underscore_files_are_listed(tree):
    _, files = tree
    paths = {r.path for r in files.where(F.col("project") == "alpha").collect()}
    assert {"__init__.py", "_x.py", ".hidden.py"} <= paths
    # excluded folder at depth 1: its direct files only
    assert "node_modules/z.js" in paths and "node_modules/deep/q.js" not in paths


def test_project_test_and_discovery(tree):
    _, files = tree
    t = {r.project: r.is_project for r in scan.project_test(files).collect()}
    assert t["alpha"] and t["marker_only"] and not t["deep_only"]
    found = [r.project for r in scan.discover(files).orderBy("project").collect()]
    assert found == ["alpha", "marker_only"]


def test_inventory_prunes_and_skips_dotfiles(tree):
    _, files = tree
    inv = {r.path: r.language for r in scan.inventory(files).where(F.col("project") == "alpha").collect()}
    assert ".hidden.py" not in inv and "node_modules/z.js" not in inv and ".git/config" not in inv
    assert "a.egg-info/PKG-INFO" not in inv
    assert inv["A.PY"] == "python" and inv["s.R"] == "r" and inv["noext"] is None and inv["src/lib/m.rs"] == "rust"


def test_stats_line_rules(tree):
    _, files = tree
    st = scan.project_stats(files).where(F.col("project") == "alpha").collect()[0]
    # python: __init__ 2, _x 1, .hidden 1, A.PY 2, empty 0, bin 1, bad 1 ; r: 2 ; rust: 1
    assert st.lines_of_code == 2 + 1 + 1 + 2 + 0 + 1 + 1 + 2 + 1
    langs = scan.languages(files).where(F.col("project") == "alpha").collect()[0]
    assert langs.primary_language == "python" and langs.languages == ["python", "r", "rust"]
    # file_count includes dot-files but not pruned folders
    assert st.file_count == 11


def test_binary_files_not_split_into_lines(tree):
    _, files = tree
    paths = {r.path for r in scan.lines(files).collect()}
    assert "bin.py" not in paths and "bad.py" in paths


def test_dates_and_listing(tree):
    _, files = tree
    d = scan.project_dates(files).where(F.col("project") == "alpha").collect()[0]
    assert d.project_created_at is not None and d.last_code_modified_at is not None
    inv = scan.inventory(files)
    listing = scan.directory_listings(inv)
    root = [(r.name, r.is_directory) for r in scan.list_directory(listing, "alpha").collect()]
    assert root[0] == ("src", True)
    # union of file rows of all listings equals the inventory
    file_rows = {(r.project, r.path) for r in listing.where(~F.col("is_directory")).collect()}
    assert file_rows == {(r.project, r.path) for r in inv.collect()}


def test_suffix_and_line_count_expressions(spark):
    names = [".bashrc", "a.tar.gz", "x.", ".a.py", "A.PY", "noext"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(exprs.suffix(F.col("name"))).collect()] == ["", ".gz", "", ".py", ".py", ""]
    texts = ["", "a", "a\n", "a\r\nb", "a\rb\r", "\n\n", "a\n\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(exprs.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2, 2, 3]


def test_extension_map_size():
    assert len(fixed.LANGUAGE_EXTENSIONS) == 59
    assert len(fixed.PROJECT_MARKERS) == 17 and len(fixed.EXCLUDE_DIRS) == 15


def test_listing_siblings_and_case(spark):
    inv = spark.createDataFrame(
        [("p", "src/a.py", 1, None, "python"), ("p", "src2/b.py", 1, None, "python"), ("p", "Zeta.md", 1, None, None),
         ("p", "alpha.txt", 1, None, None), ("p", "src/deep/er/x.py", 1, None, "python")],
        "project string, path string, size_bytes long, modified_at timestamp_ntz, language string")
    listing = scan.directory_listings(inv)
    root = [(r.name, r.is_directory) for r in scan.list_directory(listing, "p").collect()]
    assert root == [("src", True), ("src2", True), ("alpha.txt", False), ("Zeta.md", False)]
    sub = [r.path for r in scan.list_directory(listing, "p", "src/").collect()]
    assert sub == ["src/deep", "src/a.py"]
    assert [r.path for r in scan.list_directory(listing, "p", "src/deep/er").collect()] == ["src/deep/er/x.py"]


def test_viewer_guard_on_tree(tree):
    from treeline.operators import grep

    _, files = tree
    v = {r.path: (r.viewable, r.reason) for r in grep.viewable(files).where(F.col("project") == "alpha").collect()}
    assert v["big.txt"] == (False, "File too large to display") and v["_x.py"] == (True, None)


def test_jobs_list_the_same_rows_as_the_reader(spark, tree):
    from treeline.sources.repo_tree import list_tree, read_contents

    base, files = tree
    columns = ["project", "path", "name", "size_bytes", "modified_at"]
    listed = list_tree(spark, base)
    want = sorted(tuple(r) for r in files.select(*columns).collect())
    assert sorted(tuple(r) for r in listed.select(*columns).collect()) == want
    read = read_contents(listed, base, bytes_per_task=200_000)
    assert read.rdd.getNumPartitions() == 6
    assert sorted(tuple(r) for r in read.select(*columns, "content").collect()) == sorted(tuple(r) for r in files.select(*columns, "content").collect())


def test_project_filters_reach_the_source(spark, tree):
    base, files = tree
    some = read_tree(spark, base, content=False).where(F.col("project").isin("alpha", "marker_only") & (F.col("size_bytes") > 0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert {r.project for r in some.collect()} == {"alpha", "marker_only"}
    assert some.rdd.getNumPartitions() == 2 and "project" not in plan.split("Filter")[1].split("BatchScan")[0].split("\n")[0]
    one = read_tree(spark, base, content=False).where("project = 'marker_only'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
