"""Commit-log and remote ingestion."""

import datetime as dt

from pyspark.sql import functions as F

from treeline.functions import exprs
from treeline.sources import logs

US = "\u001f"


def test_commit_line_with_colon_subject(spark):
    line = US.join(["abc123", "abc1", "Alice", "2024-01-02T03:04:05+00:00", "fix: tidy up"])
    df = spark.createDataFrame([("demo", line)], "project string, value string")
    r = logs.parse_commit_lines(df).collect()
    assert len(r) == 1
    c = r[0]
    assert (c.sha, c.short_sha, c.author, c.message) == ("abc123", "abc1", "Alice", "fix: tidy up")
    assert c.committed_at == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_commit_lines_skipped_and_nulls(spark):
    rows = [
        ("p", ""),                                                      # blank
        ("p", "   "),                                                   # blank
        ("p", US.join(["a", "b", "c", "d"])),                           # 4 fields
        ("p", US.join(["a", "b", "c", "d", "e", "f"])),                 # 6 fields
        ("p", US.join(["s1", "s", "", "2024-01-02T03:04:05Z", "m"])),   # empty author
        ("p", US.join(["s2", "s", "Bob", "yesterday", "m"])),           # bad date
        ("p", US.join(["s3", "s", "Bob", "2024-01-02T03:04:05+02:00", "m"])),
        ("p", US.join(["s4", "s", "Bob", "2024-01-02T03:04:05-05:30", "m"])),
    ]
    df = spark.createDataFrame(rows, "project string, value string")
    got = {r.sha: r for r in logs.parse_commit_lines(df).collect()}
    assert set(got) == {"s1", "s2", "s3", "s4"}
    assert got["s1"].author is None and got["s1"].committed_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["s2"].committed_at is None
    assert got["s3"].committed_at == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert got["s4"].committed_at == dt.datetime(2024, 1, 2, 8, 34, 5)


def test_github_names(spark):
    cases = [
        ("git@github.com:user/demo.git", "user/demo"),
        ("https://github.com/user/demo.git", "user/demo"),
        ("https://github.com/user/demo", "user/demo"),
        ("git@github.com:user/demo", "user/demo"),
        ("git@github.com:u/my.github.io.git", "u/my.github.io"),
        ("https://gitlab.com/user/demo.git", None),
        (None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "remote_url string")
    out = [r[0] for r in df.select(exprs.github_name(F.col("remote_url"))).collect()]
    assert out == [c[1] for c in cases]


def test_repo_identity_one_commit_repo(spark):
    df = spark.createDataFrame([("demo", "git@github.com:user/demo.git", "main")],
                               "project string, remote_url string, branch string")
    r = logs.repo_identity(df).collect()[0]
    assert r.github_name == "user/demo" and r.is_repo and r.default_branch == "main"
    line = US.join(["f" * 40, "fffffff", "Tester", "2024-05-06T07:08:09+00:00", "initial commit"])
    c = logs.parse_commit_lines(spark.createDataFrame([("demo", line)], "project string, value string")).collect()
    assert [(x.author, x.message) for x in c] == [("Tester", "initial commit")]
