"""Driver contract: every key registered, oracle SQL where SQL can express it."""

import re

import __spark_entry__ as entry

ROWS_ONLY = {"x5_lsh_recall", "x2_stemmed"}


def test_every_key_has_oracle_or_is_rows_only():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 80
    assert set(sql) <= set(qs)
    own = {k for k in qs if not re.match(r"op[0-9]+_|pipeline$", k)}  # those have tests of their own
    assert own - set(sql) <= ROWS_ONLY


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "fts_score", "sem_score", "score"]
    assert df.count() > 0


def test_sample_keys_against_duckdb(spark):
    import duckdb

    from treeline.io import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for k in ["a1_project_stats", "j5_renames", "s8_commit_parse", "x8_deep_search", "w4_on_change"]:
        df = qs[k](spark, "/root/testdata/sf0.001")
        a = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
        cur = con.execute(sql[k])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
        assert sorted(df.columns) == sorted(cols), k
        assert len(a) == len(b), k


def test_cleanup_scratch(spark):
    from treeline.session import cleanup_scratch, materialize

    df = materialize(spark.range(3))
    assert df.count() == 3
    assert cleanup_scratch(spark, older_than_seconds=1e9) == []       # nothing that old
    gone = cleanup_scratch(spark, older_than_seconds=-60)             # everything this library made
    assert any("/stage-" in g for g in gone)


def test_discard(spark):
    import pytest

    from treeline.session import discard, materialize, path_exists

    a, b = materialize(spark.range(3)), materialize(spark.range(4))
    discard(a)
    assert not path_exists(spark, a.stage_path) and b.count() == 4
    with pytest.raises(ValueError):
        discard(spark.range(1))
