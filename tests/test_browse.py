"""Catalog reads."""

import datetime as dt

from pyspark.sql import functions as F

from treeline.operators import browse

T = dt.datetime


def _projects(spark):
    rows = [(i, f"p{i:02d}", "go" if i % 2 else None, i * 10 if i != 3 else None, i,
             T(2024, 1, i + 1) if i != 4 else None, T(2023, 1, 1), T(2024, 6, 1, 0, i),
             "Desc " + ("Alpha" if i == 5 else "x"), i % 3 == 0, "readme" if i == 1 else None, None, None)
            for i in range(1, 8)]
    return spark.createDataFrame(rows, "id long, name string, primary_language string, lines_of_code long, "
                                       "file_count long, last_code_modified_at timestamp_ntz, project_created_at timestamp_ntz, "
                                       "scanned_at timestamp_ntz, short_description string, is_git_repo boolean, "
                                       "readme_content string, metadata_json string, github_name string")


def _bridge(spark):
    return spark.createDataFrame([(1, "api"), (1, "web"), (2, "api"), (3, "cli"), (5, "api")],
                                 "project_id long, keyword string")


def test_browse_paging_sort_and_totals(spark):
    p = _projects(spark)
    page1 = browse.browse(p, sort="recent", page=1, per_page=3).collect()
    assert [r.name for r in page1] == ["p07", "p06", "p05"] and page1[0].total == 7 and page1[0].total_pages == 3
    last = browse.browse(p, sort="recent", page=3, per_page=3).collect()
    assert [r.name for r in last] == ["p04"]                      # null dates sort last
    kw = browse.browse(p, _bridge(spark), keyword="API", language="go", sort="bogus").collect()
    assert [r.name for r in kw] == ["p01", "p05"] and kw[0].total == 2


def test_lists_lookups_and_like(spark):
    p = _projects(spark)
    assert [r.name for r in browse.list_projects(p, limit=2, offset=1).collect()] == ["p02", "p03"]
    assert browse.lookup(p, "p02").collect()[0].readme == "No README available"
    assert browse.lookup(p, "p01").collect()[0].readme == "readme"
    assert [r.name for r in browse.like_search(p, "ALPHA").collect()] == ["p05"]
    assert [r.name for r in browse.recent(p, 2).collect()] == ["p07", "p06"]


def test_facets_and_totals(spark):
    p, b = _projects(spark), _bridge(spark)
    assert {r.keyword: r.project_count for r in browse.keyword_facet(b).collect()} == {"api": 3, "web": 1, "cli": 1}
    assert [r.keyword for r in browse.top_keywords(b, 2).collect()] == ["api", "cli"]
    assert [(r.primary_language, r.project_count) for r in browse.top_languages(p).collect()] == [("go", 4)]
    mods = spark.createDataFrame([(i, 1, f"m{i}", f"z/{i:02d}", "") for i in range(20)],
                                 "module_id long, project_id long, name string, path string, description string")
    t = browse.totals(p, mods, b).collect()[0]
    assert (t.projects, t.modules, t.keywords, t.total_loc, t.git_repos, t.with_readme) == (7, 20, 3, 250, 2, 1)
    docs = {r.id: r for r in browse.project_documents(p, b, mods, [1, 2]).collect()}
    assert docs.keys() == {1, 2} and docs[1].keywords == ["api", "web"]
    assert [m.name for m in docs[1].modules] == [f"m{i}" for i in range(20)] and docs[2].modules == []
    kids = browse.project_children(p, b, mods)
    assert kids.where("kind = 'module'").count() == 20 and kids.where("kind = 'keyword'").count() == 5
    far = browse.browse(p, page=99).collect()
    assert [(r.id, r.total) for r in far] == [(None, 7)]
    import pytest

    with pytest.raises(ValueError):
        browse.list_projects(p, limit=501)
    assert [r.name for r in browse.list_projects(p, bridge=b, keyword="WEB").collect()] == ["p01"]
    j = {(r.id, r.keyword) for r in browse.keyword_join(p, b).collect()}
    assert (1, "web") in j and len(j) == 5
