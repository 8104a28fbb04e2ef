"""Plan checks for the registered queries: no
cartesian products, and global (unpartitioned) windows only over results
that a limit has already bounded."""

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"
# W1 positional scores: a global window over at most 2 x limit hits
# (j2_attach joins catalog rows to such a list)
GLOBAL_WINDOW_OK = {"x6_hybrid", "x11_hybrid_no_vectors", "w1_rank_score", "j2_attach"}
_ORDER_SUFFIXES = ("ASC NULLS FIRST", "ASC NULLS LAST", "DESC NULLS FIRST", "DESC NULLS LAST")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _global_windows(plan: str) -> int:
    """Window operators whose spec starts with an ordering (no PARTITION BY)."""
    n = 0
    for line in plan.splitlines():
        if "Window [" in line and "windowspecdefinition(" in line:
            first = line.split("windowspecdefinition(", 1)[1].split(",")[0].strip()
            if first.endswith(_ORDER_SUFFIXES) or first.startswith("specifiedwindowframe"):
                n += 1
    return n


def _limit_below_window(plan: str) -> bool:
    """Whether every global window reads what a limit has cut (children follow their parent, deeper)."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if _global_windows(line):
            depth = len(line) - len(line.lstrip(" :+-*"))
            below = []
            for x in lines[i + 1:]:
                if len(x) - len(x.lstrip(" :+-*")) <= depth:
                    break
                below.append(x)
            if not any("TakeOrderedAndProject" in x or "GlobalLimit" in x for x in below):
                return False
    return True


def test_no_cartesian_and_bounded_global_windows(spark):
    qs = entry.queries()
    bad_cart, bad_window = [], []
    for k, fn in qs.items():
        if k.startswith("t"):      # streaming keys run their stream when built
            continue
        plan = _plan(fn(spark, SMOKE))
        if "CartesianProduct" in plan:
            bad_cart.append(k)
        if _global_windows(plan) and (k not in GLOBAL_WINDOW_OK or not _limit_below_window(plan)):
            bad_window.append(k)
    assert bad_cart == []
    assert bad_window == []
    assert _global_windows(_plan(qs["w1_rank_score"](spark, SMOKE))) > 0   # the detector works
