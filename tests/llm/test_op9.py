import itertools
import random
import re

from treeline.llm import op9_url_rules as op

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fixed(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def toks(url):
    host, path = parts(url)
    out = {f"host:{x}" for x in host.split(".")} | {"path:" + re.sub("[0-9]+", "#", x) for x in path.lower().split("/")}
    return {t for t in out | {f"query:{q}" for q in re.findall(r"[?&]([^=&#]+)", url or "")} if not t.endswith(":")}


ODD = [None, "", "nohost", "http://", "https://Example.ORG/en/17?x=1", "http://a.example.org/es", "http://a.example.org/es/9", "http://notexample.org/es/1",
       "ftp://x.com/fr/", "x://com/de/1", "http://com", "http://b.com?de/", "http://u@h.com:80/de/#f", "a://b://c.org/x", "http://É.net/a\nb/1"]


def test_rules_on_odd_urls(llm):
    pages = llm.createDataFrame([*enumerate(ODD), (0, None), (4, ODD[4])], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as verdict")
    got = op.judge(pages, op.mine(pages, llm.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        url = ODD[r.page_id]
        rule, verdict = fixed(url)
        assert (r.host, r.path) == parts(url)
        assert (r.rule, r.verdict) == (rule, verdict or "allow"), url


def test_mined_rules_against_brute_force(llm):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(600):
        host, lang = rng.choice(["spam", "news", "shop"]), rng.choice(["en", "it"])
        q = rng.choice(["", "?ref=1", "?page=2"])
        pages.append((i, f"http://www.{host}.example.net/{lang}/{i}{q}"))
        bad = (host == "spam" and q == "?ref=1") if rng.random() < .97 else rng.random() < .5
        if i % 3:
            labels.append((i, int(not bad), None))
    p = llm.createDataFrame(pages, "page_id long, url string")
    mined = op.mine(p, llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    bad = {i for i, q, _ in labels if q == 0}
    held = {i: toks(pages[i][1]) for i, _, _ in labels}
    want = set()
    for n in range(1, 9):
        for combo in itertools.combinations(sorted(set().union(*held.values())), n):
            seen = [i for i, t in held.items() if t.issuperset(combo)]
            k = sum(i in bad for i in seen)
            if k >= 5 and k / len(held) >= 0.01:
                c, m = k / len(seen), len(seen)
                low = (c + 1.96**2 / 2 / m - 1.96 * (c * (1 - c) / m + 1.96**2 / 4 / m / m) ** .5) / (1 + 1.96**2 / m)
                if low >= 0.6:
                    want.add(combo)
    rules = {tuple(r.antecedent) for r in mined.collect()}
    assert rules == want and ("host:spam", "query:ref") in rules
    blocked = {r.page_id for r in op.judge(p, mined).where("verdict = 'block'").collect()}
    assert blocked == {i for i, u in pages if any(toks(u).issuperset(r) for r in want)}


def test_empty(llm):
    pages = llm.createDataFrame([], "page_id long, url string")
    assert op.judge(pages, op.mine(pages, llm.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_a_rule_does_not_depend_on_the_table_size(llm):
    pages = llm.range(10_000).selectExpr("id as page_id", "if(id < 50, concat('http://bad.example.net/', id), concat('http://good', id % 7, '.example.net/', id)) as url")
    labels = llm.range(10_000).selectExpr("id as doc_id", "int(id >= 50) as quality", "int(null) as toxic")
    for n in (5_000, 10_000):
        mined = op.mine(pages, labels.where(f"doc_id < {n}"))
        assert ["host:bad"] in [r.antecedent for r in mined.collect()]
        assert {r.page_id for r in op.judge(pages, mined).where("verdict = 'block'").collect()} == set(range(50))
