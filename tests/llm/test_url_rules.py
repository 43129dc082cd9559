from __future__ import annotations

import itertools
import unittest.mock
from collections import Counter

from framelake.llm import url_rules
from framelake.llm.queries import URL_RULES, op6_url_rules
from framelake.llm.url_rules import Mining, judge_urls
from tests.conftest import SF


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.find(c) for c in marks if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return host.translate({c: c + 32 for c in range(65, 91)}), cut(rest[len(host) :], "?#")


def listed(url):
    host, path = parts(url)
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(rows, mining):
    """rows (row, tokens, listed) -> mined verdicts; every combination of every number of tokens is counted."""
    labelled = [(set(t), v) for _, t, v in rows if v]
    sizes = lambda t: range(1, min(len(t), mining.tokens or len(t)) + 1)
    n = Counter(c for t, _ in labelled for k in sizes(t) for c in itertools.combinations(sorted(t), k))
    by = Counter((c, v) for t, v in labelled for k in sizes(t) for c in itertools.combinations(sorted(t), k))
    least = mining.support * len(labelled)
    rules = {(c, v): (m / n[c], m) for (c, v), m in by.items() if m >= least and m / n[c] >= mining.confidence}
    rules = {(c, v): x for (c, v), x in rules.items() if not any((d, v) in rules for k in range(1, len(c)) for d in itertools.combinations(c, k))}
    out = {}
    for row, t, _ in rows:
        fit = [(x[0], x[1], v == "allow", v) for (c, v), x in rules.items() if set(c) <= set(t)]
        out[row] = max(fit)[3] if fit else "allow"
    return out


def test_query_against_brute_force(spark):
    from pyspark.sql import functions as F

    from framelake.llm.url_rules import host_of, path_of, tokens_of

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in op6_url_rules(spark, SF).collect()}
    rows = pages.select("page_id", "url", tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("t")).collect()
    assert len(got) == len(rows)
    mined = brute([(r.page_id, r.t, listed(r.url)[1]) for r in rows], Mining(tokens=4))  # no rule of these pages is longer
    for r in rows:
        rule, verdict = listed(r.url)
        assert (got[r.page_id].host, got[r.page_id].path) == parts(r.url)
        assert (got[r.page_id].rule, got[r.page_id].verdict) == (rule, verdict or mined[r.page_id])


def test_odd_urls_labels_and_nulls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.ORG", "http://x.org/#f", "http://Éx.COM/de/?a=1#b", "a://b://c/d", "http://notorg/", "http://spam.net/x/1", "http://spam.net/x/2", "http://ok.net/y"]
    df = spark.createDataFrame([(k % 10 or None, u, "z") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = judge_urls(df, URL_RULES).collect()
    assert sorted((r.host, r.path, r.rule or "") for r in got) == sorted((*parts(u), listed(u)[0] or "") for u in urls)
    labels = spark.createDataFrame([(9, "block"), (9, "block"), (1, "allow"), (None, "block")], "page_id long, label string")
    by = {r.host + r.path: r.verdict for r in judge_urls(df, [], labels, Mining(0.01, 0.9)).collect()}
    assert by["spam.net/x/1"] == "block" and by[""] == "allow"
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def test_long_paths_and_long_rules(spark):
    """A rule of four tokens is found; directories of 25 words, of one label or of both, are mined in seconds; tokens that
    always stand together are each a rule's part."""
    deep = "/".join(f"w{k}" for k in range(25))
    mixed = "/".join(f"m{k}" for k in range(25))
    urls = [(f"http://a.x/{deep}/{k}", "block") for k in range(40)] + [(f"http://b.x/{mixed}/{'good' if k % 2 else 'bad'}", "allow" if k % 2 else "block") for k in range(40)]
    four = ["p", "q", "r", "s"]
    urls += [(f"http://c.x/{'/'.join(x for x in four if x != out)}", "allow") for out in four for _ in range(12)]
    urls += [("http://c.x/p/q/r/s", "block")] * 15
    unknown = [("http://d.x/w7/z", "block"), ("http://d.x/s/r/q/p", "block"), ("http://d.x/p/q/r", "default"), ("http://d.x/m3/bad", "block"), ("http://d.x/m3/good", "allow"), ("http://d.x/none", "default")]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls + unknown)], "page_id long, url string")
    labels = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(urls)], "page_id long, label string")
    got = {r.page_id: r for r in judge_urls(df, [], labels, Mining(0.02, 0.9), default="default").collect()}
    assert [got[len(urls) + k].verdict for k in range(len(unknown))] == [v for _, v in unknown]
    assert sorted(got[len(urls) + 1].matched) == ["path=p", "path=q", "path=r", "path=s"]
    capped = {r.page_id: r.verdict for r in judge_urls(df, [], labels, Mining(0.02, 0.9, 3), default="default").collect()}
    assert capped[len(urls) + 1] != "block"


def test_mixed_tokens_against_brute_force(spark):
    """Random URLs whose words come in groups that always stand together."""
    import random

    rng = random.Random(3)
    groups = [["a", "b"], ["c"], ["d", "e", "f"], ["g"], ["h"], ["i"]]
    def path(n):
        return "/".join(w for g in rng.sample(groups, n) for w in g)

    known = [(f"http://x.y/{path(rng.choice([2, 3, 3, 4]))}", rng.choice(["allow", "block", "block"])) for _ in range(60)]
    known = [(u, "block" if {"c", "g", "h", "i"} <= set(u.split("/")) else v) for u, v in known]
    urls = [u for u, _ in known] + [f"http://x.y/{'/'.join(rng.sample('abcdefghi', rng.randint(1, 7)))}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(known)], "page_id long, label string")
    tokens = lambda u: {"scheme=http", "top=y", "host=x", "host=y", *(f"path={w}" for w in u.split("://x.y/")[1].split("/"))}
    mining = Mining(0.05, 0.8)
    want = brute([(k, tokens(u), known[k][1] if k < 60 else None) for k, u in enumerate(urls)], mining)
    assert {r.page_id: r.verdict for r in judge_urls(df, [], labels, mining).collect()} == want


def test_urls_are_never_the_broadcast_side(spark):
    """By the bytes of a shuffle URLs look small, so every join of theirs names what it does, for few and for many rules."""
    urls = spark.createDataFrame([(k, ["host=a", f"path={k % 3}"]) for k in range(50)], "row long, tokens array<string>")
    rules = spark.createDataFrame([(["host=a", "path=1"], "block", 9, 0.95), (["path=2"], "allow", 8, 0.9)], "items array<string>, label string, n long, confidence double")
    counts = spark.createDataFrame([("host=a", 50), ("path=1", 17), ("path=2", 16)], "token string, n long")
    for most, strategy in ((url_rules.FEW_RULES, "broadcast"), (1, "merge")):
        with unittest.mock.patch.object(url_rules, "FEW_RULES", most):
            found = url_rules.match(urls, rules, counts)
        assert {r.row: r.label for r in found.collect()} == {k: "block" if k % 3 == 1 else "allow" for k in range(50) if k % 3}
        joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert joins and all(f"rightHint=(strategy={strategy})" in x for x in joins)
