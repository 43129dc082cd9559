from __future__ import annotations

import random

from framelake.llm.quality_rules import Rules, failing_rule, keep_clean, quality_rules


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    full = [x for x in lines if x.encode().strip()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(inside))


def test_counts_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t\n ", "a", "a a a a a a", "é  x\x0by #|é\n\né\r\n é"]
    texts += ["".join(rng.choice("ab #\n.é |") for _ in range(rng.randint(0, 120))) for _ in range(150)] + ["w " * 40000, "long" * 30000]
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)] + [(None, "x", False)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts[:-2]):
        r, want = got[k], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert got[len(texts) - 2].n_repeat_words == 40000
    assert quality_rules(df.limit(0)).count() == 0


def test_line_rules():
    r = Rules()
    assert failing_rule("Home | News | Sport | Weather | About", r) in ("navigation", "symbols")
    assert failing_rule("Home » News » Sport » Weather", r) == "navigation"
    assert failing_rule("All rights reserved.", r) == "boilerplate"
    assert failing_rule("no end mark here", r) == "punctuation"
    assert failing_rule("### $$$ %%% x.", r) == "symbols"
    assert failing_rule('She said: "This is fine."', r) is None and failing_rule("这是一句话。", r) is None


def test_keep_clean_drops_lines_and_documents(spark):
    good = "This is a sentence of some words. Here is another one with more words in it."
    df = spark.createDataFrame([(1, good + "\nHome » News » Sport » Weather", 9, "s"), (2, "junk line\n" * 9, 9, None), (3, good, 9, "t")], "doc_id long, text string, n_chars int, kept string")
    got = {r.doc_id: r for r in keep_clean(df).collect()}
    assert sorted(got) == [1, 3] and got[1].text == good and got[3].kept == "t" and got[1].n_chars == len(good)
