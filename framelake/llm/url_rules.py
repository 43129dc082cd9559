"""Operator 6: URL filter by association rules. FP-growth mines token combinations of labelled URLs; rules of enough
confidence and support judge other URLs through an inverted index from each rule's rarest token."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.sources.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules that are broadcast, at most.
FEW_RULES = 50_000


@dataclass(frozen=True)
class Mining:
    #: Share of the labelled URLs that hold a combination, at least.
    support: float = 0.005
    #: Share of a combination's URLs that have the rule's label, at least.
    confidence: float = 0.9
    #: Tokens in a combination, at most; None: any number.
    tokens: int | None = None


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule (verdict, host, path) that fits: its host and all subdomains, and
    paths that start with its path; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its scheme, host labels (the last marked), path words with the first digit of numbers,
    and the names of query parameters."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[/.\-_]"), lambda s: s != "")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    marked = F.concat(
        F.array(F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)), F.concat(F.lit("top="), F.element_at(labels, -1))),
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("host="), s)),
        F.transform(segments, lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("number="), F.substring(s, 1, 1))).otherwise(F.concat(F.lit("path="), s))),
        F.transform(F.filter(query, lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(marked))


def _tokens(labelled: DataFrame, least: int) -> DataFrame:
    """labelled (row, tokens, label) -> (token, rep, size, by) of the tokens that `least` labelled URLs hold: the smallest token
    that stands in exactly the same URLs, how many, and how many by label. Two sets of URLs are equal if their counts
    and two sums of hashes are."""
    rows = labelled.select("row", "label", F.explode("tokens").alias("token"))
    marks = F.struct(F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.sum("n").alias("n"))
    each = rows.withColumn("n", F.lit(1)).groupBy("token", "label").agg(marks.alias("m"))
    held = each.groupBy("token").agg(F.sum("m.a").alias("a"), F.sum("m.b").alias("b"), F.sum("m.n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "m.n"))).alias("by")).filter(F.col("size") >= least)
    same = held.groupBy("a", "b", "size").agg(F.min("token").alias("rep"))
    return held.join(same, ["a", "b", "size"]).select("token", "rep", "size", "by")


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """labelled (tokens, label) -> rules (items, label, n, confidence): combinations whose URLs nearly all have one label.

    A combination that contains a shorter rule for the same label says nothing new and is left out. All labelled rows
    are mined. Without labelled rows there are no rules.

    What can't be part of a longer rule doesn't go into the mining, so a path of very many words doesn't make a set of
    each choice of them: a token whose URLs all have one label is a rule for that label by itself, and no longer one
    with it can be for another; a token that all URLs hold adds nothing to a combination; and of tokens that stand in
    exactly the same URLs one is mined, for which each of the others is put in afterwards.
    """
    labelled = materialise(labelled.filter(F.col("label").isNotNull()).select("tokens", "label").withColumn("row", F.monotonically_increasing_id()), "labelled")
    total = labelled.count()
    least = max(1, math.ceil(mining.support * total))
    tokens = materialise(_tokens(labelled, least), "tokens")
    alone = tokens.select(F.array("token").alias("items"), F.explode("by").alias("label", "n"), "size").filter(F.col("n") >= least)
    alone = alone.select("items", "label", "n", (F.col("n") / F.col("size")).alias("confidence"))
    mixed = tokens.filter((F.size("by") > 1) & (F.col("size") < total))
    reps = labelled.select("row", F.explode("tokens").alias("token")).join(F.broadcast(mixed.filter("token = rep").select("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = labelled.join(reps.hint("merge"), "row", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit("label="), "label")).alias("items"))
    found = materialise(FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=1.0).fit(baskets).freqItemsets, "itemsets")
    of_label = F.filter("items", lambda x: x.startswith("label="))
    split = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("label="))).alias("items"), F.get(of_label, F.lit(0)).alias("mark"), "freq", F.size(of_label).alias("marks"))
    split = split.filter((F.size("items") > 1) & (F.size("items") <= mining.tokens if mining.tokens else F.lit(True)))
    whole = split.filter("marks = 0").select("items", F.col("freq").alias("of"))
    long = split.filter("marks = 1").join(whole, "items").select("items", F.expr("substring(mark, 7)").alias("label"), F.col("freq").alias("n"), (F.col("freq") / F.col("of")).alias("confidence"))
    rules = materialise(_least_rules(materialise(alone.unionByName(long).filter(F.col("confidence") >= mining.confidence), "rules")), "rules")
    # Every choice of one token of each that stands for several.
    groups = mixed.groupBy("rep").agg(F.collect_list("token").alias("tokens"))
    named = rules.filter(F.size("items") > 1).withColumn("rule", F.monotonically_increasing_id())
    spelt = named.select("rule", "label", "n", "confidence", F.explode("items").alias("rep")).join(groups, "rep").groupBy("rule", "label", "n", "confidence").agg(F.collect_list("tokens").alias("choice"))
    chosen = F.aggregate("choice", F.array(F.array().cast("array<string>")), lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(c, lambda x: F.array_append(a, x)))))
    return rules.filter(F.size("items") == 1).unionByName(spelt.select(F.explode(chosen).alias("items"), "label", "n", "confidence").withColumn("items", F.array_sort("items")))


def _least_rules(rules: DataFrame) -> DataFrame:
    """Rules that contain no shorter one for the same label. A shorter one is met by its first item."""
    longer = rules.filter(F.size("items") > 1).select(F.col("items").alias("whole"), "label", F.explode("items").alias("first"))
    parts = rules.select(F.col("items").alias("part"), "label", F.col("items")[0].alias("first"))
    inside = longer.join(parts, ["label", "first"]).filter((F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0))
    return rules.join(inside.select(F.col("whole").alias("items"), "label").distinct(), ["items", "label"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """urls (row, tokens) and rules -> (row, label, items, confidence) of each URL's strongest rule: highest confidence, then
    most URLs, then 'allow'. A rule is found by its rarest token (counts: token, n), then its other items are tested. URLs
    compress so well that by the bytes of their shuffle they'd be taken for small and broadcast, so the joins are named."""
    numbered = rules.withColumn("rule_id", F.xxhash64("items", "label"))
    rarest = numbered.select("*", F.explode("items").alias("token")).join(counts.hint("merge"), "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce(counts["n"], F.lit(0)), "token")).alias("token"))
    index = materialise(numbered.join(rarest, "rule_id").select("token", "items", "label", "n", "confidence"), "index")
    index = index.hint("broadcast" if index.count() <= FEW_RULES else "merge")
    hits = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    best = F.struct("confidence", "n", (F.col("label") == "allow").alias("milder"), "label", "items")
    return hits.groupBy("row").agg(F.max(best).alias("best")).select("row", "best.label", "best.items", "best.confidence")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, mining: Mining = Mining(), default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, matched (the mined rule's items) of every page.

    Listed rules decide first. Other URLs get the verdict of their strongest mined rule, or `default`. Rules are mined
    from labels (page_id, label) if given, else from the verdicts of the listed rules on the URLs that they fit.
    Reads page_id (passed through: nulls and repeats stay) and url; a null url or one without :// has empty host, path
    and tokens and gets the default. Other columns are ignored. An empty table gives no rows.
    """
    host, path = host_of(F.coalesce(F.col("url"), F.lit(""))), path_of(F.coalesce(F.col("url"), F.lit("")))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    parsed = materialise(parsed.withColumn("row", F.monotonically_increasing_id()), "urls")
    if labels is None:
        labelled = parsed.filter("listed is not null").select("tokens", F.col("listed").alias("label"))
    else:
        labelled = parsed.join(labels.filter("page_id is not null").groupBy("page_id").agg(F.max("label").alias("label")).hint("merge"), "page_id").select("tokens", "label")
    counts = parsed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    mined = match(parsed.filter("rule is null").select("row", "tokens"), mine(labelled, mining), counts)
    judged = parsed.join(mined.select("row", "label", F.col("items").alias("matched")).hint("merge"), "row", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", "label", F.lit(default)).alias("verdict"), "matched")
