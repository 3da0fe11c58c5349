"""URL filter: host segmentation and a naive Bayes verdict where no rule decides.

Rules (host, path) decide first: a rule fits its host and all subdomains if the
path starts with the rule's path; the longest fitting rule wins. All other URLs
get the verdict of a multinomial naive Bayes model over segmented tokens. It
learns from the URLs that rules decide.

Stretches of letters and digits in the host are split by a unigram Viterbi search. The unigram counts come from
the words of all pages' visible text and of all paths. Only words that occur in
some host label matter to it, so the candidate substrings of the distinct labels
are joined with the counts and no lexicon is sent to the tasks.

A null URL, or one without ``://``, has an empty host and path, no tokens and
the verdict of the class prior. Repeated pages get the same verdict each. Other
columns are ignored. Without a decided URL the verdict is ``allow``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, stored

#: (verdict, host, path) of the contract's rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

MAX_WORD = 20
SMOOTHING = 1.0
LABEL_BYTES = 63


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [
        F.when(
            ((host == name) | host.endswith("." + name)) & path.startswith(start),
            F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, name, start in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule: string, verdict: string>"))


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word occurs in the visible text of all pages and in all paths."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.concat_ws(" ", visible, path_of(F.col("url")))
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    words = pages.select(F.explode(tokens).alias("word")).filter(F.length("word").between(1, MAX_WORD))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest words of ``label``; unknown stretches cost more with each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - MAX_WORD), end):
            word = label[start:end]
            n = counts.get(word)
            score = math.log(n / total) if n else -math.log(total) - math.log(10) * (end - start)
            options.append((best[start][0] + score, start))
        best.append(max(options, key=lambda x: (x[0], x[1])))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def segments(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """Words of each distinct host: host, tokens."""
    spark = hosts.sparkSession
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("at", "label"))
    names = labels.select("label").distinct().filter("label <> ''")
    at = F.expr("sequence(1, length(label))")
    cuts = F.flatten(
        F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("label") - i + 1)), lambda n: F.substring("label", i, n)))
    )
    substrings = names.select("label", F.explode(F.array_distinct(cuts)).alias("word"))
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    known = substrings.join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    table = names.join(known, "label", "left")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens = [best_split(x, dict(c) if c is not None else {}, total) for x, c in zip(frame.label, frame.counts, strict=True)]
            yield pd.DataFrame({"label": frame.label, "tokens": tokens})

    found = stored(table.mapInPandas(split, "label string, tokens array<string>"), "segments")
    tokens = labels.join(found, "label", "left").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("parts"))
    return tokens.select("host", F.flatten(F.filter(F.col("parts.tokens"), lambda x: x.isNotNull())).alias("host_tokens"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Host, path, fitting rule, verdict, tokens and log odds of blocking for each page."""
    spark = pages.sparkSession
    url = F.col("url")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    urls = stored(urls.select("row", "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given")), "urls")
    counts = stored(word_counts(pages), "words")
    hosts = stored(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows")), "hosts")
    names = stored(segments(hosts, counts).join(hosts, "host"), "host-tokens")

    n_urls = urls.count()
    whole = join_groups(urls, names, "host", "n_rows", n_urls)
    path_tokens = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tokens = F.concat(F.transform("host_tokens", lambda x: F.concat(F.lit("h:"), x)), F.transform(path_tokens, lambda x: F.concat(F.lit("p:"), x)))
    whole = stored(whole.select("row", "page_id", "host", "path", "rule", "given", tokens.alias("tokens")), "tokens")

    each = whole.select("row", "given", F.explode("tokens").alias("token"))
    blocked, allowed = (F.count(F.when(F.col("given") == v, 1)) for v in ("block", "allow"))
    seen = stored(each.groupBy("token").agg(blocked.alias("b"), allowed.alias("a"), F.count(F.lit(1)).alias("n")), "token-counts")
    sums = seen.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1)), F.sum("n")).first()
    b, a, v, n_tokens = (x or 0 for x in sums)
    prior_b, prior_a = whole.select(blocked, allowed).first()
    odds = F.log((F.col("b") + SMOOTHING) / (b + SMOOTHING * max(v, 1))) - F.log((F.col("a") + SMOOTHING) / (a + SMOOTHING * max(v, 1)))
    weights = seen.select("token", "n", odds.alias("odds"))
    per_row = join_groups(each.select("row", "token"), weights, "token", "n", n_tokens).groupBy("row").agg(F.sum("odds").alias("odds"))
    prior = math.log(prior_b + 1) - math.log(prior_a + 1)
    judged = whole.join(per_row, "row", "left").withColumn("log_odds", F.coalesce("odds", F.lit(0.0)) + prior)
    own = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "log_odds", "tokens")


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"))
