"""URL filter: policy rules, then host word segmentation and naive Bayes.

Hosts and paths are split into parts of letters and digits, and parts into
runs of letters and runs of digits.  Concatenated names are split further
into words by a unigram Viterbi search, with word counts of the whole
corpus; a run of digits is the word '<number>'.  The most specific policy rule
decides first, then multinomial naive Bayes over all words of host and path.

Naive Bayes learns the words of two classes from two sources.  One is text:
the words of labelled documents, toxic ones for block and the others for
allow, so a name made of words of abusive texts is blocked though no list has
them.  The other is the URLs: those with a word of a short given list are
examples for block, which brings in the words that go with it, all others for
allow.  Both sources count the same in total within a class, and words are
smoothed, so no single source decides alone.

Scale: the corpus is counted by a partially aggregated group-by, and only
substrings of runs of letters are looked up, by a join, so no dictionary is
sent whole to a task.  A run is segmented once, not once per URL or part; it
is known by a number, and its substrings are taken from overlapping blocks of
``BLOCK`` letters, so the rows that are exchanged grow with its length and not
with its square.  URLs meet the parts' weights in a join of two written
tables, so adaptive execution splits a part that a third of all URLs share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.operators.joins import per_key_join
from hourglass.session import materialize

# Words that mark an unwanted site when a host or path has them.
UNWANTED = ("adult", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gambling", "hentai", "lottery", "malware", "nude",
            "phishing", "pill", "pills", "poker", "porn", "porno", "sex", "slots", "spam", "viagra", "warez", "xxx")
# The policy rules as (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_LABELS = 20_000  # labelled documents whose words are learned
SALTS = 32  # tasks that the parts of one frequent word are dealt to
BLOCK = 1024  # letters of a run whose substrings are made together
SEED_SHARE = 1e-5  # share of the corpus that an unwanted word counts for in the dictionary

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(texts: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """word, n (and the columns ``by``): lower-case letter runs of all texts."""
    words = texts.select(*by, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``part``; an unknown run of k letters has probability 10 / (total * 10^k).

    Of equally probable splits, the one with the longer last words.  Words
    and unknown runs may be of any length.
    """
    n, tenth = len(part), math.log(10)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    base = tenth - math.log(max(total, 1))
    sizes = sorted({len(w) for w in counts}, reverse=True)
    unknown, since = -math.inf, 0  # the best split that ends in an unknown run, and where the run starts
    for stop in range(1, n + 1):
        if best[stop - 1] + base > unknown:
            unknown, since = best[stop - 1] + base, stop - 1
        unknown -= tenth
        best[stop], back[stop] = unknown, since
        for size in sizes:
            if size <= stop and (k := counts.get(part[stop - size:stop])):
                p = best[stop - size] + math.log(k / total)
                if p > best[stop] or (p == best[stop] and stop - size < back[stop]):
                    best[stop], back[stop] = p, stop - size
    out, stop = [], n
    while stop:
        out.append(part[back[stop]:stop])
        stop = back[stop]
    return out[::-1]


def substrings(runs: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``(number, word)``: the distinct substrings of the given sizes of every run ``(number, run)``."""
    if not sizes:
        return runs.select("number", F.col("run").alias("word")).where("1 = 0")
    reach = max(sizes) - 1
    starts = F.sequence(F.lit(0), F.length("run") - 1, F.lit(BLOCK))
    blocks = runs.where("run <> ''").select("number", F.explode(F.transform(starts, lambda i: F.substring(F.col("run"), i + 1, F.lit(BLOCK + reach)))).alias("block"))
    at = F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("block")))).alias("at")
    tails = blocks.select("number", "block", at).select("number", F.substring(F.col("block"), F.col("at"), F.lit(reach + 1)).alias("tail"))
    wanted = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.length("tail"))
    return tails.select("number", "tail", F.explode(wanted).alias("size")).select("number", F.expr("left(tail, size)").alias("word")).distinct()


def segment(parts: DataFrame, counts: DataFrame, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """``parts`` (part: distinct strings) to part, words: those of its letter runs, and '<number>' for each digit run.

    Only dictionary words no longer than the longest run are looked up, by
    the lengths that occur.  A run's known substrings come to one row, whose
    size grows with the run's length.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    seeded = max(1, int(total * SEED_SHARE))
    runs = F.regexp_extract_all("part", F.lit(r"\p{N}+|\P{N}+"), F.lit(0))
    known_parts = materialize(parts.select("part", F.monotonically_increasing_id().alias("id")), "numbered-parts")
    pieces = materialize(known_parts.select("id", F.posexplode(runs).alias("place", "run")).withColumn("digits", F.col("run").rlike(r"^\p{N}")), "url-runs")
    letters = pieces.where("not digits").select("run").distinct().withColumn("number", F.monotonically_increasing_id())
    letters = materialize(letters.withColumn("size", F.length("run")), "letter-runs")
    longest = letters.agg(F.max("size")).first()[0] or 0
    sizes = [r[0] for r in counts.select(F.length("word").alias("size")).where(F.col("size") <= longest).distinct().collect()]
    known = substrings(letters, sizes).join(counts, "word").groupBy("number").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    seeds = {w: seeded for w in unwanted}

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(run, known, strict=True):
            counts = dict(seeds)
            for e in (k if k is not None else []):
                counts[e["word"]] = max(e["n"], counts.get(e["word"], 0))
            out.append(viterbi(p, counts, total + seeded * len(seeds)))
        return pd.Series(out, dtype=object)

    words = materialize(letters.join(known, "number", "left").select("run", split("run", "known").alias("words")), "run-words")
    found = pieces.where("not digits").join(words, "run").select("id", "place", "words")
    found = found.unionByName(pieces.where("digits").select("id", "place", F.array(F.lit("<number>")).alias("words")))
    in_order = F.sort_array(F.collect_list(F.struct("place", "words")))
    found = found.groupBy("id").agg(F.flatten(F.transform(in_order, lambda e: e["words"])).alias("words"))
    return known_parts.join(found, "id").select("part", "words")


def text_classes(corpus: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``(word, b, a)``: how often the words of labelled documents occur in toxic ones and in others.

    ``corpus`` has doc_id and text, ``labels`` doc_id and toxic.  At most
    ``max_labels`` labels are learned from, the first in the order of a hash
    of the id; so the list can be broadcast and texts are not shuffled.  A
    null label or id labels nothing; a document labelled both ways counts for
    both.
    """
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("block")).distinct()
    marked = materialize(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "block").limit(max_labels), "url-labels")
    counts = word_counts(corpus.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), by=["block"])
    return counts.groupBy("word").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("a"))


def class_weights(tokens: DataFrame, texts: DataFrame | None) -> DataFrame:
    """``(word, w)``: the log odds of block of every word of ``tokens`` (word, b, a: counts in URLs).

    The counts of ``texts`` (word, b, a) are scaled so that a class has as
    many words in them as in the URLs, where both have any; then one is added
    to every count, and one word for all unseen ones.
    """
    sums = lambda t: [float(x or 0) for x in t.agg(F.sum("b"), F.sum("a")).first()]
    all_b, all_a = sums(tokens)
    joined = tokens.select("word", F.col("b").cast("double").alias("b"), F.col("a").cast("double").alias("a"))
    if texts is not None:
        text_b, text_a = sums(texts)
        scale = [max(url, 1.0) / text if text else 0.0 for url, text in ((all_b, text_b), (all_a, text_a))]
        joined = joined.join(texts.select("word", F.col("b").alias("tb"), F.col("a").alias("ta")), "word", "left")
        joined = joined.select("word", (F.col("b") + F.coalesce("tb", F.lit(0)) * scale[0]).alias("b"), (F.col("a") + F.coalesce("ta", F.lit(0)) * scale[1]).alias("a"))
        all_b, all_a = all_b + text_b * scale[0], all_a + text_a * scale[1]
    size = tokens.count()
    return joined.select("word", (F.log((F.col("b") + 1) / (all_b + size + 1)) - F.log((F.col("a") + 1) / (all_a + size + 1))).alias("w"))


def judge(pages: DataFrame, corpus: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          unwanted: Sequence[str] = UNWANTED, url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """Every row of ``pages`` without ``html``, with host, path, rule, block_odds (log odds) and verdict.

    ``labels`` (doc_id, toxic) marks documents of ``corpus`` whose words are learned too.

    Result columns replace columns of the same name.  Null urls and urls
    without '://' have an empty host and path, no word, and the verdict of
    the class that is more frequent.  Repeated rows are judged alike.
    Without any training example of a class, the other class is the verdict.
    """
    kept = pages.drop("html", "host", "path", "rule", "block_odds", "verdict")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = materialize(kept.withColumns({"host": host, "path": path, "_row_number": F.monotonically_increasing_id()})
                       .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)), "urls")
    name = F.concat_ws("/", "host", F.translate("path", _UPPER, _LOWER))
    parts = rows.select("_row_number", F.explode(F.split(name, r"[^\p{L}\p{N}]+")).alias("part")).where("part <> ''")
    parts = materialize(parts, "url-parts")
    words = segment(parts.select("part").distinct(), materialize(word_counts(corpus), "words"), unwanted)
    # From here on a part is a number: its text is not repeated for each of its words.
    words = materialize(words.select("part", "words", F.arrays_overlap("words", F.array(*[F.lit(w) for w in unwanted])).alias("unwanted"),
                                     F.monotonically_increasing_id().alias("number")), "segmented")
    links = materialize(parts.join(words.select("part", "number", "unwanted"), "part").drop("part"), "url-links")
    seen = materialize(links.groupBy("_row_number").agg(F.max("unwanted").alias("block")), "examples")
    n_block = seen.where("block").count()
    n_allow = rows.count() - n_block
    by_part = (links.join(seen, "_row_number").groupBy("number")
               .agg(F.sum(F.col("block").cast("long")).alias("b"), F.sum((~F.col("block")).cast("long")).alias("a")))
    per_word = words.select("number", F.explode("words").alias("word")).groupBy("number", "word").agg(F.count(F.lit(1)).alias("times"))
    tokens = per_word.join(by_part, "number").groupBy("word").agg(F.sum(F.col("b") * F.col("times")).alias("b"), F.sum(F.col("a") * F.col("times")).alias("a"))
    tokens = materialize(tokens, "word-classes")
    texts = materialize(text_classes(corpus, labels), "text-classes") if labels is not None else None
    weights = per_key_join(per_word, class_weights(tokens, texts), ["word"], "inner", SALTS).groupBy("number").agg(F.sum(F.col("w") * F.col("times")).alias("w"))
    weights = materialize(weights, "part-weights")
    scores = links.join(weights, "number").groupBy("_row_number").agg(F.sum("w").alias("w"))
    prior = math.log(n_block / n_allow) if n_block and n_allow else -math.inf if not n_block else math.inf
    verdict = F.lit(None).cast("string")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    block_odds = F.coalesce("w", F.lit(0.0)) + F.lit(float(np.clip(prior, -1e9, 1e9)))
    return (rows.join(scores, "_row_number", "left").withColumn("block_odds", block_odds)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_odds") > 0, "block").otherwise("allow")))
            .drop("_row_number", "w"))
