"""Toxicity scores from a learned lexicon, fuzzy matching and context windows.

1. A lexicon is learned from labelled training rows: words whose distinct
   contexts (neighbouring words) lie almost only in toxic documents, by a
   log-likelihood ratio that allows for the size of the vocabulary.
   Counting contexts instead of documents keeps words of copied toxic
   documents out.
2. Levenshtein automata intersected with the lexicon's trie find the terms
   and their misspellings in every document.  Spellings that clean training
   documents use are no misspellings.
3. Every hit is judged in a window of words around it: inside quotation
   marks or beside a word of reporting it is a quotation, beside a
   second-person word it is directed.
4. A logistic regression on the hit counts gives the score.

Scale: training reads at most ``MAX_TRAINING`` labelled rows, chosen by a
hash of their id and text, so the lists of ids and of text hashes are small
enough to broadcast and only the chosen texts are shuffled, repeats once a
task.  Scoring is one scan of whole texts
without a shuffle.  Neither terms nor clean spellings are cut by rank: the
model that is sent to tasks holds words of the training rows only, so its
size is bounded by theirs and does not grow with the scored documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.levenshtein import TrieAutomaton

MAX_TRAINING = 20_000
MAX_PER_ID = 16  # distinct texts of one labelled id
MIN_SHARE = 0.9  # of a term's contexts that are toxic
FALSE_TERMS = 0.01  # expected number of terms that a vocabulary without toxic words would give
WINDOW = 8
THRESHOLD = 0.7
FEATURES = ("exact", "fuzzy", "quoted", "density", "directed")

# Cue words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours you're u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
                          "tú ti tus usted ustedes vosotros vuestro".split())
REPORTING = frozenset("said says say called calls quote quoted quotes word words term wrote writes dit disait mot cité appelé "
                      "sagte sagt wort zitat nannte dijo dice palabra cita llamó".split())
_WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
_MARK = re.compile('["«»“”„‹›\n]')
_CLOSING = {'"': '"', "«": "»", "“": "”", "„": "“”", "‹": "›"}


@dataclass
class Model:
    """Lexicon, spellings that are no misspellings, and regression weights (bias last)."""
    terms: list[str]
    clean: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES) + [-20.0])


class Matcher:
    """Looks words up; remembers recent words in a bounded cache."""
    KEEP = 100_000

    def __init__(self, model: Model):
        self.exact, self.clean = frozenset(model.terms), model.clean
        self.automaton = TrieAutomaton(model.terms)
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """2: a term, 1: a misspelling of one, 0: neither."""
        found = self.known.get(word)
        if found is None:
            found = 2 if word in self.exact else 0 if word in self.clean else int(self.automaton.match(word) is not None)
            if len(self.known) >= self.KEEP:
                self.known.clear()
            self.known[word] = found
        return found


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Places of the quotations in order: from a mark to the one that closes it on the same line, found in one pass.

    A mark that nothing closes on its line opens no quotation.
    """
    out: list[tuple[int, int]] = []
    opened: dict[str, int] = {}  # place of the first open mark, by kind

    for m in _MARK.finditer(text):
        mark, at = m[0], m.start()
        if mark == "\n":
            opened.clear()
            continue
        begun = [(place, kind) for kind, place in opened.items() if mark in _CLOSING[kind]]
        if begun:
            place, kind = max(begun)
            del opened[kind]
            while out and out[-1][0] > place:  # quotations inside this one
                out.pop()
            if not out or out[-1][1] <= place:
                out.append((place, at))
            else:
                out[-1] = (out[-1][0], at)
        elif mark in _CLOSING:
            opened.setdefault(mark, at)
    return out


def hit_features(text: str | None, matcher: Matcher) -> list[float]:
    """The features of one text, whatever its length; no words give zeros."""
    text = (text or "").lower()
    words = _WORD.findall(text)
    kind, known = matcher.kind, matcher.known
    kinds = {w: k for w in set(words) if (k := known.get(w)) or (k is None and (k := kind(w)))}
    if not kinds:
        return [0.0] * len(FEATURES)
    exact = fuzzy = quoted = directed = 0
    places = list(_WORD.finditer(text))
    spans = quoted_spans(text)
    starts = [a for a, _ in spans]
    for at, word in enumerate(words):
        if word not in kinds:
            continue
        near = words[max(0, at - WINDOW):at] + words[at + 1:at + 1 + WINDOW]
        span = bisect_right(starts, places[at].start()) - 1
        if (span >= 0 and places[at].end() <= spans[span][1]) or (kinds[word] and not REPORTING.isdisjoint(words[max(0, at - 2):at])):
            quoted += 1
            continue
        exact += kinds[word] == 2
        fuzzy += kinds[word] == 1
        directed += not SECOND_PERSON.isdisjoint(near)
    rate = 100 * (exact + fuzzy) / len(words)
    return [math.log1p(x) for x in (exact, fuzzy, quoted, rate, directed)]


def features(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append ``features`` (array of double); replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([hit_features(t, matcher) for t in texts], dtype=object)

    return docs.withColumn("features", run(F.col(text_col)))


def training_rows(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """Text and toxic (0/1) of at most ``max_training`` labelled documents, each distinct text of an id once.

    Only labels whose crc32(doc_id as text) modulo 3 is not 1 are seen.
    Contradicting labels of one id count as toxic; null labels and ids are
    no labels.  Of a repeated id the text with the least hash in each of
    ``MAX_PER_ID`` shares of the hashes is taken, and of all these the first
    by hash, before any text is kept or moved.
    """
    usable = (labels.where("doc_id is not null and toxic is not null")
              .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    least = rows.groupBy("doc_id", F.pmod("text_hash", F.lit(MAX_PER_ID)).alias("share")).agg(F.min("text_hash").alias("text_hash"))
    chosen = least.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash").limit(max_training).select("doc_id", "text_hash")
    return (rows.join(F.broadcast(chosen), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "toxic")
            .agg(F.first("text").alias("text")).select("text", "toxic"))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, toxic in batch.itertuples(index=False, name=None):
            words = _WORD.findall((text or "").lower())
            seen = set(zip(words, ["", *words], [*words[1:], ""]))  # noqa: B905  # the second list is longer by one
            seen = [(w, f"{a} {b}", int(toxic > 0)) for w, a, b in seen]
            yield pd.DataFrame(seen, columns=["word", "context", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """Lexicon, clean spellings and regression weights; without labels of both classes all scores are near 0."""
    rows = training_rows(docs, labels, max_training).cache()
    try:
        once = (rows.mapInPandas(_contexts, "word string, context string, toxic int")
                .groupBy("word", F.xxhash64("context").alias("context")).agg(F.max("toxic").alias("toxic")))
        words = once.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).cache()
        toxic, clean, size = words.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
        if not toxic or not clean:
            return Model([])
        p = toxic / (toxic + clean)
        n, half = F.col("a") + F.col("b"), F.lit(0.5)
        ratio = 2 * (F.col("a") * F.log(F.col("a") / (n * p)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - p)))).otherwise(0.0))
        found = (words.where(F.col("a") / (n + half) >= MIN_SHARE - 0.05).where(F.col("a") >= MIN_SHARE * n)
                 .withColumn("ratio", ratio).where(F.col("ratio") >= 2 * math.log(size / FALSE_TERMS)))
        terms = sorted(r["word"] for r in found.select("word").collect())
        shared = docs.sparkSession.sparkContext.broadcast(Model(terms))

        @F.pandas_udf("boolean")
        def alike(spellings: pd.Series) -> pd.Series:
            matcher = Matcher(shared.value)
            return spellings.map(lambda w: matcher.kind(w) == 1)

        used = words.where((F.col("b") >= 2) & (F.col("a") < MIN_SHARE * n)).where(alike("word"))
        clean_words = frozenset(r["word"] for r in used.select("word").collect())
        model = Model(terms, clean_words)
        points = features(rows, model).select("features", "toxic").toPandas()  # at most max_training rows of five numbers
        model.weights = fit_logistic(np.array(points["features"].tolist(), float), (points["toxic"] > 0).to_numpy(float))
        return model
    finally:
        rows.unpersist()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps; the bias (last weight) is not shrunk."""
    x = np.column_stack((x, np.ones(len(x))))
    shrink = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + shrink, x.T @ (y - p) - shrink @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1, higher: more toxic); null and empty texts get the score of no hits.

    Every row is scored, repeats included; a column named score or features
    is replaced.
    """
    hits = features(docs, model, text_col)
    *weights, bias = [float(w) for w in model.weights]
    line = F.lit(bias)
    for k, w in enumerate(weights):
        line = line + F.lit(w) * F.col("features")[k]
    return hits.withColumn("score", 1 / (1 + F.exp(-line))).drop("features")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    model = learn(docs, labels)
    keep = docs.columns
    scored = score(docs.withColumnsRenamed({c: f"_row_{c}" for c in ("score", "features") if c in keep}), model, text_col)
    return (scored.where(F.col("score") < threshold).drop("score")
            .withColumnsRenamed({f"_row_{c}": c for c in ("score", "features") if c in keep}).select(keep))
