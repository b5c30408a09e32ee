"""Benchmark decontamination with a generalised suffix automaton.

Documents are streamed through an automaton of the normalised test items;
words inside any occurrence of an item window are hit.  Hit spans are cut
out of the text, and a document of which more than a limit is hit goes
whole.

Scale: the documents are read once per benchmark block, without a shuffle.
The benchmark is the stated query set: it is cut into blocks of a bounded
number of words, and each block's automaton is broadcast on its own, so what
is sent to a task does not grow with the data.  With one block (up to
``BLOCK_WORDS`` words) nothing is shuffled at all; with several, the hits of
the blocks are merged per document.

A null text has no words; null and wordless items have no window.  Repeated
item ids count once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.rows import KEY, with_key
from hourglass.llm.suffix_automaton import ItemAutomaton
from hourglass.session import materialize

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

HITS = ("n_words long, n_hit long, items array<string>, "
        "spans array<struct<start: long, stop: long, from_char: long, to_char: long>>")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def hit_words(text: str | None, automaton: ItemAutomaton) -> tuple[np.ndarray, set]:
    """Which words of the text lie in a window, and the items found."""
    words = words_of(text)
    hit, found = np.zeros(len(words), bool), set()
    automaton.scan(words, hit, found)
    return hit, found


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def spans_of(text: str | None, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words by word number, and the characters that they take in the text (ends exclusive)."""
    runs = _runs(hit)
    if not runs:
        return []
    data = text.encode("utf-8")
    place = [m.span() for m in _WORD.finditer(data)]
    return [{"start": a, "stop": b, "from_char": len(data[:place[a][0]].decode("utf-8")), "to_char": len(data[:place[b - 1][1]].decode("utf-8"))}
            for a, b in runs]


def merge_spans(spans: list) -> list[dict[str, int]]:
    """The union of spans of one text; spans that touch become one."""
    out: list[dict[str, int]] = []
    for s in sorted(({k: s[k] for k in ("start", "stop", "from_char", "to_char")} for s in spans), key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            if s["stop"] > out[-1]["stop"]:
                out[-1]["stop"], out[-1]["to_char"] = s["stop"], s["to_char"]
        else:
            out.append(s)
    return out


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """Yield one automaton per block; items are dealt to blocks by a hash of their id.

    Only one block's items are on the driver at a time.
    """
    n_words = F.coalesce(F.length("text"), F.lit(0)) / 2 + 1  # no text has more words than this
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(n_words)).first()[0] or 0
    n = max(1, int(np.ceil(total / block_words)))
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield ItemAutomaton([(r["item_id"], words_of(r["text"])) for r in block.toLocalIterator()], window)


def _scan(docs: DataFrame, automaton: ItemAutomaton, text_col: str) -> DataFrame:
    """Append ``hits`` (word count, hit word count, item ids, runs of hit words) by one automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hit, found = hit_words(text, shared.value)
            rows.append((len(hit), int(hit.sum()), sorted(x for x in found if x is not None),
                         spans_of(text, hit)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    # not to be evaluated once for a filter on the hits and once for the hits
    return docs.withColumn("hits", scan.asNondeterministic()(F.col(text_col)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with a struct ``hits`` (it replaces a column of that name).

    ``hits``: ``n_words``, ``n_hit``, ``items`` (sorted ids of the items with
    an occurring window) and ``spans`` (runs of hit words, by word number
    and by character).
    Items without an id match words but name no item.  Every row is returned,
    repeats included; an empty benchmark hits nothing.
    """
    docs = docs.drop("hits")
    automata = blocks_of(benchmark, block_words, window)
    first = next(automata)
    out = _scan(docs, first, text_col)
    rest = [materialize(_scan(with_key(docs.select(id_col, text_col), id_col, F.col(text_col)).dropDuplicates(KEY), a, text_col)
                        .where("hits.n_hit > 0").select(*KEY, "hits"), "block-hits") for a in automata]
    if not rest:
        return out
    more = rest[0]
    for r in rest[1:]:
        more = more.unionByName(r)
    more = more.groupBy(KEY).agg(F.collect_list("hits").alias("_row_more"))  # one entry per block

    @F.pandas_udf(HITS)
    def merge(own: pd.DataFrame, others: pd.Series) -> pd.DataFrame:
        rows = []
        for n_words, items, spans, other in zip(own["n_words"], own["items"], own["spans"], others, strict=True):
            blocks = list(other) if other is not None else []
            merged = merge_spans([x for part in (spans, *(b["spans"] for b in blocks)) for x in part])
            names = set(items).union(*(b["items"] for b in blocks))
            rows.append((n_words, sum(x["stop"] - x["start"] for x in merged), sorted(names), merged))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return (with_key(out, id_col, F.col(text_col)).join(more, KEY, "left")
            .withColumn("hits", merge("hits", "_row_more")).drop(*KEY, "_row_more"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents (same columns) with all hit spans cut out of their texts.

    A document with more than ``max_coverage`` of its words hit goes whole.
    Documents without a hit are returned unchanged, null texts included.
    """
    columns = docs.columns
    found = find_contamination(docs, benchmark, id_col, text_col, window)

    kept = found.where(F.col("hits.n_hit") <= max_coverage * F.col("hits.n_words"))
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("hits.spans.to_char"))
    end = F.concat(F.col("hits.spans.from_char"), F.array(F.length(text_col).cast("long")))
    parts = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda p: F.col(text_col).substr((p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    rest = F.when(F.col("hits.n_hit") == 0, F.col(text_col)).otherwise(F.array_join(parts, ""))
    return kept.withColumn(text_col, rest).select(columns)
