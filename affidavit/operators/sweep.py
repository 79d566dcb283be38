"""One look at every document for a question, by a scorer that the caller gives.

A scorer takes (text, question) and returns (relevance 0-3, facts).  The one
given here is a stand-in that needs no model: it counts the question's words.
A document whose scorer raises becomes a row with the error, to be taken as unread.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

KEEP, EVIDENCE = 2, 160
Scorer = Callable[[str, str], tuple[int, list[str]]]


def word_scorer(text: str, question: str) -> tuple[int, list[str]]:
    """Relevance by the share of the question's words that the text holds; facts are the lines that hold most of them."""
    words = {w for w in re.findall("[a-zà-ÿ0-9]+", question.lower()) if len(w) > 1 and w not in STOP_WORDS}
    held = {w for w in re.findall("[a-zà-ÿ0-9]+", text.lower()) if w in words}
    share = len(held) / len(words) if words else 0.0
    score = lambda s: len(words & set(re.findall("[a-zà-ÿ0-9]+", s.lower())))
    lines = [(-score(s), k, s.strip()) for k, s in enumerate(text.split("\n"))]
    return (0 if not held else 1 if share < 0.34 else 2 if share < 0.67 else 3), [s for n, _, s in sorted(lines)[:6] if n]


def sweep(documents: DataFrame, question: str, scorer: Scorer = word_scorer, parallel: int | None = None) -> DataFrame:
    """(doc_id, relevance, facts, error) of every document (doc_id, text); ``parallel`` bounds the calls at once."""
    docs = documents.select("doc_id", "text")
    if parallel:
        docs = docs.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    relevance, facts = scorer(text or "", question)
                    rows.append((d, int(relevance), list(facts), None))
                except Exception as e:  # the error is the row
                    rows.append((d, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "relevance", "facts", "error"]).astype({"relevance": "Int64"})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInPandas(run, f"doc_id {kind}, relevance long, facts array<string>, error string")


def kept_units(facts: DataFrame, units: DataFrame, most: int | None = EVIDENCE) -> DataFrame:
    """The live units that facts (doc_id, relevance, k, unit_id) of relevance KEEP or more name, each once, the first ``most``."""
    live = units.where(~F.coalesce("redacted", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("doc_id", "k"))
    wanted = facts.where(F.col("relevance") >= KEEP).select("unit_id", F.col("doc_id").alias("from_doc"), "k", place.alias("r")).where("r = 1")
    kept = live.join(wanted.drop("r"), "unit_id").orderBy("from_doc", "k", "unit_id")
    return (kept.limit(most) if most is not None else kept).drop("from_doc", "k")
