"""A list of questions in one run: for each, what a model would be given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .render import render_brief, render_documents, render_evidence
from .rollups import digest, stats
from .search import live, search_text
from .sweep import Scorer, sweep, word_scorer


def briefs(
    units: DataFrame, documents: DataFrame, questions: dict[str, str], scorer: Scorer = word_scorer, evidence: int = 40, parallel: int | None = None
) -> dict[str, str]:
    """The brief of every question by its name: the archive's numbers, the digest of a sweep, the nearest units.

    A brief is bounded by the digest's limits and by ``evidence`` (1 to 40); questions are few and run one after
    the other, each as Spark jobs over the whole archive.  A question that nothing fits has a brief without evidence.
    """
    texts = render_documents(documents, units).select("doc_id", F.col("rendered").alias("text"))
    numbers, out = stats(units, documents), {}
    for name, question in questions.items():
        looked = sweep(texts, question, scorer, parallel)
        facts = looked.select("doc_id", F.posexplode("facts").alias("k", "fact"))
        nearest = live(units).join(search_text(units, question, evidence).select("unit_id"), "unit_id", "left_semi")
        out[name] = render_brief(question, numbers, digest(looked.select("doc_id", "relevance"), documents, facts), render_evidence(nearest, documents))
    return out
