"""From selected papers to merged records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators import extract, merge, quality
from paperlake.operators.encode import Encoder
from paperlake.plans.retries import Extracted, extract_with_retries
from paperlake.session import materialise, sized_side


@dataclass
class Collected:
    """Results of a harvest, all keyed by ``run_id``."""

    merged: DataFrame
    quality: DataFrame
    chosen: DataFrame
    errors: DataFrame


def run_papers(selected: DataFrame, corpus: DataFrame) -> DataFrame:
    """Selected (run_id, paper_no, paper_id) with url, text and metadata.

    The runs' caps bound the selection. It is written and measured; a small one is handed to the scan of the corpus, so no
    text of a paper that nobody selected leaves the task that read it.
    """
    chosen = materialise(selected.select("run_id", "paper_no", "paper_id"), "selected")
    return corpus.select("paper_id", "url", "text", "meta").join(sized_side(chosen), "paper_id")


def collect_records(
    runs: DataFrame,
    papers: DataFrame,
    responder: extract.Responder | None = None,
    encoder: Encoder | None = None,
    exact: bool = False,
    window: int | None = None,
    retries: int = quality.MAX_RETRIES,
) -> Collected:
    """Extract, score, choose attempts, normalise and deduplicate.

    Without a responder, records come from the papers' metadata and there is one attempt.
    ``window`` cuts the texts shown in prompts; a responder is asked again, up to ``retries`` times, for the runs whose
    records score too low (see :mod:`paperlake.plans.retries`).
    """
    if responder is None:
        records = materialise(extract.metadata_records(papers).withColumn("attempt", F.lit(0)), "records")
        marks = quality.run_quality(records, runs, by_attempt=True)
        errors = runs.limit(0).select("run_id", *[F.lit("").alias(c) for c in ("stage", "ref", "message")])
        done = Extracted(records, marks, quality.select_attempts(marks), errors)
    else:
        done = extract_with_retries(runs, papers, responder, window, retries)
    accepted = merge.normalised(done.records)
    if exact:
        merged = merge.exact_dedup(accepted, runs)
    else:
        merged = merge.similarity_dedup(accepted, runs, encoder)
    return Collected(merged, done.marks, done.chosen, done.errors)
