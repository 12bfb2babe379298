"""Extraction with conditional retries.

Every run is asked once. A run whose records score too low is asked again, with a note of what was lacking, up to a
number of retries; a run that scores well, or whose retries are used up, is settled by its last attempt. So the
papers sent to the responder shrink from attempt to attempt, and an attempt that no run needs is not asked at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators import extract, quality
from paperlake.session import materialise, sized_side


@dataclass
class Extracted:
    """Records of each run's accepted attempt, the marks of all attempts, the accepted (run_id, attempt), and errors."""

    records: DataFrame
    marks: DataFrame
    chosen: DataFrame
    errors: DataFrame


def extract_with_retries(
    runs: DataFrame, papers: DataFrame, responder: extract.Responder, window: int | None = None,
    retries: int = quality.MAX_RETRIES,
) -> Extracted:
    """Ask ``responder`` for all runs, then again only for those that score below the accepted score.

    Each attempt's responses, records and marks are written once: a responder may be costly, or give other answers when
    asked again. A run that gets no response row at all to a retry keeps its attempt before, since a landed table
    may hold fewer attempts than were allowed.
    """
    open_runs, issues = runs, None
    records, marks, errors = [], [], []
    for attempt in range(retries + 1):
        asked_papers = papers if not attempt else papers.join(sized_side(open_runs.select("run_id")), "run_id", "left_semi")
        asked = extract.prompts(asked_papers, open_runs, window, first=attempt, issues=issues)
        responses = materialise(responder(asked), "responses")
        if attempt:
            answered = materialise(responses.select("run_id").distinct(), "answered")
            if answered.isEmpty():
                break
            open_runs = open_runs.join(answered, "run_id", "left_semi")
            asked_papers = asked_papers.join(sized_side(answered), "run_id", "left_semi")
        own = materialise(extract.response_records(asked_papers, responses, attempt), "records")
        mark = quality.run_quality(own, open_runs, by_attempt=True)
        mark = materialise(mark.withColumn("attempt", F.lit(attempt)), "marks")
        records.append(own)
        marks.append(mark)
        errors.append(extract.response_errors(asked_papers, responses, attempt))
        issues = mark.where(F.col("score") < quality.ACCEPTED_SCORE)
        if issues.isEmpty():
            break
        open_runs = materialise(open_runs.join(issues, "run_id", "left_semi"), "open-runs")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    chosen = materialise(quality.select_attempts(union(marks), retries), "chosen")
    accepted = union(records).join(sized_side(chosen), ["run_id", "attempt"], "left_semi")
    return Extracted(accepted, union(marks), chosen, union(errors))
