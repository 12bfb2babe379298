"""Records from papers: by metadata, or from the responses of a responder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.noisy_json import bracketed, object_elements, object_map, strict_array
from paperlake.functions.paper import (
    abstract_of,
    filled_meta,
    journal_of,
    meta_map,
    render_prompt,
)
from paperlake.functions.records import last_wins, truthy
from paperlake.functions.vocab import UNKNOWN_SOURCE
from paperlake.operators.rows import one_row_each
from paperlake.session import sized_side

#: prompts (run_id, paper_id, attempt, issues, prompt) -> responses (run_id, paper_id, attempt,
#: response, error). A join, a pandas UDF or ``mapInPandas`` all fit.
Responder = Callable[[DataFrame], DataFrame]
#: Error of a paper for which an attempt brought no response row.
NO_RESPONSE = "no response"


def _optional(name: str, value: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(empty)


def _source(meta: Column) -> Column:
    return F.coalesce(meta["source"], F.lit(UNKNOWN_SOURCE))


def metadata_fields(text: Column, meta: Column) -> Column:
    """Record map of a paper: its non-empty metadata, abstract and journal."""
    return F.map_concat(
        filled_meta(meta),
        _optional("abstract", abstract_of(text)),
        _optional("journal", journal_of(text)),
    )


def metadata_records(papers: DataFrame) -> DataFrame:
    """``papers`` (run_id, paper_no, paper_id, url, text, meta) as one record each."""
    return papers.select(
        "run_id", "paper_no", F.lit(0).alias("element_no"), "paper_id",
        metadata_fields(F.col("text"), F.col("meta")).alias("fields"),
        F.coalesce("url", F.lit("")).alias("source_url"), _source(F.col("meta")).alias("source"),
    )


def prompts(
    papers: DataFrame, runs: DataFrame, window: int | None = None, attempts: int = 1, first: int = 0,
    issues: DataFrame | None = None,
) -> DataFrame:
    """(run_id, paper_id, attempt, issues, prompt) for every selected paper and each of ``attempts`` attempts from
    ``first`` on, over whole texts unless a window is given.

    ``issues`` (run_id, issues) tells what the runs' last attempt lacked.
    """
    asked = runs.select("run_id", F.col("fields").alias("_requested"))
    if issues is None:
        asked = asked.withColumn("issues", F.array().cast("array<string>"))
    else:
        asked = asked.join(issues.select("run_id", "issues"), "run_id", "left")
    tries = F.explode(F.array(*[F.lit(first + k) for k in range(attempts)]).cast("array<int>"))
    return papers.join(sized_side(asked), "run_id").withColumn("attempt", tries).select(
        "run_id", "paper_id", "attempt", "issues",
        render_prompt(F.col("_requested"), F.col("text"), window=window, issues=F.col("issues")).alias("prompt"),
    )


def landed_responses(responses: DataFrame) -> Responder:
    """Default responder: look the answers to exactly the asked attempts up in a landed table."""
    keys = ["run_id", "paper_id", "attempt"]

    def respond(asked: DataFrame) -> DataFrame:
        return responses.join(asked.select(*keys), keys, "left_semi")

    return respond


def _with_objects(responses: DataFrame) -> DataFrame:
    # One column per step: Spark keeps a costly column that later steps use several times,
    # whereas one nested expression would parse the response again for each use.
    return (
        responses.withColumn("_body", bracketed(F.col("response")))
        .withColumn("_texts", strict_array(F.col("_body")))
        .withColumn("_objects", object_elements(F.col("_body"), F.col("_texts")))
        .drop("_body", "_texts", "response")
    )


def response_objects(responses: DataFrame, keep: list[str]) -> DataFrame:
    """One row per object element of each response's array, with ``element_no``.

    Elements that are not objects are dropped. ``keep`` names the columns to carry.
    """
    return (
        one_row_each(_with_objects(responses), keep, F.col("_objects"), "_o")
        .withColumn("_map", object_map(F.col("_o.text")))
        .select(
            *keep, F.col("_o.no").alias("element_no"),
            last_wins(F.map_entries("_map")).alias("fields"),
        )
    )


def back_fill(record: Column, meta: Column) -> Column:
    """Record with each metadata value set where the record has none.

    A false JSON value of the record is replaced; an empty metadata value still adds its key.
    """
    missing = F.map_filter(meta, lambda k, _: ~truthy(record[k]))
    kept = F.map_filter(
        record, lambda k, v: ~F.map_contains_key(meta, k) | truthy(v)
    )
    return F.map_concat(kept, missing)


def one_response(responses: DataFrame) -> DataFrame:
    """One response per run, paper and attempt: one without an error before others, then the smallest."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("_late"), "response", "error")).alias("_one")
    return responses.groupBy("run_id", "paper_id", "attempt").agg(best).select(
        "run_id", "paper_id", "attempt", "_one.response", "_one.error"
    )


def with_attempts(papers: DataFrame, responses: DataFrame, attempt: int | None = None) -> DataFrame:
    """(run_id, paper_id, attempt, response, error, answered) for each paper and ``attempt``, or else every attempt
    that the run has a response for; attempt 0 without any.

    Only keys meet the attempts of their run, whose table is broadcast if its measured size allows.
    """
    keys = ["run_id", "paper_id", "attempt"]
    slim = papers.select("run_id", "paper_id")
    if attempt is None:
        made = responses.groupBy("run_id").agg(F.collect_set("attempt").alias("_attempts"))
        known = F.coalesce(F.when(F.size("_attempts") > 0, F.col("_attempts")), F.array(F.lit(0)))
        asked = slim.join(sized_side(made), "run_id", "left").select("run_id", "paper_id", F.explode(known).alias("attempt"))
    else:
        asked = slim.withColumn("attempt", F.lit(attempt))
    answers = one_response(responses).withColumn("answered", F.lit(True))
    return asked.join(answers, keys, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def response_records(papers: DataFrame, responses: DataFrame, attempt: int | None = None) -> DataFrame:
    """Records of every paper and attempt from its response; see :func:`with_attempts`.

    A paper yields one record per object element, back-filled from its metadata; when there is
    no object or no response, a record of its metadata only; when the response is an error, the
    record that :func:`metadata_records` would give.
    """
    keys = ["run_id", "paper_id"]
    whole = papers.select(*keys, "paper_no", "text", "meta", F.coalesce("url", F.lit("")).alias("source_url"))
    answered = with_attempts(papers, responses, attempt).join(whole, keys)
    failed = F.col("error").isNotNull()
    exploded = (
        _with_objects(answered)
        .select(
            *keys, "attempt", "paper_no", "source_url", "meta", failed.alias("_failed"),
            F.when(failed, F.col("text")).alias("_failed_text"),
            F.explode_outer(F.when(~failed, F.col("_objects"))).alias("_o"),
        )
        .withColumn("_map", object_map(F.col("_o.text")))
        .withColumn("_record", last_wins(F.map_entries("_map")))
        .withColumn("_meta", meta_map(F.col("meta")))
    )
    fields = (
        F.when(F.col("_failed"), metadata_fields(F.col("_failed_text"), F.col("meta")))
        .when(F.col("_record").isNull(), F.col("_meta"))
        .otherwise(back_fill(F.col("_record"), F.col("_meta")))
    )
    return exploded.select(
        "run_id", "attempt", "paper_no", F.coalesce("_o.no", F.lit(0)).alias("element_no"),
        "paper_id", fields.alias("fields"), "source_url", _source(F.col("meta")).alias("source"),
    )


def response_errors(papers: DataFrame, responses: DataFrame, attempt: int | None = None) -> DataFrame:
    """(run_id, stage, ref, message) for every failed response, and every one that is missing."""
    asked = with_attempts(papers, responses, attempt).withColumn(
        "error", F.when(~F.col("answered"), NO_RESPONSE).otherwise(F.col("error"))
    ).where(F.col("error").isNotNull())
    failed = asked.join(papers.select("run_id", "paper_id", "url"), ["run_id", "paper_id"])
    return failed.select(
        "run_id", F.lit("extract").alias("stage"), F.col("paper_id").cast("string").alias("ref"),
        F.format_string("Extract %s: %s", F.substring("url", 1, 40), F.col("error")).alias("message"),
    )
