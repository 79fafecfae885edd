"""Batch inference over prompts, and model replies to ballots."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv

EVENT_STRUCT = (
    "struct<event_ord:bigint,event_type:string,start_time:string,end_time:string,"
    "stated_utc_offset:string,affected:string,confidence:string,evidence:string>"
)
REPLY_SCHEMA = (
    "firm string, post_key string, voter string, ballot_ord int, model_ord int, attempt int, "
    "raw string, error string"
)
_REQUIRED = ("event_type", "start_time", "end_time")
_OPTIONAL = ("stated_utc_offset", "affected", "evidence")
_THINK = r"(?s)<think>.*?</think>"
_FENCE = r"^```(?:json)?\s*|\s*```$"
_ENDS = r"^\s+|\s+$"


def _problem(raw: str) -> str | None:
    """Why a reply is not a valid list of windows; decides on the repair attempt only."""

    def fits(item: object) -> bool:
        return (
            isinstance(item, dict)
            and all(isinstance(item.get(k), str) for k in _REQUIRED)
            and item["event_type"] in fv.EVENT_TYPES
            and item.get("confidence", "high") in ("high", "low")
            and all(isinstance(item.get(k), str | None) for k in _OPTIONAL)
        )

    text = re.sub(_ENDS, "", re.sub(_FENCE, "", re.sub(_ENDS, "", re.sub(_THINK, "", raw))))
    problem = "no JSON array found"
    for candidate in (text, text[text.find("[") : text.rfind("]") + 1]):
        try:
            items = json.loads(candidate)
        except ValueError as error:
            problem = str(error)
            continue
        if isinstance(items, list) and all(map(fits, items)):
            return None
        problem = "an element does not have the required fields"
    return problem


def infer(
    prompts: DataFrame,
    voters: Sequence[tuple[str, Sequence[str]]],
    make_client: Callable[[], Callable[[str, str], str]],
) -> DataFrame:
    """Ask every voter for every prompt; one row per call, a failed call is a row with ``error``.

    ``voters``: (name, models in order).  ``make_client`` runs once per task and returns
    ``complete(prompt, model) -> text``.  An invalid reply is followed by one repair attempt, a failed
    call by the next model.
    """
    panel = [(name, list(models)) for name, models in voters]
    listed = F.array(*[F.lit(name) for name, _ in panel])
    calls = prompts.select("firm", "post_key", "prompt", F.posexplode(listed).alias("ballot_ord", "voter"))
    calls = calls.repartition("firm", "post_key", "voter")  # calls are slow: every task gets its share of them

    def ask(complete: Callable[[str, str], str], prompt: str, models: list[str]) -> Iterator[tuple]:
        for model_ord, model in enumerate(models):
            request = prompt
            for attempt in (1, 2):
                try:
                    raw = complete(request, model)
                except Exception as error:  # noqa: BLE001 - a failed call is a row, never an exception
                    yield model_ord, attempt, None, str(error)
                    break
                problem = _problem(raw)
                yield model_ord, attempt, raw, None
                if problem is None:
                    return
                request = f"{prompt}\nYour last reply was not valid ({problem}). Send only the corrected array.\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_client()
        models = dict(panel)
        columns = ["firm", "post_key", "voter", "ballot_ord", "model_ord", "attempt", "raw", "error"]
        for batch in batches:
            rows = [
                (r.firm, r.post_key, r.voter, r.ballot_ord, *answer)
                for r in batch.itertuples(index=False)
                for answer in ask(complete, r.prompt, models[r.voter])
            ]
            yield pd.DataFrame(rows, columns=columns)

    return calls.mapInPandas(run, REPLY_SCHEMA)


def _typed(item: Column, field: str) -> Column:
    """The JSON type of a field: NULL when absent, VOID for null, STRING for text."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _text(item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", "string")


def _read_array(text: Column) -> Column:
    """Array of windows in ``text``, or NULL when it is no array or any element is invalid."""
    value = F.try_parse_json(text)
    items = F.try_variant_get(value, "$", "array<variant>")

    def valid(item: Column) -> Column:
        ok = F.schema_of_variant(item).startswith("OBJECT")
        for field in _REQUIRED:
            ok = ok & F.coalesce(_typed(item, field) == "STRING", F.lit(False))
        for field in _OPTIONAL:
            ok = ok & F.coalesce(_typed(item, field).isin("STRING", "VOID"), F.lit(True))
        confidence = F.when(_typed(item, "confidence").isNull(), F.lit("high")).otherwise(
            F.coalesce(_text(item, "confidence"), F.lit(""))
        )
        ok = ok & confidence.isin("high", "low")
        return ok & F.coalesce(_text(item, "event_type").isin(*fv.EVENT_TYPES), F.lit(False))

    def event(item: Column, n: Column) -> Column:
        return F.struct(
            n.cast("bigint").alias("event_ord"),
            *[_text(item, f).alias(f) for f in _REQUIRED],
            *[_text(item, f).alias(f) for f in ("stated_utc_offset", "affected")],
            F.coalesce(_text(item, "confidence"), F.lit("high")).alias("confidence"),
            _text(item, "evidence").alias("evidence"),
        )

    is_array = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(is_array & F.forall(items, valid), F.transform(items, event)).cast(
        f"array<{EVENT_STRUCT}>"
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies with ``events`` (NULL when invalid) and ``error``.

    Reasoning blocks and code fences are dropped; prose around the array is cut away when the text as
    a whole is not a valid array.  One bad element voids the whole reply.
    """
    text = F.regexp_replace(F.regexp_replace(F.col("raw"), _THINK, ""), _ENDS, "")
    text = F.regexp_replace(F.regexp_replace(text, _FENCE, ""), _ENDS, "")
    cleaned = replies.withColumn("_text", text)
    start = F.instr("_text", "[")
    stop = F.length("_text") - F.instr(F.reverse("_text"), "]") + 1
    inner = F.when((start > 0) & (stop > start), F.substring("_text", start, stop - start + 1))
    found = cleaned.withColumn("_whole", _read_array(F.col("_text"))).withColumn(
        "events", F.coalesce("_whole", F.when(F.col("_whole").isNull(), _read_array(inner)))
    )
    return found.withColumn(
        "error",
        F.when(F.col("events").isNotNull(), F.lit(None)).otherwise(F.coalesce("error", F.lit("invalid reply"))),
    ).drop("_text", "_whole")


def resolve_replies(replies: DataFrame) -> DataFrame:
    """One ballot per (post, voter): the first valid reply by model and attempt, else abstained.

    An abstained ballot has NULL ``events`` and the last error; an empty list is an answer.
    """
    order = F.struct("model_ord", "attempt")
    return (
        parse_replies(replies)
        .groupBy("firm", "post_key", "voter", "ballot_ord")
        .agg(
            F.min_by("events", F.when(F.col("events").isNotNull(), order)).alias("events"),
            F.max_by("error", F.when(F.col("events").isNull(), order)).alias("_error"),
        )
        .withColumn("error", F.when(F.col("events").isNull(), F.col("_error")))
        .drop("_error")
    )
