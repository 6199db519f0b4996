"""Places where a model, a translator or a supervisor can be plugged in; by default nothing happens.

A Model takes a list of texts and returns as many answers (or None). It runs in Python workers, in
bounded batches, and is called again for a batch after a lost executor, so it must be repeatable.

Null texts are not asked about; answers without a JSON object give no fields; empty tables give empty
results; repeated rows are asked about as often as they occur.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X

Model = Callable[[list[str]], Sequence[str | None]]
_FIELDS = "map<string,string>"


def json_fields(text: Column) -> Column:
    """map<key, value> of a JSON object: the text as a whole, else what stands from its first brace to its last; NULL if neither is one."""
    whole = lambda t: F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(t, _FIELDS))
    return F.coalesce(F.when(F.size(whole(text)) > 0, whole(text)), whole(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def context_fields(text: Column) -> Column:
    """map<key, value> of a context given as JSON or as plain text, which is its event name."""
    return F.coalesce(json_fields(text), F.when(X.missing(text).isNotNull(), F.create_map(F.lit("event_name"), F.trim(text))))


def text_lines(text: Column, longer_than: int = 3, most_lines: int | None = None, most_chars: int | None = None) -> Column:
    """Trimmed lines of more characters than that, joined again; limits are the caller's."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > longer_than)
    out = F.array_join(F.slice(lines, 1, most_lines) if most_lines else lines, "\n")
    return F.left(out, F.lit(most_chars)) if most_chars else out


def enough_text(text: Column, kind: str) -> Column:
    """Whether a page holds enough text for its kind of source to be worth asking about."""
    return F.coalesce(F.length(F.trim(text)) >= D.PAGE_MINIMA[kind], F.lit(False))


def answers(rows: DataFrame, model: Model | None, batch: int = 64) -> DataFrame:
    """(id long, text) -> (id, answer); without a model no rows."""
    if model is None:
        return rows.sparkSession.createDataFrame([], "id long, answer string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for at in range(0, held.num_rows, batch):
                part = held.slice(at, batch)
                said = list(model(part.column("text").to_pylist()))
                if len(said) != part.num_rows:
                    raise ValueError("a model must give one answer a text")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(said, pa.string())], names=["id", "answer"])

    return rows.select(F.col("id").cast("long"), "text").filter("text is not null").mapInArrow(run, "id long, answer string")


def completed(rows: DataFrame, model: Model, enough: int = 3, kind: str = "reader") -> DataFrame:
    """Records (page_id, text, fields, extraction_method) with gaps filled by a model where fewer than `enough` core fields are known.

    Answers travel beside their rows, by a number given to each row, so repeated and null ids stay apart.
    """
    from .records import websearch_filled

    numbered = rows.withColumn("__id", F.xxhash64("page_id", "source_url", "text"))
    poor = numbered.filter((X.populated([F.col(f) for f in D.CORE_FIELDS]) < enough) & enough_text(F.col("text"), kind))
    asked = poor.select(F.col("__id").alias("id"), text_lines(F.col("text")).alias("text")).dropDuplicates(["id"])
    said = answers(asked, model).select(F.col("id").alias("__id"), json_fields(F.col("answer")).alias("f")).filter("f is not null")
    found = said.select("__id", *[F.try_element_at("f", F.lit(f)).alias(f) for f in D.MERGE_FIELDS])
    return websearch_filled(numbered, found, "__id", mark="+llm").drop("__id")


def retried(f: Callable[[str | None], object], attempts: int = 3, waits: Sequence[float] = (5.0, 10.0), sleep: Callable[[float], None] = time.sleep) -> object:
    """f(None), then f(the last error's text) until it succeeds; the last error is raised."""
    error: str | None = None
    for k in range(attempts):
        try:
            return f(error)
        except Exception as e:  # whatever a foreign call raises
            if k == attempts - 1:
                raise
            error = str(e)
            sleep(waits[min(k, len(waits) - 1)])
    raise ValueError("at least one attempt is needed")


def must_stop(queue_empty: bool, crawled: int, errors: int, batch: int = 500, most_errors: int = 30) -> bool:
    """Whether a crawl ends: nothing waits, ten batches are done, or too many errors occurred."""
    return queue_empty or crawled >= batch * 10 or errors > most_errors


def needs_supervisor(errors: int, phase: str) -> bool:
    return errors > 10 or (phase == "crawl" and errors > 5)


def supervised(state: dict, decide: Callable[[dict], str] | None = None) -> str:
    """What to do next: the supervisor's word if one is needed and given, else `continue`."""
    return decide(state) if decide is not None and needs_supervisor(state.get("errors", 0), state.get("phase", "")) else "continue"
