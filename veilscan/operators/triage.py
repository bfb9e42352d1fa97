"""Scorers of the caller: what they are told, what they answer, and what counts if they fail."""

from __future__ import annotations

import queue
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import suspicion
from .rollup import explanation

Scorer = Callable[[dict, list[dict]], tuple[int, str]]


def prompt(name: Column, signals: Column) -> Column:
    """The context text of an item: its name and a line per signal."""
    each = F.transform(signals, lambda s: F.concat(F.lit("- "), s["name"], F.lit(" (score "), s["score"].cast("string"), F.lit("): "), F.coalesce(s["detail"], F.lit(""))))
    told = F.when(F.size(signals) > 0, F.array_join(each, "\n")).otherwise("(no prior signals)")
    return F.concat(F.lit("File: "), name, F.lit("\nHeuristic signals:\n"), told)


def parse_reply(reply: Column) -> Column:
    """struct(score, explanation, error): a JSON object, or the first one without braces inside in other text.
    Scores are cut to whole numbers from 0 to 100, 0 if there is none."""
    # Fixed value: what counts as an object inside other text.
    inside = r"\{[^{}]*\}"
    value = F.coalesce(F.try_parse_json(reply), F.try_parse_json(F.regexp_extract(reply, inside, 0)))
    # anything but an object has no fields to take
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    raw = F.try_variant_get(value, "$.suspicion", "string")
    number = F.try_variant_get(value, "$.suspicion", "int")
    bad = F.when(value.isNull() | ~is_object, "no JSON object").when(raw.isNotNull() & number.isNull(), "score is no number")
    score = F.when(bad.isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number, F.lit(0)))))
    told = F.trim(F.coalesce(F.try_variant_get(value, "$.explanation", "string"), F.lit("")))
    return F.struct(score.cast("int").alias("score"), F.when(bad.isNull(), F.when(told == "", "(no explanation)").otherwise(told)).alias("explanation"), bad.alias("error"))


def answers(calls: list[Callable[[], object]], concurrent: int, limit: float, retries: int = 0) -> list[tuple[object, Exception | None]]:
    """(value, error) of every call, in order. At most ``concurrent`` run at once; a call that raises, or has not
    answered after ``limit`` seconds, is tried ``retries`` times more. Nothing can stop a thread that hangs: it is
    left behind and another one takes its place."""
    todo, done = queue.SimpleQueue(), queue.SimpleQueue()
    out: list[tuple[object, Exception | None]] = [(None, None)] * len(calls)
    waiting, running, left_behind, workers = deque((k, 0) for k in range(len(calls))), {}, set(), 0

    def work() -> None:
        while (job := todo.get()) is not None:
            key, call = job
            try:
                done.put((key, call(), None))
            except Exception as error:  # a call may fail in any way; its row says how
                done.put((key, None, error))
            if key in left_behind:
                return

    key = 0
    while waiting or running:
        while waiting and len(running) < concurrent:
            if workers <= len(running):
                threading.Thread(target=work, daemon=True).start()
                workers += 1
            k, tried = waiting.popleft()
            running[key] = (k, tried, time.monotonic() + limit)
            todo.put((key, calls[k]))
            key += 1
        ended = []
        try:
            number, value, error = done.get(timeout=max(0.0, min(r[2] for r in running.values()) - time.monotonic()))
            if number in running:  # else it came too late
                ended.append((number, value, error))
        except queue.Empty:
            late = [n for n, r in running.items() if r[2] <= time.monotonic()]
            left_behind.update(late)
            workers -= len(late)
            ended += [(n, None, TimeoutError(f"no answer within {limit:g} s")) for n in late]
        for number, value, error in ended:
            k, tried, _ = running.pop(number)
            if error is not None and tried < retries:
                waiting.append((k, tried + 1))
            else:
                out[k] = (value, error)
    for _ in range(workers):
        todo.put(None)
    return out


def triage(items: DataFrame, scorer: Scorer | None = None, concurrent: int = 8, limit: float = 60.0, retries: int = 0) -> DataFrame:
    """item_id, heuristic, suspicion, explanation, error of ``items`` (item_id, length, signals).

    A scorer is called for every row, ``concurrent`` calls at once in each task (it must bear that; 1 for one after
    the other), and its score, cut to 0..100, counts instead of the heuristic. If it raises, or has not answered after
    ``limit`` seconds, also not in ``retries`` further tries, suspicion is 0 and ``error`` says why; the heuristic
    stays beside it.
    """
    rows = items.withColumn("heuristic", suspicion(F.col("signals")))
    if scorer is None:
        return rows.select("item_id", "heuristic", F.col("heuristic").alias("suspicion"), explanation(F.col("signals")).alias("explanation"), F.lit(None).cast("string").alias("error"))

    def one(i: str, n: int, s: list) -> tuple[int, str]:
        score, told = scorer({"item_id": i, "length": n}, [dict(x) for x in s])
        return max(0, min(100, int(score))), str(told)

    @F.pandas_udf("struct<score:int,explanation:string,error:string>")
    def call(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = answers([partial(one, *row) for row in zip(*batch, strict=True)], concurrent, limit, retries)
            out = [(*value, None) if error is None else (0, None, f"{type(error).__name__}: {error}") for value, error in found]
            yield pd.DataFrame(out, columns=["score", "explanation", "error"])

    scored = rows.withColumn("_r", call("item_id", F.coalesce("length", F.lit(0)), "signals"))
    return scored.select("item_id", "heuristic", F.col("_r.score").alias("suspicion"), "_r.explanation", "_r.error")


class Detectors:
    """Detectors of the caller for ``rollup.findings``: name, extensions (none: every item) and a column function."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[tuple[str, ...] | None, Callable[[Column, Column], Column]]] = {}

    def register(self, name: str, detector: Callable[[Column, Column], Column], extensions: tuple[str, ...] | None = None) -> None:
        if not callable(detector):
            raise TypeError(f"{name}: a detector is a function of (ext, content) columns, not {type(detector).__name__}")
        if extensions is not None and not all(re.fullmatch(r"\.[^./]+", e) for e in extensions):
            raise ValueError(f"{name}: extensions start with a dot: {extensions}")
        self.known[name] = (extensions, detector)

    def columns(self) -> dict[str, tuple[tuple[str, ...] | None, Column]]:
        return {n: (e, f(F.col("ext"), F.col("content"))) for n, (e, f) in self.known.items()}
