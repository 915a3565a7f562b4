"""Runs of a question set: answers and judgements by functions that are given, where a failure is a row and not the run's end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.files import resumed

#: Fixed value: what marks the error of a judgement.
JUDGE_ERROR = "[JUDGE ERROR]"


_ANSWERED = "qid string, question string, model_answer string, error string"


def _answers(answer: Callable[[str], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, failed = [], []
            for question in batch["question"]:
                try:
                    said.append(answer(question))
                    failed.append(None)
                except Exception as error:  # noqa: BLE001  whatever fails becomes a row
                    said.append(f"[ERROR] {error}")
                    failed.append(f"{type(error).__name__}: {error}")
            yield batch.assign(model_answer=said, error=failed)

    return run


def answered(cases: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """``cases`` (qid, question) with model_answer and error; an exception's answer is marked, and its error is kept."""
    return cases.select("qid", "question").mapInPandas(_answers(answer), _ANSWERED)


def answered_in_steps(cases: DataFrame, answer: Callable[[str], str], path: str, batch: int = 20) -> DataFrame:
    """The same, kept below ``path`` every ``batch`` questions; a run that was stopped goes on from there."""
    return resumed(cases.select("qid", "question"), path, _answers(answer), _ANSWERED, batch)


def _own_errors() -> Column:
    """A row's error without the lines of earlier judgements; null where nothing is left."""
    lines = F.filter(F.split(F.coalesce("error", F.lit("")), "\n"), lambda x: ~F.contains(x, F.lit(JUDGE_ERROR)))
    return F.nullif(F.trim(F.array_join(lines, "\n")), F.lit(""))


def unjudged(results: DataFrame) -> DataFrame:
    """Results that still need a judgement: there is an answer and none of its judgements stands."""
    return results.filter("judge is null and coalesce(model_answer, '') <> ''")


def judged(results: DataFrame, judge: Callable[[str, str], tuple[int, str]]) -> DataFrame:
    """``results`` (qid, question, model_answer, judge, error) with missing judgements filled in.

    What is judged stays as it is; errors of earlier judgements are dropped, and a new one is a line of the row's error.
    """
    kind = "qid string, overall int, error_type string, failed string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for qid, question, text in zip(batch["qid"], batch["question"], batch["model_answer"], strict=True):
                try:
                    out.append((qid, *judge(question, text), None))
                except Exception as error:  # noqa: BLE001  whatever fails becomes a row
                    out.append((qid, None, None, f"{JUDGE_ERROR} {type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["qid", "overall", "error_type", "failed"]).astype({"overall": "Int32"})

    new = unjudged(results).select("qid", "question", "model_answer").mapInPandas(run, kind)
    rows = results.join(new, "qid", "left")
    found = F.when(F.col("judge").isNotNull(), F.col("judge")).when(F.col("overall").isNotNull(), F.struct("overall", "error_type"))
    return rows.select("qid", "question", "model_answer", found.alias("judge"), F.nullif(F.concat_ws("\n", _own_errors(), "failed"), F.lit("")).alias("error"))
