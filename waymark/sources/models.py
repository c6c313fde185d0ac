"""Models as sources: a caller's client or scorer over rows, once per task.

Interfaces only: no model is part of this library.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def post_json(url: str, payload: dict, timeout: float) -> dict:
    """The JSON answer to a JSON request; any other answer is an error."""
    data = json.dumps(payload, ensure_ascii=False).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def chat_client(url: str, model: str, timeout: float = 600, **options) -> Callable[[str], str]:
    """A client that sends one user message to a chat endpoint and returns its first answer."""

    def ask(prompt: str) -> str:
        answer = post_json(url, {"model": model, "messages": [{"role": "user", "content": prompt}], **options}, timeout)
        return answer["choices"][0]["message"]["content"]

    return ask


def completed(rows: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], concurrency: int = 4) -> DataFrame:
    """``rows`` with ``raw`` (the model's answer) and ``error`` (what it raised); one of the two is null.

    ``client()`` is called once per task and gives the function that answers a
    prompt; a task has at most ``concurrency`` prompts under way.  A null
    prompt is not sent and gives two nulls.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "raw string", "error string"])

    def run(batches: Iterable[pd.DataFrame]):
        ask = client()

        def one(text):
            if text is None:
                return None, None
            try:
                return ask(text), None
            except Exception as error:  # noqa: BLE001  whatever a client raises is the row's error
                return None, f"{type(error).__name__}:{error}"

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(one, batch[prompt]))
                yield batch.assign(raw=[x[0] for x in found], error=[x[1] for x in found])

    return rows.mapInPandas(run, schema)


def scored(rows: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[tuple[float, str]]]], batch: int = 16) -> DataFrame:
    """``rows`` with ``score`` (a margin) and ``completion`` of each prompt.

    ``load()`` runs once per task and gives the scorer of a list of prompts;
    it must answer each of them.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "score double", "completion string"])

    def run(batches: Iterable[pd.DataFrame]):
        score = load()
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            found = [x for a in range(0, len(prompts), batch) for x in score(prompts[a : a + batch])]
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} scores for {len(prompts)} prompts")
            yield pdf.assign(score=[float(x[0]) for x in found], completion=[x[1] for x in found])

    return rows.mapInPandas(run, schema)


def failed(rows: DataFrame) -> DataFrame:
    """Rows of ``completed`` that are to be asked again."""
    return rows.where(F.col("error").isNotNull())
