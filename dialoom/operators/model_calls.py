"""External model calls as a partition-wise map with an injected client, retries and a stub.

The client is a factory, built once per partition; calls retry with doubling pauses. Answers of
earlier runs are skipped by an anti-join, so a repeated job asks only for what is missing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str], str]


class Retryable(Exception):
    """A failure of the service that may pass."""


def call(client: Client, prompt: str, attempts: int = 3, pause: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error) after at most ``attempts`` tries."""
    for i in range(attempts):
        try:
            return client(prompt), None
        except Retryable as e:
            error = str(e)
            if i + 1 < attempts:
                sleep(pause * 2**i)
    return None, error


def answers(prompts: DataFrame, make_client: Callable[[], Client], done: DataFrame | None = None, attempts: int = 3, pause: float = 30.0) -> DataFrame:
    """(key, answer, error) of prompts(key, prompt); keys in ``done`` are not asked again."""
    if done is not None:
        prompts = prompts.join(done.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = [(k, *call(client, p, attempts, pause)) for k, p in batch[["key", "prompt"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["key", "answer", "error"], dtype=object)

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")


def stub() -> Client:
    """A client without a network: answers with the length of the prompt as JSON."""
    return lambda prompt: json.dumps({"answer": f"{len(prompt)} characters"})
