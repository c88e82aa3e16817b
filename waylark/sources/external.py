"""Calls of an external service, behind a table of recorded answers.

Without a network, answers come from a replay table keyed by the hash of the
request. A request that isn't recorded has status MISSING and no answer: success
is never made up. With a service, ``call`` takes a function that is tried again,
with a growing pause, on errors that may pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(requests: DataFrame, recorded: DataFrame, key: str = "input_hash") -> DataFrame:
    """Requests with response and status: OK, EMPTY (a recorded answer without content) or MISSING."""
    found = requests.join(recorded.select(key, "response", F.lit(True).alias("_there")), key, "left")
    status = F.when(F.col("_there").isNull(), "MISSING").when(F.coalesce(F.trim("response"), F.lit("")) == "", "EMPTY").otherwise("OK")
    return found.withColumn("status", status).drop("_there")


def call(requests: DataFrame, send: Callable[[str], str], key: str = "input_hash", text: str = "input", retries: int = 1, pause_s: float = 0.5, passing: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> DataFrame:
    """(key, response, status, attempts): each request sent, again on errors of a kind that may pass; others fail at once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                answer, status, tries = None, "ERROR", 0
                while tries <= retries:
                    tries += 1
                    try:
                        answer, status = send(t), "OK"
                        break
                    except passing:
                        time.sleep(pause_s * tries)
                    except Exception as e:  # noqa: BLE001 - told in the row
                        status = f"ERROR: {type(e).__name__}"
                        break
                rows.append((k, answer, status, tries))
            yield pd.DataFrame(rows, columns=[key, "response", "status", "attempts"])

    return requests.select(key, text).mapInPandas(run, f"{key} string, response string, status string, attempts int")


def repaired(results: DataFrame, invalid: str, second: DataFrame, key: str) -> DataFrame:
    """Results of which the invalid ones are replaced by a second answer where that is valid; else the first stays."""
    better = second.where(~F.col(invalid)).select(key, *[F.col(c).alias(f"_{c}") for c in results.columns if c != key])
    both = results.join(better, key, "left")
    use = F.col(invalid) & F.col(f"_{invalid}").isNotNull()
    return both.select(key, *[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in results.columns if c != key])
