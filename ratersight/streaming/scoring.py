"""Incremental scoring: requests that have no result yet go, in batches, through a scorer that the caller gives."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ratersight.sources.files import pending

#: Prompts of one call of the scorer.
BATCH = 50


def stub(prompts: list[str], seed: int) -> list[str]:
    """A deterministic stand-in for a model: a rating of 0 to 6 from the prompt's checksum."""
    return [f'{{"rating": {zlib.crc32(p.encode(), seed) % 7}, "explanation": "stub"}}' for p in prompts]


def score(requests: DataFrame, scorer: Callable[[list[str], int], list[str]] = stub, batch: int = BATCH) -> DataFrame:
    """(key, run, body) of requests (key string, run int, prompt string); run is the seed. Null prompts count as empty."""

    def scored(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for run, own in frame.groupby("run"):
                for at in range(0, len(own), batch):
                    some = own.iloc[at : at + batch]
                    bodies = scorer([p if isinstance(p, str) else "" for p in some["prompt"]], int(run))
                    yield pd.DataFrame({"key": some["key"].to_numpy(), "run": some["run"].to_numpy(), "body": bodies})

    return requests.select("key", "run", "prompt").filter("run is not null").mapInPandas(scored, "key string, run int, body string")


def score_pending(requests: DataFrame, done: DataFrame, scorer: Callable[[list[str], int], list[str]] = stub) -> DataFrame:
    """Scores of the requests whose (key, run) is not done."""
    return score(pending(requests, done, ["key", "run"]), scorer)


def score_stream(requests: DataFrame, path: str, checkpoint: str, scorer: Callable[[list[str], int], list[str]] = stub, done: DataFrame | None = None) -> StreamingQuery:
    """Score what has arrived in a stream of requests and write it to Parquet at path, a folder for each batch.

    A request that comes again, in the same or a later batch or run, is scored once: the stream's state knows the requests
    that it has seen, so no batch reads earlier results. A batch that is repeated after a failure takes its own place. done:
    (key, run) of requests that others have scored."""

    def each(batch: DataFrame, number: int) -> None:
        own = batch if done is None else pending(batch, done, ["key", "run"])
        score(own, scorer).write.mode("overwrite").parquet(f"{path}/batch={number}")

    fresh = requests.dropDuplicates(["key", "run"])
    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
