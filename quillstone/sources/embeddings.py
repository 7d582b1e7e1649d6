"""Vectors of texts from an HTTP service: batched, a bounded number of calls at once, failed batches tried again, zeros where that fails too."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


def embedded(texts: DataFrame, url: str, model: str, dim: int, batch: int = 32, at_once: int = 4, attempts: int = 3, pause: float = 0.2, timeout: float = 30.0, tasks: int | None = None) -> DataFrame:
    """(id, embedding, ok) of texts (id, content): a call sends {model, input: [texts]} and gets {embeddings: [[...]]}.

    tasks: tasks at most that call, so that the service gets no more than tasks * at_once calls at a time. A batch whose every try fails, or whose answer has another number of
    vectors, and a vector of another length, give zeros and ok = false. A null or blank text is not sent: zeros, ok = false. Each task holds at_once batches.
    """

    def call(some: list[str]) -> list[list[float] | None]:
        request = urllib.request.Request(url, json.dumps({"model": model, "input": some}).encode(), {"Content-Type": "application/json"})
        for n in range(attempts):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    got = json.load(answer)["embeddings"]
                if len(got) == len(some):
                    return [v if len(v) == dim else None for v in got]
            except (OSError, ValueError, KeyError, TypeError):
                pass
            if n + 1 < attempts:
                time.sleep(pause * 2**n)
        return [None] * len(some)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                for lo in range(0, len(f), batch * at_once):
                    part = f.iloc[lo : lo + batch * at_once]
                    said = [i for i, t in enumerate(part["content"]) if isinstance(t, str) and t.strip()]
                    groups = [said[k : k + batch] for k in range(0, len(said), batch)]
                    found: list[list[float] | None] = [None] * len(part)
                    for own, vectors in zip(groups, pool.map(lambda g: call([part["content"].iloc[i] for i in g]), groups), strict=True):
                        for i, v in zip(own, vectors, strict=True):
                            found[i] = v
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [[0.0] * dim if v is None else [float(x) for x in v] for v in found], "ok": [v is not None for v in found]})

    given = texts.select("id", "content")
    return (given.coalesce(tasks) if tasks else given).mapInPandas(run, f"id {dict(texts.dtypes)['id']}, embedding array<float>, ok boolean")
