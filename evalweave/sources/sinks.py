"""Writers: run records, ledgers, traces, the judge cache and text exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.identity import canonical, without_secrets

TTL_SECONDS = 24 * 3600


def write_json(path: str, document: object) -> None:
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n")


class LedgerWriter:
    """Appends canonical JSON lines; a new ledger must not exist, a resumed one must."""

    def __init__(self, path: str, header: Mapping, resume: bool = False):
        self.path = Path(path)
        if self.path.exists() != resume:
            raise FileExistsError(path) if not resume else FileNotFoundError(path)
        if not resume:
            self._append(header)

    def _append(self, line: Mapping) -> None:
        with self.path.open("a") as f:
            f.write(canonical(line) + "\n")

    def cell(self, **cell: object) -> None:
        self._append({"type": "cell"} | cell)


def write_trace(directory: str, trace: Mapping) -> str:
    """A redacted trace under its own digest; the file's name."""
    body = canonical(without_secrets(trace)[0])
    name = f"sha256-{hashlib.sha256(body.encode()).hexdigest()}.json"
    Path(directory).mkdir(parents=True, exist_ok=True)
    (Path(directory) / name).write_text(body)
    return name


def traces(samples: DataFrame, path: str) -> None:
    """Many traces (column trace as JSON text) as a table keyed by digest."""
    samples.select(F.concat(F.lit("sha256-"), F.sha2("trace", 256)).alias("digest"), "trace").dropDuplicates(["digest"]).write.mode("append").parquet(path)


def cache_key(judge: Column, prompt: Column, reference: Column, output: Column) -> Column:
    zero = F.lit("\0")
    return F.sha2(F.concat(judge, zero, prompt, zero, F.coalesce(reference, F.lit("")), zero, output), 256)


def cached(requests: DataFrame, cache: DataFrame, now_ms: int, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """requests (with key) and the newest answer that is younger than the time to live; null for a miss."""
    live = cache.where(F.lit(now_ms) - F.col("saved_at_ms") < ttl_seconds * 1000).groupBy("key").agg(F.max_by("answer", "saved_at_ms").alias("answer"))
    return requests.join(live, "key", "left")


def remember(answers: DataFrame, path: str) -> None:
    """Adds answers (key, answer, saved_at_ms) to a cache table."""
    answers.select("key", "answer", "saved_at_ms").write.mode("append").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text lines of a column line, as files."""
    lines.select("line").write.mode("overwrite").text(path)
