"""URL filtering by rules and, where none fits, by logistic regression on hashed character n-grams.

Rules name a host (or a suffix of hosts at a dot) and a path prefix; the longest rule
that fits decides. The model learns from a small labelled URL table. Without one, the
URLs that the rules decide are the labelled table: a bounded sample of them, the
``SAMPLE`` rows with the smallest hashes of each verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cosecha.llm.tables import free_name

#: Labelled rows of each verdict that the model may learn from.
SAMPLE = 2000
BUCKETS = 1 << 14
SIZES = (2, 3, 4)


class Rule(NamedTuple):
    verdict: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


# The rules of the contract.
RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, by its name's length and then its name; null if none fits."""
    best = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.lit(rule.name)).otherwise(best)
    return best


def _features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the character n-grams of each host and path, marked by where they come from."""
    rows, buckets = [], []
    for tag, texts in ((1, hosts), (2, paths)):
        raw = [np.frombuffer(("^" + t + "$").encode(), np.uint8) for t in texts]
        sizes = np.array([len(r) for r in raw])
        data = np.concatenate(raw).astype(np.uint64) if raw else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        for n in SIZES:
            if len(data) < n:
                continue
            value = np.full(len(data) - n + 1, tag * 31 + n, np.uint64)
            for k in range(n):
                value = (value ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
            rows.append(owner[: len(owner) - n + 1][inside])
            buckets.append(((value[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64))
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(buckets or [np.empty(0, np.int64)])


class UrlModel:
    """Logistic regression; ``score`` is the chance of ``allow``."""

    def __init__(self, hosts: Sequence[str], paths: Sequence[str], allowed: Sequence[bool], rounds: int = 300, rate: float = 0.5, penalty: float = 1e-4) -> None:
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        truth = np.asarray(allowed, float)
        if len(truth) == 0 or truth.min() == truth.max():
            # One verdict only, or none: its own prior (allow if nothing is known).
            self.bias = 4.0 if len(truth) == 0 or truth.min() == 1 else -4.0
            return
        row, bucket = _features(hosts, paths)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(truth)), 1))
        balance = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean()))
        for _ in range(rounds):
            error = (1 / (1 + np.exp(-self._raw(row, bucket, scale))) - truth) * balance
            self.weights -= rate * (np.bincount(bucket, (error * scale)[row], BUCKETS) / len(truth) * 8 + penalty * self.weights)
            self.bias -= rate * error.mean()

    def _raw(self, row: np.ndarray, bucket: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weights[bucket], len(scale)) * scale + self.bias

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        row, bucket = _features(hosts, paths)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
        return 1 / (1 + np.exp(-self._raw(row, bucket, scale)))


def labelled_urls(urls: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> pd.DataFrame:
    """host, path and allowed of a bounded sample: of each verdict the ``sample`` rule-decided URLs of smallest hash."""
    verdicts = {r.name: r.verdict for r in rules}
    parts = []
    for verdict in ("allow", "block"):
        names = [n for n, v in verdicts.items() if v == verdict]
        some = urls.filter(F.col("rule").isin(names)).select("host", "path").distinct()
        some = some.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).toPandas()
        parts.append(some.assign(allowed=verdict == "allow"))
    return pd.concat(parts, ignore_index=True)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: pd.DataFrame | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), allow_score (null where a rule decides) and verdict.

    Columns of these names are replaced. A null or malformed url has an empty host and
    path and is judged by the model like any other.
    """
    added = ["host", "path", "rule", "verdict", "allow_score"]
    host, path = (free_name(n, pages.columns) for n in ("_host", "_path"))
    parsed = pages.withColumns({host: url_host(F.col(url)), path: url_path(F.col(url))}).drop(*added)
    parsed = parsed.withColumnsRenamed({host: "host", path: "path"}).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    known = labelled_urls(parsed.select("host", "path", "rule"), rules) if labelled is None else labelled
    model = UrlModel(known["host"].tolist(), known["path"].tolist(), known["allowed"].tolist())
    schema = StructType(parsed.schema.fields[:]).add("allow_score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, mask=np.array(batch.column("rule").is_valid()))], names=[*batch.schema.names, "allow_score"])

    by_rule = F.lit(None).cast("string")
    for rule in rules:
        by_rule = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(by_rule)
    by_model = F.when(F.col("allow_score") >= 0.5, "allow").otherwise("block")
    return parsed.mapInArrow(score, schema).withColumn("verdict", F.coalesce(by_rule, by_model))


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "allow_score")
