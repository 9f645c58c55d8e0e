"""Stages written as tables: each resumes from its table, and a manifest tells what is there."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Stages in the order they run.
STAGES = ("PREPARING", "COLLECTION", "PREPROCESSING", "NLP", "GEOLOCATION", "FILTERING", "EVENTS", "SCORING", "FINALIZING")
Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, no NaN: equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def redact(value: object, names: tuple[str, ...] = ("token", "secret", "password", "authorization")) -> object:
    """A log record without the values of secret fields, at any depth."""
    if isinstance(value, dict):
        return {k: "***" if any(n in k.lower() for n in names) else redact(v, names) for k, v in value.items()}
    return [redact(v, names) for v in value] if isinstance(value, list) else value


@dataclass
class Manifest:
    config: dict
    done: dict[str, str] = field(default_factory=dict)  # stage to the digest of its inputs and settings

    def to_json(self) -> str:
        return canonical_json(asdict(self))


class Pipeline:
    """Runs named stages in order; a stage whose digest stands in the manifest is read, not run again."""

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.stages: list[tuple[str, Stage]] = []
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = fs.Path(f"{self.folder}/manifest.json")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, name: str, stage: Stage) -> Pipeline:
        self.stages.append((name, stage))
        return self

    def manifest(self) -> Manifest:
        if not self._fs.exists(self._path):
            return Manifest(self.config)
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest.json").collect())
        return Manifest(**json.loads(text))

    def run(self, until: str | None = None) -> dict[str, DataFrame]:
        tables: dict[str, DataFrame] = {}
        manifest = self.manifest()
        before = digest(self.config)
        for name, stage in self.stages:
            before = digest([before, name])
            path = f"{self.folder}/{name.lower()}"
            if manifest.done.get(name) != before:
                stage(self.spark, dict(tables)).write.mode("overwrite").parquet(path)
                manifest.done[name] = before
                out = self._fs.create(self._path, True)
                out.write(bytearray(manifest.to_json().encode()))
                out.close()
            tables[name] = self.spark.read.parquet(path)
            if name == until:
                break
        return tables
