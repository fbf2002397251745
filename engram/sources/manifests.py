"""Numbered manifests of a folder: each is created in one step and never replaced."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has made this version."""


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def open(self, path: str):
        """(path object, its file system)"""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self.open(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(self.name(version)).collect()))

    def publish(self, version: int, manifest: dict) -> None:
        at, fs = self.open(self.name(version))
        # made beside its place and renamed, so no half a manifest is ever read
        draft, _ = self.open(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise VersionConflict(f"version {version} exists")
