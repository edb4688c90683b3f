"""Versioned store of fitted detectors.

A version is a folder that is written once and never changed.  Which version is in force
is told by numbered pointer files; a pointer is created only when its version is complete,
and only if no other run has taken its number (the file system creates a file once).  A
save or a retraining that fails anywhere before that leaves the old version in force.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detectors


class ModelStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), where

    def _pointers(self) -> list[int]:
        fs, where = self._fs(f"{self.base}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _folder(self, number: int) -> str:
        return f"{self.base}/versions/" + self.spark.read.text(f"{self.base}/pointers/{number}").first()[0]

    def current(self) -> int:
        """The number of the version in force; 0 before the first."""
        return max(self._pointers(), default=0)

    def load(self, number: int | None = None):
        """(features, result) of a version, by default the one in force."""
        number = number or self.current()
        if number not in self._pointers():
            raise ValueError(f"no such version: {number}")
        return detectors.load_detectors(self.spark, self._folder(number))

    def save(self, training: detectors.Training, after: int | None = None) -> int:
        """Writes a new version and puts it in force; ``after``: the version that it was made from.

        Raises if another version has come into force since; the new folder is then left without a pointer."""
        after = self.current() if after is None else after
        name = uuid.uuid4().hex
        detectors.save_detectors(self.spark, training, f"{self.base}/versions/{name}")
        fs, where = self._fs(f"{self.base}/pointers/{after + 1}")
        try:
            out = fs.create(where, False)  # fails where the number is taken
        except Py4JJavaError as taken:
            raise RuntimeError(f"version {after + 1} was put in force by another run") from taken
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
        return after + 1

    def retrain(self, cluster_id: str, flows: DataFrame) -> int:
        """M5: refits one stored detector on new labelled flows, starting from its stored weights, as a new version."""
        after = self.current()
        fs, result = self.load(after)
        if cluster_id not in result.models:
            raise ValueError(f"no stored detector: {cluster_id}")
        attack = next(r[2] for r in result.rows if r[1] == cluster_id)
        side = F.lit(True) if attack == "Benign" else F.col("label").isin(attack, "Benign")
        labelled = flows.where(side).withColumn("y", (F.col("label") == attack).cast("int"))
        kinds = {r["y"] for r in labelled.select("y").distinct().collect()}
        if kinds != {0, 1}:
            raise ValueError(f"{cluster_id} needs rows of both classes, got {sorted(kinds)}")
        # the features of this detector only; the fit keeps them itself
        rows = detectors.featurize(fs, labelled).select(detectors.features_of(result.models[cluster_id][0]), "y")
        again = detectors.retrain(result, cluster_id, rows)
        return self.save(detectors.Training(fs, None, None, replace(again, rows=result.rows)), after)

    def versions(self) -> DataFrame:
        """(version, n_models, in_force)."""
        now = self.current()
        rows = [(n, self.spark.read.parquet(f"{self._folder(n)}/clusters").where("model_path is not null").count(), n == now)
                for n in self._pointers()]
        return self.spark.createDataFrame(rows, "version long, n_models long, in_force boolean")

    def vacuum(self, keep: int = 3) -> None:
        """Removes the folders of versions behind the newest ``keep`` and those that no pointer names."""
        kept = self._pointers()[-keep:]
        names = {self._folder(n).rsplit("/", 1)[1] for n in kept}
        fs, where = self._fs(f"{self.base}/versions")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)
        for n in set(self._pointers()) - set(kept):
            fs.delete(self._fs(f"{self.base}/pointers/{n}")[1], False)
