"""Saving and loading of fitted models.

MLlib's models bring their own writers.  The library's own ones derive from
``StoredModel``: metadata as MLlib writes it (so pipelines can hold them), a small
state as a one-row Parquet table, and any larger tables as Parquet beside it.
Everything goes through Spark's writers into the given folder, which on a cluster is
a shared one.  ``load_model`` reads the class from the metadata, so one loader serves
every kind of model.
"""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


class StoredModel(Model, MLWritable, MLReadable):
    """A model that is rebuilt from a JSON state and named tables."""

    def _state(self) -> dict:
        """JSON values that rebuild the model."""
        raise NotImplementedError

    def _tables(self) -> dict[str, DataFrame]:
        """Parts whose size grows with the training data."""
        return {}

    @classmethod
    def _rebuilt(cls, state: dict, tables: dict[str, DataFrame]) -> "StoredModel":
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: StoredModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 - MLlib's name
        tables = self.model._tables()
        for name, table in tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        self.sparkSession.createDataFrame([(json.dumps(self.model._state()),)], "state string").coalesce(1) \
            .write.parquet(f"{path}/state")
        # the metadata come last: a folder without them is no model
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"tables": sorted(tables)})


class _Reader(MLReader):
    def __init__(self, cls: type[StoredModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StoredModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in metadata["tables"]}
        model = self.cls._rebuilt(state, tables)
        model._resetUid(metadata["uid"])
        return model


def load_model(spark: SparkSession, path: str):
    """The model saved at ``path``, of whatever kind."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def saved_models(spark: SparkSession, folder: str) -> list[str]:
    """Names of the models below ``folder``, oldest name first (those with complete metadata)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/metadata/_SUCCESS")))
