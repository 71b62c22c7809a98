"""Session-level helpers: where scratch tables may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_row(spark: SparkSession, schema: T.StructType, values: tuple) -> DataFrame:
    """A frame of one row and one partition, made without a Python worker."""
    return spark.range(0, 1, 1, 1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields, values, strict=True)])


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame without rows that the optimizer knows to be empty."""
    return one_row(spark, schema, (None,) * len(schema.fields)).where(F.lit(False))


def shared_scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor can reach; it is
    used as is.  Only a local-mode session without one (tests, laptops) gets
    a temporary directory, registered as its checkpoint dir.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            sc = spark.sparkContext
        except Exception:  # no SparkContext on this client (e.g. Spark Connect)
            sc = None
        if sc is not None:
            root = sc.getCheckpointDir()
            if not root:
                if not sc.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a shared folder for scratch tables")
                sc.setCheckpointDir(tempfile.mkdtemp(prefix="increload-ckpt-"))
                root = sc.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for scratch tables")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
