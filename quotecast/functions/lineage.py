"""Reliable lineage cuts that survive the loss of executors."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import types as T

_KEPT = set()


def shared_folder(spark):
    """This application's folder under ``spark.checkpoint.dir``, deleted when the application ends.

    Spark gives every application a folder of its own there, so no other one's files go.
    Only where the session names none and runs in local mode (tests) is a
    temporary folder set here, removed when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="quotecast-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    own = sc.getCheckpointDir()
    if own not in _KEPT:
        _KEPT.add(own)
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def checkpoint(df):
    """Write df to the shared folder and read it back.

    As Parquet: later steps read the columns they need only, and a small table is seen
    to be small by Spark's own size check. What Parquet cannot hold is checkpointed row by row.
    """
    folder = shared_folder(df.sparkSession)
    names = {c.lower() for c in df.columns}
    if len(names) < len(df.columns) or not _fits_parquet(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fits_parquet(kind):
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind}
        return 0 < len(kind) == len(names) and all(_fits_parquet(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _fits_parquet(kind.elementType)
    if isinstance(kind, T.MapType):
        return _fits_parquet(kind.keyType) and _fits_parquet(kind.valueType)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
