"""Intermediate tables in the cluster's shared folder, and numbering of sorted rows."""

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def folder(spark):
    """This application's folder under ``spark.checkpoint.dir``.

    Only a local session that names none (as tests do) gets a temporary folder,
    removed when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="llm-tables-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def written(df):
    """Write df as Parquet into the shared folder and read it back: a cut of lineage
    that outlives any executor and keeps column pruning."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def n_words(text):
    """Column: how many words ``[^\\x20\\x09-\\x0D]+`` a text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df, group, order, value, into):
    """Sum of ``value`` over the rows before each row in its group: column ``into``.

    Rows are range-sorted on (group, order), so a group that most rows share
    spreads over tasks. Each task sums its own run of every group and leaves one row
    with that run's total; prefix sums over those few rows join the runs. Null is
    a group of its own, last. The result is a table in the shared folder.
    """
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    schema = T.StructType(fields + [T.StructField("_part", T.IntegerType()), T.StructField("_sum", T.LongType()),
                                    T.StructField("_total", T.BooleanType())])
    names = [f.name for f in fields]

    def total(part, key, amount):
        data = [pa.array([key], out.field(x).type) if x == group else pa.nulls(1, out.field(x).type) for x in names]
        return pa.RecordBatch.from_arrays(data + [pa.array([part], pa.int32()), pa.array([amount], pa.int64()), pa.array([True])], schema=out)

    def add(batches):
        part, last, amount = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group)
            starts = np.flatnonzero(_starts([keys], last))
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(values) - values
            cuts = [0, *(int(x) for x in starts if x > 0), n]
            local = np.empty(n, np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if (a == 0 and len(starts) and starts[0] == 0) or a > 0:
                    if last is not None:
                        yield total(part, last[0], amount)
                    amount = 0
                local[a:b] = before[a:b] - before[a] + amount
                amount += int(values[a:b].sum())
                last = [keys[a].as_py()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names] + [pa.array(np.full(n, part, np.int32)), pa.array(local), pa.array(np.zeros(n, bool))], schema=out)
        if last is not None:
            yield total(part, last[0], amount)

    out = to_arrow_schema(schema)
    by = [F.col(group).asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in order)]
    table = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(add, schema))
    in_order = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = table.where("_total").select(
        F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(in_order), F.lit(0)).alias("_base"))
    return (
        table.where("not _total")
        .join(runs, (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
        .select(*names, (F.col("_base") + F.col("_sum")).alias(into))
    )


def _keys(batch, names):
    return [batch.column(n) for n in names]


def _starts(columns, last):
    """Whether each row's key differs from the row before; ``last`` is the key before the batch."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for i, c in enumerate(columns):
        new[0] |= last is None or c[0].as_py() != last[i]
        if n > 1:
            differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differ | (nulls[1:] != nulls[:-1])
    return new


def numbered(df, keys, ties, into, lead=None):
    """Name every distinct key by its place in sorted order, 1, 2, ...: column ``into``.

    Rows are range-sorted on keys and ties, so a key that many rows share spreads
    over tasks. Each task numbers its own run and leaves one row with its first
    and last key; prefix sums over those few rows join the runs. The keys' columns
    are dropped; the result is a table in the shared folder.

    Long keys can have a ``lead``, a column with a hash of them: the order is then
    (lead, a second hash, keys), and the tasks' ranges are cut by the hashes and ties alone,
    so that the sampling for those cuts moves no keys. Names still follow the keys themselves,
    and keys that share the lead are told apart. Only keys with both hashes equal, 128 bits,
    could have a name split by a cut; that would be raised, never passed on.
    """
    if lead:
        df = df.withColumn("_second", F.xxhash64(F.lit("second"), *(F.col(k) for k in keys)))
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    kept = [f for f in fields if f.name not in keys]
    kept = [f for f in kept if not lead or f.name not in (lead, "_second")]
    key_type = T.StructType([f for f in fields if f.name in keys])
    schema = T.StructType(
        kept
        + [T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())]
        + [T.StructField("_ends", T.ArrayType(key_type))]
    )
    names = [f.name for f in kept]
    key_names = [f.name for f in key_type.fields]

    def number(batches):
        part, count, first, last, last_lead = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _keys(batch, key_names)
            new = _starts(columns, last)
            if lead:
                hashes = _keys(batch, [lead, "_second"])
                if (new & ~_starts(hashes, last_lead)).any():
                    raise ValueError("two keys share both hashes: give another lead column")
                last_lead = [h[-1].as_py() for h in hashes]
            local = np.cumsum(new) + count
            first = first or [c[0].as_py() for c in columns]
            last = [c[-1].as_py() for c in columns]
            count = int(local[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names]
                + [pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64)), pa.nulls(n, ends_type)],
                schema=out,
            )
        if last is not None:
            ends = [dict(zip(key_names, first)), dict(zip(key_names, last))]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, out.field(x).type) for x in names]
                + [pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([ends], ends_type)],
                schema=out,
            )

    out = to_arrow_schema(schema)
    ends_type = out.field("_ends").type
    led = [lead, "_second"] if lead else []
    order = [F.col(c).asc_nulls_first() for c in [*led, *keys, *ties]]
    cuts = [F.col(c).asc_nulls_first() for c in [*(led or keys), *ties]]
    sorted_rows = df.repartitionByRange(*cuts).sortWithinPartitions(*order)
    table = written(sorted_rows.mapInArrow(number, schema))
    in_order = Window.orderBy("_part")  # a row for each task of the sort
    met = F.col("_ends")[0].eqNullSafe(F.lag(F.col("_ends")[1]).over(in_order)) & F.lag("_part").over(in_order).isNotNull()
    runs = (
        table.where(F.col("_ends").isNotNull())
        .select("_part", F.col("_local").alias("_size"), met.cast("long").alias("_met"))
        .select(
            F.col("_part"),
            (F.sum("_size").over(in_order) - F.col("_size") - F.sum("_met").over(in_order)).alias("_base"),
        )
    )
    return (
        table.where(F.col("_ends").isNull())
        .join(F.broadcast(runs), "_part")
        .select(*names, (F.col("_base") + F.col("_local")).alias(into))
    )
