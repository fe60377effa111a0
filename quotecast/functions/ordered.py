"""Row order within keys: positions, previous rows and carried values.

One window per key puts a whole key into one task. That is done only for series,
whose rows per key the calendar bounds. Raw rows are range-sorted on (keys, order),
so a hot key spreads over many tasks, and a hot row too: rows equal in everything are
dealt out by where they come from. Each task scans its sorted rows once, for all
columns together, and notes what its first and last key leave open; those few rows, two a task,
carry counts and values from task to task. No row is shuffled a second time.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quotecast.functions.columns import join_on_keys
from quotecast.functions.lineage import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def neighbours(df, keys, order_by, column, bounded=False):
    """Add to every row, in the order given within keys:

    ``_pos``   row number from 0;
    ``_back``  struct(pos, v) of the last non-null value at or before the row;
    ``_ahead`` struct(pos, v) of the first non-null value at or after the row;
    ``_lag``   value of the row before, NULL included.

    Rows equal in the order are told apart by all their other columns, so the result
    is the same for any layout of the table. ``bounded``: the caller vouches that a
    key has few rows, as a series has.
    """
    if bounded:
        return _scan(df, list(keys), _order(df, keys, order_by), column)
    near = F.col("_near")[column]
    found = near_rows(df, keys, order_by, [column])
    return found.withColumns({f"_{x}": near[x] for x in ("back", "ahead", "lag")}).drop("_near")


def _order(df, keys, order_by):
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    named = {*keys, *[c for c in order_by if isinstance(c, str)]}
    return order + [F.col(f.name) for f in df.schema if f.name not in named and _orderable(f.dataType)]


def _orderable(kind):
    return not any(name in kind.simpleString() for name in ("map<", "variant"))


def near_rows(df, keys, order_by, columns):
    """Add ``_pos`` and ``_near``, a struct with back, ahead and lag (see ``neighbours``) of each column.

    One range sort serves all columns. The sort samples its input first, so an
    input that is dear to compute is best written before. A task holds back rows only while
    the next known value of a column is open, at most those of its own part.
    """
    by = [*[F.col(k) for k in keys], *_order(df, keys, order_by)]
    laid_out = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_tie")
    laid_out = laid_out.sortWithinPartitions(*by).drop("_tie")
    kinds = {c: df.schema[c].dataType for c in columns}
    scanned = checkpoint(laid_out.mapInArrow(_scanner(df.schema, list(keys), columns), _scanned_type(df.schema, kinds)))
    rows = scanned.where(F.col("_edge").isNull()).drop("_edge")
    edges = scanned.where(F.col("_edge").isNotNull()).select(*keys, "_chunk", "_edge")
    return _stitch_edges(rows, edges, list(keys), kinds)


def _point_type(kind):
    return T.StructType([T.StructField("pos", T.LongType()), T.StructField("v", kind)])


def _scanned_type(schema, kinds):
    near = [T.StructField(c, T.StructType([
        T.StructField("back", _point_type(k)), T.StructField("ahead", _point_type(k)), T.StructField("lag", k)])) for c, k in kinds.items()]
    edge = [T.StructField(c, T.StructType([
        T.StructField("first", _point_type(k)), T.StructField("last", _point_type(k)), T.StructField("tail", k)])) for c, k in kinds.items()]
    return T.StructType([
        *(T.StructField(f.name, f.dataType) for f in schema.fields),  # edge rows have no other columns
        T.StructField("_chunk", T.IntegerType()),
        T.StructField("_pos", T.LongType()),
        T.StructField("_near", T.StructType(near)),
        T.StructField("_edge", T.StructType([T.StructField("rows", T.LongType()), *edge])),
    ])


def _scanner(schema, keys, columns):
    """The scan of one task's sorted rows, for mapInArrow."""
    kinds = {c: schema[c].dataType for c in columns}
    out = to_arrow_schema(_scanned_type(schema, kinds))
    names = [f.name for f in schema.fields]

    def scan(batches):
        part = TaskContext.get().partitionId()
        state = {"key": None, "rows": 0, "first": {}, "last": {}, "tail": {}}
        held, seen_first = [], False

        def edge_row(now):
            edge = {"rows": now["rows"], **{c: {k: now[k].get(c) for k in ("first", "last", "tail")} for c in columns}}
            key = dict(zip(keys, now["key"]))
            arrays = [pa.array([key[n]], out.field(n).type) if n in key else pa.nulls(1, out.field(n).type) for n in names]
            arrays += [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, out.field("_near").type)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([edge], out.field("_edge").type)], schema=out)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = _key_starts([batch.column(k) for k in keys], state["key"], n)
            cuts = [0, *(int(x) for x in np.flatnonzero(starts) if x), n]
            goes_on = not starts[0]
            segment = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            first = np.array(cuts[:-1])[segment]
            base = np.where(segment == 0, state["rows"] if goes_on else 0, 0)
            pos = np.arange(n) - first + base
            near = {c: _near(batch.column(c), pos, first, np.array(cuts[1:])[segment], goes_on, state, c) for c in columns}
            # What earlier rows of the key still wait for.
            for c in columns:
                head = near[c]["known"][: cuts[1]].nonzero()[0] if goes_on else []
                for row in held:
                    if goes_on and len(head):
                        _settle(row["near"][c], int(pos[head[0]]), batch.column(c)[int(head[0])])
                    elif not goes_on or len(cuts) > 2:
                        row["near"][c]["open"][:] = False
            for a, b in zip(cuts, cuts[1:]):
                if a or not goes_on:
                    if state["key"] is not None and not seen_first:
                        yield edge_row(state)
                        seen_first = True
                    state = {"key": [batch.column(k)[a].as_py() for k in keys], "rows": 0, "first": {}, "last": {}, "tail": {}}
                for c in columns:
                    known = near[c]["known"][a:b].nonzero()[0]
                    if len(known):
                        i, j = a + int(known[0]), a + int(known[-1])
                        state["first"].setdefault(c, {"pos": int(pos[i]), "v": batch.column(c)[i].as_py()})
                        state["last"][c] = {"pos": int(pos[j]), "v": batch.column(c)[j].as_py()}
                    state["tail"][c] = batch.column(c)[b - 1].as_py()
                state["rows"] += b - a
            held.append({"batch": batch, "pos": pos, "near": near})
            while held and not any(held[0]["near"][c]["open"].any() for c in columns):
                yield _emit(held.pop(0), names, columns, part, out)
        for row in held:
            yield _emit(row, names, columns, part, out)
        if state["key"] is not None:
            yield edge_row(state)

    return scan


def _key_starts(columns, last, n):
    """Whether each row starts a key; ``last`` is the key before the batch, None at the start."""
    new = np.zeros(n, bool)
    new[0] = last is None or any(c[0].as_py() != x for c, x in zip(columns, last))
    for c in columns:
        if n > 1:
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (nulls[1:] != nulls[:-1])
    return new


def _near(column, pos, first, end, goes_on, state, name):
    """Of every row of a batch: the last known value up to it, the next known one from it, the value before it."""
    n = len(column)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.arange(n)
    back = np.maximum.accumulate(np.where(known, at, -1))
    back = np.where(back >= first, back, -1)
    ahead = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    open_ = (ahead >= end) & (end == n)  # the key may go on in the next batch
    ahead = np.where(ahead < end, ahead, -1)
    carried = state["last"].get(name) if goes_on else None
    tail = state["tail"].get(name) if goes_on else None
    values = pa.concat_arrays([column, pa.array([carried["v"] if carried else None, tail], column.type)])
    places = np.append(pos, carried["pos"] if carried else 0)
    use_carried = (back < 0) & (first == 0) & (carried is not None)
    back = np.where(use_carried, n, back)
    lag = np.where(at > first, at - 1, np.where((at == 0) & goes_on, n + 1, -1))
    return {
        "known": known, "open": open_,
        "back": (_taken(pa.array(places), back), _taken(values, back)),
        "ahead": (_taken(pa.array(pos), ahead), _taken(column, ahead)),
        "lag": _taken(values, lag),
    }


def _taken(values, index):
    return values.take(pa.array(index, mask=index < 0))


def _settle(near, pos, value):
    """Rows that waited for a next known value get it."""
    if near["open"].any():
        mask = pa.array(near["open"])
        where, v = near["ahead"]
        near["ahead"] = (pc.if_else(mask, pa.scalar(pos, pa.int64()), where), pc.if_else(mask, value, v))
        near["open"] = np.zeros(len(near["open"]), bool)


def _emit(row, names, columns, part, out):
    batch, pos, n = row["batch"], row["pos"], len(row["pos"])
    near_type = out.field("_near").type

    def point(pair, kind):
        return pa.StructArray.from_arrays(list(pair), fields=list(kind), mask=pair[0].is_null())

    structs = []
    for c in columns:
        kind, near = near_type.field(c).type, row["near"][c]
        structs.append(pa.StructArray.from_arrays(
            [point(near["back"], kind.field("back").type), point(near["ahead"], kind.field("ahead").type), near["lag"]], fields=list(kind)))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(x) for x in names), pa.array(np.full(n, part, np.int32)), pa.array(pos.astype(np.int64)),
         pa.StructArray.from_arrays(structs, fields=list(near_type)), pa.nulls(n, out.field("_edge").type)], schema=out)


def _stitch_edges(rows, edges, keys, kinds):
    """Carry counts and values between the tasks that share a key: two rows a task."""
    by = keys or [F.lit(0)]
    chain = Window.partitionBy(*by).orderBy("_chunk")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    later = chain.rowsBetween(1, Window.unboundedFollowing)

    def shifted(c, offset):
        return F.when(c.isNotNull(), F.struct((c["pos"] + offset).alias("pos"), c["v"].alias("v")))

    offset = F.col("_offset")
    edges = edges.withColumn("_offset", F.coalesce(F.sum("_edge.rows").over(earlier), F.lit(0)))
    carried = [
        F.struct(
            F.last(shifted(F.col("_edge")[c]["last"], offset), ignorenulls=True).over(earlier).alias("back"),
            F.first(shifted(F.col("_edge")[c]["first"], offset), ignorenulls=True).over(later).alias("ahead"),
            F.lag(F.col("_edge")[c]["tail"]).over(chain).alias("lag"),
        ).alias(c)
        for c in kinds
    ]
    edges = edges.select(*keys, "_chunk", "_offset", F.struct(*carried).alias("_carry"))
    joined = join_on_keys(rows, F.broadcast(edges), [*keys, "_chunk"], "left")
    start, moved = F.col("_pos") == 0, F.coalesce(offset, F.lit(0))
    near = [
        F.struct(
            F.coalesce(shifted(F.col("_near")[c]["back"], moved), F.col("_carry")[c]["back"]).alias("back"),
            F.coalesce(shifted(F.col("_near")[c]["ahead"], moved), F.col("_carry")[c]["ahead"]).alias("ahead"),
            F.when(start, F.col("_carry")[c]["lag"]).otherwise(F.col("_near")[c]["lag"]).alias("lag"),
        ).alias(c)
        for c in kinds
    ]
    return joined.withColumns({"_near": F.struct(*near), "_pos": F.col("_pos") + moved}).drop("_offset", "_carry", "_chunk")


def _scan(df, part, order, column):
    by = part or [F.lit(0)]
    rows = Window.partitionBy(*by).orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Looking ahead runs backwards: a frame that grows is scanned once, one that
    # shrinks would be scanned again for every row.
    after = Window.partitionBy(*by).orderBy(F.desc("_pos")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    here = F.when(
        F.col(column).isNotNull(),
        F.struct(F.col("_pos").alias("pos"), F.col(column).alias("v")),
    )
    return (
        df.withColumn("_pos", F.row_number().over(rows).cast("long") - 1)
        .withColumn("_here", here)
        .withColumn("_lag", F.lag(column).over(rows))
        .withColumn("_back", F.last("_here", ignorenulls=True).over(before))
        .withColumn("_ahead", F.last("_here", ignorenulls=True).over(after))
    )


def carry_forward(back=None, ahead=None):
    """Last known value; leading gaps take the first known one."""
    back, ahead = _ends(back, ahead)
    return F.coalesce(back["v"], ahead["v"])


def carry_back(back=None, ahead=None):
    """Next known value; trailing gaps take the last known one."""
    back, ahead = _ends(back, ahead)
    return F.coalesce(ahead["v"], back["v"])


def blend(back=None, ahead=None):
    """Straight line by position between the known neighbours; ends are carried."""
    back, ahead = _ends(back, ahead)
    inside = back.isNotNull() & ahead.isNotNull() & (ahead["pos"] > back["pos"])
    step = (ahead["v"] - back["v"]) / F.nullif(ahead["pos"] - back["pos"], F.lit(0))
    return F.when(inside, back["v"] + step * (F.col("_pos") - back["pos"])).otherwise(
        F.coalesce(back["v"], ahead["v"])
    )


def _ends(back, ahead):
    return F.col("_back") if back is None else back, F.col("_ahead") if ahead is None else ahead
