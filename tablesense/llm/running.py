"""Running sums over the rows of keys, whatever share of all rows a key has."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.shared import partitions, stage


def running_sums(rows: DataFrame, key: str, order: Sequence[Column | str], sums: Sequence[str], name: str) -> DataFrame:
    """``rows`` with every column of ``sums`` (longs without nulls) replaced by its sum over the rows of the same ``key`` up to
    this one, in ``order``; as a written table. Null keys are one key.

    Rows are range-sorted by key and order, so that a key with many rows lies in several partitions. Each partition sums its own
    rows; what a key has in the partitions before is added from the partitions' last rows, which are as many as there are
    partitions and all that reaches the driver. Sums must stay within 63 bits.
    """
    kind = rows.schema[key].dataType.simpleString()
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    places = [rows.columns.index(c) for c in sums]
    at = rows.columns.index(key)

    def add(it):
        part = TaskContext.get().partitionId()
        last, carry, first_run, held = None, np.zeros(len(places), np.int64), True, None
        for batch in it:
            if not batch.num_rows:
                continue
            if held is not None:
                yield _with(held, names, np.zeros(held.num_rows, bool))
            keys = batch.column(at)
            new = np.zeros(batch.num_rows, bool)
            if batch.num_rows > 1:
                same = pc.if_else(pc.or_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])), pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])), pc.equal(keys[1:], keys[:-1]))
                new[1:] = ~np.array(same, bool)
            head = (keys[0].as_py(),)
            new[0] = last is not None and head != last
            starts = np.flatnonzero(new)
            run = np.cumsum(new)
            columns = list(batch.columns)
            for j, i in enumerate(places):
                total = np.cumsum(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.append(-carry[j], np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0))
                columns[i] = pa.array(total - before[run], pa.int64())
                carry[j] = total[-1] - before[run[-1]]
            first = (run == 0) & first_run
            first_run = bool(first_run and run[-1] == 0)
            last = (keys[-1].as_py(),)
            names = [*batch.schema.names, "__part", "__head"]
            held = pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(first)], names=names)
        if held is not None:
            end = np.zeros(held.num_rows, bool)
            end[-1] = True
            yield _with(held, names, end)

    fields = ", ".join(f"`{f.name}` {'bigint' if f.name in sums else f.dataType.simpleString()}" for f in rows.schema)
    summed = stage(dealt.mapInArrow(add, f"{fields}, __part int, __head boolean, __end boolean"), name)
    ends = summed.where("__end").select("__part", "__head", F.struct(key).alias("k"), *[F.col(c).alias(f"s{j}") for j, c in enumerate(sums)]).collect()
    carried, key_before, so_far = [], None, [0] * len(sums)
    for r in sorted(ends, key=lambda r: r["__part"]):
        carried.append((r["__part"], key_before[0] if key_before else None, key_before is not None, *so_far))
        own = [r[f"s{j}"] for j in range(len(sums))]
        # a partition of one key only adds to what that key has already
        so_far = [a + b for a, b in zip(own, so_far, strict=True)] if r["__head"] and key_before is not None and key_before == (r["k"][0],) else own
        key_before = (r["k"][0],)
    if not carried:
        return summed.drop("__part", "__head", "__end")
    carries = summed.sparkSession.createDataFrame(carried, f"__of int, __key {kind}, __any boolean, " + ", ".join(f"__s{j} long" for j in range(len(sums))))
    joined = summed.join(F.broadcast(carries), F.col("__part") == F.col("__of"))  # a row per partition
    goes_on = F.col("__head") & F.col("__any") & F.col(key).eqNullSafe(F.col("__key"))
    new = {c: F.when(goes_on, F.col(c) + F.col(f"__s{j}")).otherwise(F.col(c)) for j, c in enumerate(sums)}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def _with(batch: pa.RecordBatch, names: list[str], end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(end)], names=[*names, "__end"])
