"""Running sums of a key's rows in an order, over range partitions, so that no key is held by one task.

Rows are sorted over range partitions of key and order.  A task goes through its stretch once,
holding one batch and one total; where a key goes on in the next stretch, what it has in the
stretches before (one or two rows of each) is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _stretch(names: list[str], key: str, sums: list[str], xors: list[str]):
    folds = {c: (np.add, np.subtract) for c in sums} | {c: (np.bitwise_xor, np.bitwise_xor) for c in xors}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, schema = None, None, None
        total, base = dict.fromkeys(folds, np.int64(0)), dict.fromkeys(folds, np.int64(0))
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(key).to_numpy(zero_copy_only=False)
                new = np.append(keys[:1] != last if last is not None else [True], np.diff(keys) != 0)
                at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
                values, whole = {}, {}
                for c, (fold, undo) in folds.items():
                    whole[c] = fold.accumulate(np.append(total[c], batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)))
                    values[c] = undo(whole[c][1:], np.where(at >= 0, whole[c][np.maximum(at, 0)], base[c]))
                starts = np.flatnonzero(new)
                if first is None and last is not None and len(starts):
                    first = (last, {c: folds[c][1](whole[c][starts[0]], base[c]) for c in folds})
                elif first is None and len(starts) > 1:
                    first = (keys[0], {c: values[c][starts[1] - 1] for c in folds})
                if len(starts):
                    base = {c: whole[c][starts[-1]] for c in folds}
                last, total = keys[-1], {c: whole[c][-1] for c in folds}
                schema = batch.schema
                arrays = [pa.array(values[n], pa.int64()) if n in folds else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column("stretch"), pa.array(np.zeros(len(keys), bool))], names=[*names, "stretch", "end"])
                stretch = batch.column("stretch")[0].as_py()
            if last is None:
                return
            ends = ([first] if first else []) + [(last, {c: folds[c][1](total[c], base[c]) for c in folds})]
            for k, values in ends:
                row = [pa.array([k], pa.int64()) if n == key else pa.array([values[n]], pa.int64()) if n in folds else pa.nulls(1, schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*row, pa.array([stretch], pa.int32()), pa.array([True])], names=[*names, "stretch", "end"])

    return run


def running(df: DataFrame, key: str, order: list, sums: list[str], xors: list[str], name: str) -> DataFrame:
    """``df`` with the long columns ``sums`` and ``xors`` replaced by their running values, the row itself included.

    ``key`` is a long column without nulls, ``order`` columns or names.  Written to the scratch folder.
    """
    names, folded = df.columns, [*sums, *xors]
    keys = [F.asc(key), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("stretch", F.spark_partition_id())
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields] + [T.StructField("stretch", T.IntegerType()), T.StructField("end", T.BooleanType())]
    made = written(placed.mapInArrow(_stretch(names, key, sums, xors), T.StructType(fields)), name)
    # One or two rows of each stretch.
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        made.where("end").select(
            F.col(key).alias("k"), F.col("stretch").alias("st"), F.count(F.lit(1)).over(before).alias("earlier"),
            *(F.sum(c).over(before).alias(f"before_{c}") for c in sums), *(F.bit_xor(c).over(before).alias(f"before_{c}") for c in xors),
        ).where("earlier > 0").drop("earlier")
    )
    joined = made.where("NOT end").join(F.broadcast(carried), (F.col(key) == F.col("k")) & (F.col("stretch") == F.col("st")), "left")
    add = {c: F.col(c) + F.coalesce(f"before_{c}", F.lit(0).cast("long")) for c in sums}
    add |= {c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0).cast("long"))) for c in xors}
    return joined.select(*(add[c].alias(c) if c in folded else F.col(c) for c in names))
