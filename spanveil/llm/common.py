"""What the corpus operators share: tables in the shared scratch folder, keys, words."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as a regular-expression class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, one of our own, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spanveil-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the scratch folder: computed once, with no lineage before it.

    The table outlives lost executors.  It stays after a query, whose lazy result may still read
    it; ``alone`` removes what its result doesn't read.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/spanveil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the scratch folder, by the file system that it is on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def alone(spark: SparkSession, make, name: str) -> tuple[DataFrame, str]:
    """What ``make()`` gives as a written table, and its path; the tables written on the way are removed."""
    first = len(_made)
    out = written(make(), name)
    for path in _made[first:-1]:
        removed(spark, path)
    path = _made[-1]
    del _made[first:]
    # What a stage held on the driver (a sample, a compiled tokenizer) is of no use to the next.
    returned()
    return out, path


#: Bytes of an Arrow batch: texts differ by orders of magnitude in length, so rows are no measure.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bytes_in(size: str) -> int:
    """A size as Spark writes it (``64m``, ``1g``, ``4194304``, ``4mb``) in bytes."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([a-zA-Z]*)\s*", size).groups()
    return int(number) << 10 * " kmgtp".index(unit.lower().removesuffix("b")[:1] or " ")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` at most for what runs meanwhile; the session's own size comes back."""
    conf = spark.conf
    before = conf.get(BATCH_SETTING)
    lower = not 0 < bytes_in(before) <= BATCH_BYTES
    if lower:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if lower:
            conf.set(BATCH_SETTING, before)


def mapped(df: DataFrame, function, schema, name: str) -> DataFrame:
    """``df.mapInArrow(function, schema)`` as a written table, made in batches of ``BATCH_BYTES`` at most.

    A batch is held several times over, by the executor and by the Python worker of each core.
    """
    with small_batches(df.sparkSession):
        return written(df.mapInArrow(function, schema), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def square_root_cells(n: int) -> int:
    """A power of two near the square root of ``n``: as many cells as rows in each cell."""
    return 1 << max(0, (max(n, 1) - 1).bit_length() + 1 >> 1)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    large = pa.types.is_large_string(column.type)
    return [b"" if v is None else v for v in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


#: Rows that are worked on at a time, to keep the memory of a worker small.
SLICE = 512


def per_batch(build, columns: list[str], text: str = "text"):
    """A ``mapInArrow`` function: ``build(texts)`` gives the new columns of some rows, in order.

    Columns other than the text are passed on as they are.  With ``text = "row.text"`` the text is
    read from the struct column ``row``, which is passed on too.
    """
    outer, _, inner = text.partition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                kept = [n for n in batch.schema.names if inner or n != text]
                column = batch.column(batch.schema.names.index(outer))
                made = build(texts_of(column.field(inner) if inner else column))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.names.index(n)) for n in kept] + made, names=kept + columns
                )

    return run


class Kept(dict):
    """A bounded cache: ``make(key)`` for what it lacks, and the keys of the last two generations.

    When ``size`` keys are new, they become the old generation, and the one before is forgotten.
    """

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 256:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_held: dict[str, object] = {}


def returned() -> None:
    """Gives memory that is no longer used back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key: str, make):
    """A worker's one large object: that of another key is dropped first, as workers outlive a query."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
        returned()
    return _held[key]


#: The splitting pattern and the normalisation of the tokenizer files that are read here (fixed values of their format).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def word_end_file(path: str) -> dict:
    """A tokenizer file whose words carry an end mark and whose splitting drops white space; others are refused.

    Both the split into white-space separated strings and ``plain_pieces`` hold only for these.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    good = (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout") and not spec.get("decoder")
        and (spec.get("normalizer") or {}).get("normalizers") == NORMALISED
        and split[0].get("pattern") == {"Regex": SPLIT_PATTERN} and split[0].get("behavior") == "Removed" and split[0].get("invert")
        and [s.get("type") for s in split[1:]] == ["ByteLevel"] and not split[1].get("use_regex") and not split[1].get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not good:
        raise ValueError(f"{path} is no tokenizer file with word ends, a lower-casing normaliser and white space dropped")
    return spec


#: ``SPLIT_PATTERN`` for lower-case ASCII without white space.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def plain_pieces(raw: bytes) -> list[bytes] | None:
    """The pre-split words of an ASCII string without a special string; None if it isn't such a string."""
    return PIECES.findall(raw.lower()) if raw.isascii() and b"<|" not in raw else None
