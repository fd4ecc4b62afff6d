"""Snapshot integrity and schema contracts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreledger.sources.stored import stored

# Files up to this length are hashed as one value; longer ones as they are read.
WHOLE_BYTES = 64 << 20
# Names that the line reader would unpack: those files are hashed as one value at any length.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|xz|lzo|passthrough)$"


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, length, sha256) of every file below ``path``, hashed where it is read and stored.

    The hash is a chain over all bytes, so a file is one task's.  Spark takes a file as
    one value below 2 GB only; long ones come in as lines cut at the byte 10, which go
    into the chain as they come, so a task holds some lines and never the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    at = F.col("_metadata.file_path")
    out = [F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "length"]
    whole = [*out, F.sha2("content", 256).alias("sha256")]
    short, long = files.filter(F.col("length") <= WHOLE_BYTES), files.filter(F.col("length") > WHOLE_BYTES)
    found = short.select(*whole).unionByName(long.filter(at.rlike(PACKED)).select(*whole))
    lined = long.filter(~at.rlike(PACKED)).select(at.alias("at"), *out)
    n = lined.count()
    if n:
        hashed = _line_digests(spark, path, glob)
        if len(hashed) != n:
            raise ValueError(f"{len(hashed)} of {n} long files below {path} were read")
        found = found.unionByName(lined.join(spark.createDataFrame(hashed, "at string, sha256 string"), "at").drop("at"))
    return stored(found, "digests")


def _line_digests(spark: SparkSession, path: str, glob: str) -> list:
    """(at, sha256) of long files, in a session that splits no file and puts each into a task of its own."""
    own = spark.newSession()
    for limit in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{limit}", str(2**60))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(WHOLE_BYTES))
    at = F.col("_metadata.file_path")
    lines = own.read.text(path, lineSep="\n", pathGlobFilter=glob).filter(
        (F.col("_metadata.file_size") > WHOLE_BYTES) & ~at.rlike(PACKED))
    return lines.select(
        at.alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"),
    ).mapInArrow(_hash_lines, "at string, sha256 string").collect()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files that come line after line, one file after the other.

    The line reader drops the byte between lines, and a byte order mark at the start: the
    length tells whether one was there, and a second chain is kept for that case.
    """
    at, size, seen, chains = None, 0, 0, ()

    def put(data) -> int:
        for c in chains:
            c.update(data)
        return len(data)

    def end() -> pa.RecordBatch:
        left = size - seen
        if left not in (0, 1, 3, 4):
            raise ValueError(f"{at}: read {seen} of {size} bytes")
        put(b"\n" * (left % 3))
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([chains[left // 3].hexdigest()])], ["at", "sha256"])

    for batch in batches:
        names, lines = batch.column(0), batch.column(2)
        runs = pc.run_end_encode(names)
        lo = 0
        for name, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name == at:
                seen += put(b"\n")
            else:
                if at is not None:
                    yield end()
                at, size, seen = name, batch.column(1)[lo].as_py(), 0
                chains = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
            run = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), lines.slice(lo, hi - lo))
            seen += put(pc.binary_join(run, b"\n")[0].as_buffer())
            lo = hi
    if at is not None:
        yield end()


def snapshot_violations(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose digest differs from the manifest, or that one side lacks."""
    want = manifest.select("file", F.col("sha256").alias("expected"))
    return (
        digests.select("file", F.col("sha256").alias("actual")).join(want, "file", "full")
        .filter(~F.col("actual").eqNullSafe(F.col("expected")))
    )


def schema_as_dict(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema}


def schema_violations(df: DataFrame, golden: dict[str, str]) -> list[str]:
    """Differences from a stored contract, including column order; empty when equal."""
    actual = schema_as_dict(df.schema)
    out = [f"missing column {c}" for c in golden if c not in actual]
    out += [f"unexpected column {c}" for c in actual if c not in golden]
    out += [
        f"{c}: expected {t}, got {actual[c]}" for c, t in golden.items()
        if c in actual and actual[c] != t
    ]
    if not out and list(actual) != list(golden):
        out.append("column order differs")
    return out
