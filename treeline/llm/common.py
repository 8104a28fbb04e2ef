"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import discard, ensure_checkpoint_dir, materialize, release, scratch_path, ship_package

__all__ = ["prepare", "read", "row_udf", "sha256_hex", "materialize", "discard", "release", "scratch_path", "tokenizer_path",
           "BATCH_ROWS"]

#: Rows of one Arrow batch.  Texts can be long, so batches stay small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """What every operator here needs of the session: the package on the
    workers, a shared folder for written stages, small Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (driver or worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def row_udf(make: Callable[[], Callable], schema: str, arrow: pa.DataType):
    """A scalar Arrow UDF with one result row for each text.

    ``make()`` runs once per task and returns ``row(text) -> dict``; a null
    text reaches it as None.  Marked nondeterministic so that Catalyst
    evaluates it exactly once, also when a filter reads its result.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row = make()
        for batch in batches:
            yield pa.array([row(x) for x in batch.to_pylist()], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()
