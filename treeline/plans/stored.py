"""The stored index that the registered searches read.

A search is served from postings that were written before it.  The first one
over a table builds the index; later ones of the same application find it, as
long as the table's files (names, sizes, times) are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import segments
from treeline.session import path_exists, scratch_path

_BUILT: dict[tuple, str] = {}


def files_of(df: DataFrame) -> tuple:
    """Number, bytes, latest time and a digest of the names of a table's files."""
    m = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(m.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time"), F.sum(F.crc32(F.col("file_path").cast("binary")))).first())


def document_index(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the index over ``documents`` (field text)."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, files_of(docs))
    path = _BUILT.get(key)
    if path is None or not path_exists(spark, f"{path}/stats"):
        path = scratch_path(spark, "stage-index")
        segments.add_segment(spark, path, docs.select("doc_id", "text"))
        _BUILT[key] = path
    return path
