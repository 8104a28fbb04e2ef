"""Pandas UDFs (D1, D2).  Kept in a module without postponed annotations
so Spark can read the ``pd.Series`` type hints."""

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def stem_udf():
    """Accent folding + Porter stem of a token column (vocabulary only)."""
    from treeline.operators.text_index import fold_and_stem

    @F.pandas_udf("string")
    def _stem(s: pd.Series) -> pd.Series:
        return s.map(fold_and_stem)

    return _stem


def encoder_udf(encoder_factory: Callable[[], Callable]):
    """Iterator pandas UDF; the encoder is built once per Python worker
    and receives Arrow batches of texts."""

    @F.pandas_udf("array<float>")
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder_factory()
        for s in batches:
            yield pd.Series(list(enc(s.fillna("").tolist())))

    return _encode
