"""What keeps a Python worker small: short Arrow batches, and freed memory given back."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS, SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends at most BATCH_ROWS rows, and so a few megabytes of usual texts, in a batch between the JVM and a worker, on either side of which a batch is held whole."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(SETTING)) <= BATCH_ROWS:
        conf.set(SETTING, str(BATCH_ROWS))
    return df


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library, which returns memory by itself or not at all
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and what it keeps is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
