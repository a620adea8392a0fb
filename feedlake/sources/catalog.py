"""Feed catalog: a JSON array of ``name`` and ``url``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from feedlake import constants as C
from feedlake.schemas import FEED_SOURCE


def read_feed_catalog(
    spark: SparkSession, path: str, fallback: Sequence[tuple[str, str]] = C.FALLBACK_FEEDS, multi_line: bool = True
) -> DataFrame:
    """The catalog at ``path``; the ``fallback`` rows when nothing is there.

    ``multi_line`` reads one JSON array per file; switch it off for one object per line.
    """
    try:
        return spark.read.schema(FEED_SOURCE).option("multiLine", multi_line).json(path).select("name", "url")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(list(fallback), FEED_SOURCE)
