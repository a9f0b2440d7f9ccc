"""One local session for all tests, with a shared folder of its own."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from silverloop import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    built = session.build("local[8]", "tests", **{"spark.checkpoint.dir": shared})
    built.sparkContext.setLogLevel("OFF")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column function over strings, in input order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, "i int, s string").select("i", fn(F.col("s")).alias("o"))
        out = [r.o for r in sorted(df.collect(), key=lambda r: r.i)]
        return [tuple(o) if hasattr(o, "asDict") else o for o in out]

    return run
