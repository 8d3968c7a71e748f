import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from tracewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ev(spark):
    """Value of a column expression over one row."""

    def run(make, *values):
        row = spark.createDataFrame([tuple(values) or (1,)], schema=[f"c{i}" for i in range(len(values) or 1)]) if all(v is not None for v in values) else None
        df = row if row is not None else spark.range(1)
        return df.select(make(*[F.col(f"c{i}") if row is not None else F.lit(v) for i, v in enumerate(values)]).alias("v")).first()["v"]

    return run


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a sorted list of dicts."""

    def read(df, *cols):
        out = [r.asDict(recursive=True) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda d: repr(sorted(d.items())))

    return read
