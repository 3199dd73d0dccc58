import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelwatch.config import PanelSpec  # noqa: E402
from panelwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_segments(spark):
    """Makes every group of more than ``rows`` rows a large one."""

    def use(rows):
        spark.conf.set("panelwatch.segmentRows", str(rows))

    yield use
    spark.conf.unset("panelwatch.segmentRows")


SPEC = PanelSpec("k", ("v", "w"), "t", ("id",), period="cast(date_trunc('day', t) as timestamp_ntz)")


def panel_rows(n=400, seed=0, nulls=True):
    """One key holds over half of the rows, another is NULL; values have gaps, repeats and zeros."""
    rng = np.random.default_rng(seed)
    key = rng.choice([1.0, 2.0, 3.0, np.nan], n, p=[0.6, 0.2, 0.1, 0.1])
    v = np.round(rng.normal(10, 3, n), 1)
    v[rng.random(n) < 0.05] = 0.0
    if nulls:
        v[rng.random(n) < 0.15] = np.nan
    start = datetime(2024, 1, 1)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "k": key,
            "t": [start + timedelta(hours=int(h)) for h in rng.integers(0, 24 * 20, n)],
            "v": v,
            "w": rng.gamma(2.0, 5.0, n),
        }
    )


def to_spark(spark, rows):
    schema = "id long, k double, t timestamp_ntz, v double, w double"
    records = [
        tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r)
        for r in zip(rows["id"].tolist(), rows["k"].tolist(), [t.to_pydatetime() for t in rows["t"]],
                     rows["v"].tolist(), rows["w"].tolist())
    ]
    return spark.createDataFrame(records, schema)


@pytest.fixture(scope="session")
def rows():
    return panel_rows()


@pytest.fixture(scope="session")
def panel(spark, rows):
    return to_spark(spark, rows).repartition(5).persist()
