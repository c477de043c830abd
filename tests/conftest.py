import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strandline.session import build_session

    return build_session("tests", 8)


@pytest.fixture
def panel(spark):
    """Build a daily panel from {series: [values]}."""

    def build(series, start=dt.date(2020, 1, 1), schema="series_id string, ts date, value double"):
        rows = [(s, start + dt.timedelta(days=i), None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows[::-1], schema)

    return build


def column(df, name, series=None, order="ts"):
    """Values of one column in time order."""
    rows = [r for r in df.collect() if series is None or r["series_id"] == series]
    return [r[name] for r in sorted(rows, key=lambda r: r[order])]
