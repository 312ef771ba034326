from __future__ import annotations

import pandas as pd
import pytest

from pastward.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(name="pastward-tests")


@pytest.fixture
def hourly(spark):
    """Make a Spark series table from lists: {series: values} on consecutive hours, or (hours, values) pairs."""

    def make(series: dict, **columns):
        frames = []
        for key, values in series.items():
            hours, values = values if isinstance(values, tuple) else (range(len(values)), values)
            frame = pd.DataFrame({"series_id": key, "hours": list(hours), "Consumption": [float(v) if v is not None else None for v in values]})
            frames.append(frame)
        pdf = pd.concat(frames, ignore_index=True)
        pdf["timestamp"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(pdf.pop("hours"), unit="h")
        for name, function in columns.items():
            pdf[name] = function(pdf)
        fields = ", ".join(
            f"{name} {'string' if name == 'series_id' else 'timestamp_ntz' if name == 'timestamp' else 'double'}" for name in pdf
        )
        shuffled = pdf.sample(frac=1.0, random_state=7)
        rows = [tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row) for row in shuffled.itertuples(index=False)]
        return spark.createDataFrame(rows, fields)

    return make
