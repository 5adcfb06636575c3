import glob
import os

import pytest

import __spark_entry__ as entry
from plumbline import queries as quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return made


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(quality.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert rows(quality.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(quality.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def smoothed(y, a, b, g, p):
    """Additive Holt-Winters, written from its recurrences: errors of one step and the next forecast."""
    level, trend = [sum(y[:p]) / p], [(sum(y[p:2 * p]) - sum(y[:p])) / p / p]
    season, errors = [v - level[0] for v in y[:p]], []
    for t, v in enumerate(y):
        errors.append(v - level[-1] - trend[-1] - season[t])
        level.append(a * (v - season[t]) + (1 - a) * (level[-1] + trend[-1]))
        trend.append(b * (level[-1] - level[-2]) + (1 - b) * trend[-1])
        season.append(g * (v - level[-1]) + (1 - g) * season[t])
    return errors, level[-1] + trend[-1] + season[len(y)]


def test_holt_winters_query(spark):
    """The only query without SQL: its verdicts follow from the recurrences with weights near the best of a fine grid."""
    assert set(quality.QUERIES) - set(quality.SQL) == {"anomaly_holt_winters", "series_online_normal_without_anomalies"}
    got = quality.QUERIES["anomaly_holt_winters"](spark, SF).orderBy("month").collect()
    values = [r["value"] for r in got]
    grid = [i / 10 for i in range(1, 10)]
    far = 0
    for i, r in enumerate(got):
        if i < 14:
            assert not r["normal"]
        elif i % 12 == 0:
            best = min((smoothed(values[:i], a, b, g, 7) for a in grid for b in grid for g in grid), key=lambda x: sum(e * e for e in x[0]))
            mean = sum(best[0]) / i
            bound = 1.96 * (sum((e - mean)**2 for e in best[0]) / i)**0.5
            off = abs(values[i] - best[1])
            if abs(off - bound) > 0.25 * bound:  # clear cases, as weights differ a little
                far += 1
                assert r["normal"] == (off <= bound)
    assert far >= 2
