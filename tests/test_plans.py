import datetime as dt
import random

import pytest

from quoinlake.operators.model import model_cases
from quoinlake.plans.lake import Lake
from quoinlake.plans.macro import enter_months, ingest_market, months as stored_months, seed_months
from quoinlake.plans.retrain import promote, retrain, version_in_force, versions_rmse
from quoinlake.plans.serve import not_yet_served, serve
from quoinlake.schemas import MACRO_MONTHLY, MARKET_RAW, RAW_LISTING
from quoinlake.sources.tables import overwrite_partitions
from quoinlake.streaming.landing import with_dt

DAY = dt.date(2025, 9, 1)


def listings(spark, day, n, price_factor=1.0):
    r = random.Random(day.toordinal())
    rows = []
    for i in range(n):
        area = r.randint(20, 120)
        unit = (40 + 30 * (i % 3)) * price_factor * r.uniform(0.9, 1.1)
        values = {
            "ad_id": f"{i}", "price": str(int(area * unit * 1e6)), "area": f"{area} m²", "district": f"Quận {i % 12 + 1}",
            "city": "Tp Hồ Chí Minh", "property_type": "Nhà ở" if i % 2 else "Đất", "url": f"/{i}",
            "bedrooms": None if i % 5 == 0 else str(i % 4 + 1), "interior": None if i % 3 else "full",
            "posted_at": str(dt.datetime(2025, 1, 1) + dt.timedelta(days=i * 230 // n)),
            "crawled_at": f"{day}T01:00:00",
        }
        rows.append(tuple(values.get(f.name) for f in RAW_LISTING))
    return with_dt(spark.createDataFrame(rows, RAW_LISTING))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    lake = Lake(str(root / "lake"), str(root / "models"))
    days = [(str(dt.date(2024, 6, 1) + dt.timedelta(days=i)), 2000.0 + i, 25000.0 + i, 1200.0 + i) for i in range(300)]
    for _ in range(2):
        ingest_market(spark, lake, spark.createDataFrame(days, MARKET_RAW), "backfill-2025-03-27")
    assert spark.read.parquet(lake.market).count() == 300
    months = [(f"{2024 + m // 12}-{m % 12 + 1:02d}", 100.0 + m, 4.0) for m in range(20)]
    seed_months(spark, lake, spark.createDataFrame(months, MACRO_MONTHLY))
    return lake


def test_entered_months_win_over_the_seed(spark, lake):
    entered = spark.createDataFrame([("2024-01", 90.0, 5.0, 1), ("2030-01", 0.0, 1.0, 2)],
                                    "month string, cpi double, rate double, n int")
    enter_months(spark, lake, entered, "n")
    seed_months(spark, lake, spark.createDataFrame([("2024-01", 1.0, 1.0), ("2025-09", 120.0, 4.0)], MACRO_MONTHLY))
    rows = {r["month"]: r["cpi"] for r in stored_months(spark, lake).collect()}
    assert rows["2024-01"] == 90.0 and rows["2025-09"] == 120.0 and len(rows) == 21 and "2030-01" not in rows


def test_a_repeated_load_serves_nothing_twice(spark):
    preds = spark.createDataFrame([(1, "v", "t", 5.0), (None, "v", "t", 6.0), (2, "v", "t", 7.0)],
                                  "id long, model_version string, scored_at string, x double")
    served = preds.where("id = 1 or id is null")
    assert [r["id"] for r in not_yet_served(preds, served).collect()] == [2]


def cases():
    return model_cases(trees=(3,), forest_depths=(3,), boost_depths=(2,), rounds=(2,))


def test_days_in_order(spark, lake):
    overwrite_partitions(listings(spark, DAY, 300), lake.raw, ["dt"])
    first = serve(spark, lake, str(DAY), cases=cases())
    assert first.version == str(DAY) and first.drift is False and first.decision is None
    preds = spark.read.parquet(lake.predictions)
    assert preds.count() == 300

    # The same day again: the same predictions, nothing doubled.
    before = sorted(map(tuple, preds.collect()))
    again = serve(spark, lake, str(DAY), cases=cases())
    assert again == first
    assert sorted(map(tuple, spark.read.parquet(lake.predictions).collect())) == before
    assert spark.read.parquet(lake.pool).count() == 300

    # A one-day batch has too short a span for a gate of its own: the stored one still holds.
    assert spark.read.parquet(lake.gate(str(DAY))).first()["gate_on"] is True

    # Prices three times as high: the holdout error leaves the band, a new version is trained.
    later = DAY + dt.timedelta(days=1)
    overwrite_partitions(listings(spark, later, 300, 3.0), lake.raw, ["dt"])
    second = serve(spark, lake, str(later), cases=cases())
    assert second.drift is True and second.version == str(DAY)
    assert second.decision in ("promote", "keep")
    assert {r["version"] for r in versions_rmse(spark, lake).collect()} == {str(DAY), str(later)}
    log = spark.read.parquet(lake.drift_log).orderBy("checked_at").collect()
    assert [r["drift"] for r in log] == [False, True]
    assert retrain(spark, lake, version_in_force(spark, lake, ""), cases()) == "noop"
    assert log[0]["drift_threshold"] == pytest.approx(1.5 * log[0]["baseline_rmse"])
    assert promote(spark, lake, str(DAY)) in ("noop", "keep", "promote")
    batches = spark.read.parquet(lake.predictions).select("model_version", "scored_at").distinct().count()
    assert batches == 2
