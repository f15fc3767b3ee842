"""Domain pipelines on small inline fixtures with the edge rows of FIXTURES.md;
expected values follow the page logic computed with pandas."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.plans.domains import (bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default,
                                    medical_cost, online_retail, taxi_trips, video_game_sales)
from tabprobe.sources.catalog import DATASETS


def _frame(spark, name, rows):
    return spark.createDataFrame(rows, DATASETS[name].schema)


def _bank(spark):
    base = [30, "admin.", "married", "uni", "no", "yes", "no", "cellular", "may", "mon", 100, 1, 999, 0, None,
            1.1, 93.9, -36.4, 4.8, 5191.0, "no"]
    rows = []
    for i, (age, month, dur, y) in enumerate([(25, "mar", 0, "yes"), (35, "mar", 10, "yes"), (100, "jan", 5, "no"),
                                              (101, "apr", 7, None), (40, "may", 20, "no"), (22, "may", 30, "yes")]):
        r = list(base)
        r[0], r[8], r[10], r[20] = age, month, dur, y
        r[11] = i + 1
        rows.append(tuple(r))
    return _frame(spark, "bank_marketing", rows)


def test_bank_marketing_pipeline(spark):
    out = bank_marketing.run(_bank(spark))
    k = out["kpis"].first()
    assert (k.contacts, k.subscriptions) == (5, 2)
    grp = {r.age_group: (r["count"], r.rate) for r in out["by_age_group"].collect()}
    assert grp["<25"] == (1, 1.0)          # 22 only (25 had duration 0)
    assert grp["25-34"] == (1, 1.0)        # 35 is in (25, 35]
    assert grp["45-54"] == (0, None)
    months = [r.month for r in out["by_month"].collect()]
    assert months == ["mar", "apr", "may", "jan"]
    assert out["class_balance"].count() == 2
    assert {r.column for r in out["stats"].collect()} >= {"emp.var.rate", "age"}


def test_card_fraud_pipeline(spark):
    rows = []
    for i, (t, amt, cls) in enumerate([(0.0, 0.0, 0), (86399.0, -3.0, 0), (90000.0, None, 1),
                                       (3600.0, 5000.0, 1), (7200.0, 5000.01, 0), (100.0, 12.5, 0)]):
        rows.append(tuple([t] + [float(i + j) for j in range(28)] + [amt, cls]))
    df = _frame(spark, "card_fraud", rows)
    feat = card_fraud.features(df)
    got = {r.Time: (r.Time_Hour, r.Log_Amount) for r in feat.collect()}
    assert got[90000.0] == (1.0, 0.0)      # (90000/3600) % 24; NULL amount → log 0
    assert got[86399.0][1] == 0.0
    out = card_fraud.run(df)
    k = out["kpis"].first()
    assert (k.transactions, k.fraud_cases) == (4, 1)  # NULL amount and 5000.01 dropped
    assert k.mean_fraud_amount == 5000.0
    assert out["component_sample"].count() == 4


def test_loan_default_pipeline(spark):
    rows = [(1000.0, "36", 8.0, 30.0, "A", "<1", "MORTGAGE", 0.0, "car", 0.0, 0),
            (2000.0, "60", 8.01, 60.0, "G", "10+", None, 50000.0, "car", 5.0, 1),
            (3000.0, "60", 31.0, 90.0, "G", "n/a", "RENT", 40000.0, "debt", 40.0, 1),
            (4000.0, "36", 30.0, 90.0, "B", "3", "RENT", 40000.0, "debt", 41.0, 0),
            (5000.0, "36", 12.0, 90.0, "B", "3", "RENT", 40000.0, "debt", None, 1)]
    out = loan_default.run(_frame(spark, "loan_default", rows))
    assert out["kpis"].first().loans == 3
    bins = {r.dti_bin: r["count"] for r in out["by_dti_bin"].collect()}
    assert bins["(0, 5]"] == 1 and bins["(35, 40]"] == 0 and sum(bins.values()) == 1
    feat = loan_default.features(loan_default.clean(_frame(spark, "loan_default", rows)))
    r = {x.loan_amnt: x for x in feat.collect()}
    assert r[1000.0].int_rate_bin == "<8%" and r[2000.0].int_rate_bin == "8-12%"
    assert r[1000.0].loan_to_income == 1000.0 and r[2000.0].has_mortgage == 0


def test_medical_cost_grid_and_median(spark):
    rows = [(19, "f", 18.5, 0, "yes", "sw", 100.0), (30, "m", 25.0, 1, "no", "ne", 200.0),
            (40, "m", 30.0, 2, "no", "ne", 300.0), (50, "f", 61.0, 0, "yes", "sw", 400.0),
            (60, "f", None, 0, "no", "sw", 0.0), (70, "m", 29.0, 3, "no", "nw", -1.0)]
    out = medical_cost.run(_frame(spark, "medical_cost", rows))
    feat = {r.age: r for r in medical_cost.features(medical_cost.clean(_frame(spark, "medical_cost", rows))).collect()}
    assert feat[19].bmi_category == "Underweight" and feat[30].bmi_category == "Normal"
    assert feat[50].bmi_category is None and feat[50].smoker_bmi == "yes_nan"
    grid = out["age_group_x_smoker"].collect()
    assert len(grid) == 12
    med = {r.smoker: r.median for r in out["by_smoker"].collect()}
    assert med == {"yes": 250.0, "no": 250.0}
    assert out["kpis"].first().median_cost == 250.0


def test_taxi_trips_pipeline(spark):
    t0 = dt.datetime(2024, 1, 6, 10, 0)  # Saturday
    def trip(mins, dist, fare, tip, pax=1.0, pay=1):
        return (t0, t0 + dt.timedelta(minutes=mins), pax, float(dist), pay, float(fare), float(tip),
                float(fare + tip))
    rows = [trip(0.9, 1.0, 10, 1), trip(1, 1.0, 10, 10), trip(360, 51.0, 100, 0), trip(361, 2, 10, 0),
            trip(10, 20.0, 30, 31), trip(30, 5.0, 20, 2, pax=None), trip(60, 80.0, 50, 0, pay=None),
            trip(60, 81.0, 50, 0), trip(15, 2.0, 0, 0)]
    out = taxi_trips.run(_frame(spark, "taxi_trips", rows))
    k = out["kpis"].first()
    assert k.trips == 3   # 1 min / tip 100 %, 360 min / 51 mi, 60 min / 80 mph
    labels = {r.payment_label for r in out["by_payment"].collect()}
    assert labels == {"Credit Card", "Other"}
    dist = {r.dist_bin: r["count"] for r in out["fare_per_mile_by_distance"].collect()}
    assert dist["<1"] == 1 and dist["10+"] == 0   # 51 and 80 miles are beyond the last edge
    assert {r.weekend for r in out["weekday_weekend"].collect()} == {"Weekend"}


def test_online_retail_pipeline(spark):
    t = dt.datetime(2011, 11, 5, 12)
    rows = [("1", "A", "mug", 2, t, 5.0, 10, "UK"), ("1", "A", "mug", 1, t, 5.0, 10, "UK"),
            ("2", "B", "cup", -1, t, 3.0, 11, "FR"), ("3", "B", " ", 1, t, 3.0, 12, "FR"),
            ("4", "C", "pen", 4, t, 9999.99, None, "DE"), ("5", "C", "pen", None, t, 10000.0, 13, "DE"),
            ("6", "D", "lamp", 1, t, 20.0, 14, "FR")]
    out = online_retail.run(_frame(spark, "online_retail", rows))
    k = out["kpis"].first()
    assert (k.orders, k.revenue, k.customers) == (2, 35.0, 2)
    assert k.mean_order_value == 17.5
    assert out["cancellation_rate"].first()[0] == pytest.approx(1 / 7)
    miss = out["missing_customer"].first()
    assert (miss.total_rows, miss.missing_rows) == (6, 1)
    top = out["revenue_by_country"].collect()
    assert [(r.Country, r.revenue, r.orders) for r in top] == [("FR", 20.0, 1), ("UK", 15.0, 1)]


def test_bank_stocks_pipeline(spark):
    rows = []
    for k, n in [("AAA", 21), ("BBB", 20)]:
        for i in range(n):
            d = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
            close = None if (k == "BBB" and i == 5) else 100.0 + i * (1 if k == "AAA" else -0.5)
            rows.append((d, k, 1.0, 3.0, 0.5, close, 1000 + i))
    out = bank_stocks.run(_frame(spark, "bank_stocks", rows))
    vol = [r for r in out["series"].collect() if r.Ticker == "AAA" and r.Volatility_20d is not None]
    assert len(vol) == 1   # first rolling value on row 21
    pr = {r.Ticker: r.period_return for r in out["period_return"].collect()}
    assert pr["AAA"] == pytest.approx(120.0 / 100.0 - 1)  # all rows lie within the last 365 days
    days = {r.Ticker: r.days for r in out["trading_days"].collect()}
    assert days == {"AAA": 21, "BBB": 19}


def test_game_catalogue_pipeline(spark):
    rows = [("g1", "Free", "2019-3-5", "12 achievements", "Action, RPG", "rpg,indie", "dev1"),
            ("g2", "$1,299.00", "5 Jan, 2018", None, "Action", "indie", "dev1"),
            ("g3", "$5", "Jan 5, 2018", "1_000 achievements", None, None, None),
            ("g4", "nan", "2017", "x", "RPG", "rpg", "dev2"),
            ("g5", "$200", "Coming soon", "1", "RPG", "rpg", "dev2"),
            ("g6", "$45.5", "2016", "3 achievements", "Indie,  Action", "indie, rpg ", "dev2")]
    df = _frame(spark, "game_catalogue", rows)
    feat = {r.name: r for r in game_catalogue.features(game_catalogue.clean(df)).collect()}
    assert set(feat) == {"g1", "g2", "g3", "g6"}
    assert feat["g1"].price_tier == "Free" and feat["g3"].price_tier == "Budget (<$5)"
    assert feat["g2"].price_tier is None       # 1299 beyond the last edge
    assert feat["g3"].achievements_count == 1000 and feat["g2"].achievements_count == 0
    assert feat["g1"].dev_game_count == 2 and feat["g3"].dev_game_count is None
    out = game_catalogue.run(df, genre="action", price_max=60)
    assert out["kpis"].first().games == 2       # g1, g6 (g2 over the price cap, g3 no genre)
    tags = {r.tag: r["count"] for r in out["tags_top20"].collect()}
    assert tags == {"rpg": 2, "indie": 2}


def test_video_game_sales_pipeline(spark):
    rows = [(1, "a", "PS2", 2000.0, "Sports", None, 1.0, 0.5, 0.1, 0.1, 1.7),
            (2, "b", "Wii", 1999.0, "Sports", "N", 1.0, 0.5, 0.1, 0.1, 1.7),
            (3, "c", "ZZZ", 2020.0, "Racing", "N", 0.05, 0.0, 0.0, 0.0, 0.1),
            (4, "d", "PC", None, "Racing", "N", 1.0, 0.0, 0.0, 0.0, 1.0),
            (5, "e", "PS4", 2021.0, "Racing", "S", 1.0, 0.0, 0.0, 0.0, 10.0),
            (6, "f", "X360", 2010.0, "Shooter", "S", 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = _frame(spark, "video_game_sales", rows)
    out = video_game_sales.run(df)
    k = out["kpis"].first()
    assert (k.games, k.platforms, k.publishers) == (2, 2, 2)
    feat = {r.Name: r for r in video_game_sales.features(video_game_sales.clean(df)).collect()}
    assert feat["c"].Generation == "Other" and feat["a"].Publisher == "Unknown"
    assert feat["c"].Sales_Tier == "<0.1M" and feat["e"].Sales_Tier == "5-10M"
    assert feat["b"].Decade == "1990s"
    reg = {r.Region: r.sales for r in out["by_region"].collect()}
    assert reg["NA"] == pytest.approx(1.05)
