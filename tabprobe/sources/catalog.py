"""Registry of the nine domain datasets: schema, target column, declared size.

Paths are parameters; the raw files are headered gzip CSVs that are ingested
once to Parquet with :func:`tabprobe.sources.io.ingest_csv_to_parquet`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, typ = part.strip().rsplit(" ", 1)
        dt = {
            "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
            "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(),
        }[typ]
        fields.append(T.StructField(name.strip(), dt, True))
    return T.StructType(fields)


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    title: str
    schema: T.StructType
    declared_rows: int
    target: str | None = None
    timestamp_format: str | None = None


_V = ", ".join(f"V{i} double" for i in range(1, 29))

# Dataset titles and declared row counts.
DATASETS = {
    "bank_marketing": DatasetSpec(
        "bank_marketing", "Bank Marketing",
        _schema("age int, job string, marital string, education string, default string, housing string, "
                "loan string, contact string, month string, day_of_week string, duration int, campaign int, "
                "pdays int, previous int, poutcome string, emp.var.rate double, cons.price.idx double, "
                "cons.conf.idx double, euribor3m double, nr.employed double, y string"),
        41188, "y"),
    "card_fraud": DatasetSpec(
        "card_fraud", "Credit Card Fraud",
        _schema(f"Time double, {_V}, Amount double, Class int"), 284807, "Class"),
    "loan_default": DatasetSpec(
        "loan_default", "Loan Default Risk",
        _schema("loan_amnt double, term string, int_rate double, installment double, grade string, "
                "emp_length string, home_ownership string, annual_inc double, purpose string, dti double, "
                "default int"),
        10000, "default"),
    "medical_cost": DatasetSpec(
        "medical_cost", "Medical Cost Insurance",
        _schema("age int, sex string, bmi double, children int, smoker string, region string, charges double"),
        1338, None),
    "taxi_trips": DatasetSpec(
        "taxi_trips", "NYC Taxi Trips",
        _schema("tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, passenger_count double, "
                "trip_distance double, payment_type int, fare_amount double, tip_amount double, "
                "total_amount double"),
        100000, None),
    "online_retail": DatasetSpec(
        "online_retail", "Online Retail Sales",
        _schema("InvoiceNo string, StockCode string, Description string, Quantity int, "
                "InvoiceDate timestamp, UnitPrice double, CustomerID long, Country string"),
        541909, None),
    "bank_stocks": DatasetSpec(
        "bank_stocks", "S&P 500 Bank Stocks",
        _schema("Date timestamp, Ticker string, Open double, High double, Low double, Close double, "
                "Volume long"),
        11286, None),
    "game_catalogue": DatasetSpec(
        "game_catalogue", "Steam Games",
        _schema("name string, original_price string, release_date string, achievements string, "
                "genre string, popular_tags string, developer string"),
        40833, None),
    "video_game_sales": DatasetSpec(
        "video_game_sales", "Video Game Sales",
        _schema("Rank int, Name string, Platform string, Year double, Genre string, Publisher string, "
                "NA_Sales double, EU_Sales double, JP_Sales double, Other_Sales double, Global_Sales double"),
        16598, None),
}
