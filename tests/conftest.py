import sys
import uuid
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from tillroll.session import fresh_path  # noqa: E402
from tillroll.sources.tables import Layers  # noqa: E402

AS_OF = "2026-02-10"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


GOLDEN = [
    (1, date(2026, 1, 1), "Leite", Decimal("10.00"), "M1"),
    (2, date(2026, 1, 8), "Leite", Decimal("10.00"), "M2"),
    (3, date(2026, 1, 22), "Leite", Decimal("13.00"), "M1"),
    (4, date(2026, 1, 1), "Arroz", Decimal("20.00"), "M1"),
    (5, date(2026, 2, 1), "Arroz", Decimal("22.00"), "M1"),
    (6, date(2026, 2, 5), "Cafe", Decimal("30.00"), "M2"),
]
LINES = "id bigint, purchase_date date, product_id string, product_price decimal(10,2), market_id string"


@pytest.fixture(scope="session")
def golden(spark):
    return spark.createDataFrame(GOLDEN, LINES)


@pytest.fixture
def layers(spark):
    layers = Layers(spark, fresh_path(spark, "layers"), f"t{uuid.uuid4().hex[:10]}_")
    layers.create()
    return layers


def rows(df, *columns):
    """Rows as plain tuples, in the order of the frame."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
