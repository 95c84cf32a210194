import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

os.environ["TZ"] = "UTC"
time.tzset()
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from studylantern.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not available")
    return path


@pytest.fixture
def table(spark):
    """Frame of a declared table from dicts; unnamed columns are null."""
    from datetime import date, datetime

    from studylantern.schemas import table_schema

    def build(name, *rows):
        schema = table_schema(name)
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}

        def value(row, column):
            v = row.get(column)
            if v is not None and kinds[column] == "timestamp":
                return datetime.fromisoformat(v)
            if v is not None and kinds[column] == "date":
                return date.fromisoformat(v)
            return float(v) if v is not None and kinds[column] == "double" else v

        return spark.createDataFrame([tuple(value(r, c) for c in kinds) for r in rows], schema)

    return build
