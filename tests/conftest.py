import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from quotelake.session import build_session  # noqa: E402
from quotelake.streaming.pattern_state import STATE_STORE  # noqa: E402

SF_DIR = "/root/testdata/sf" + os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quotelake-tests-"),
    })
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples; timestamps may be given as text."""
    def make(schema, *data):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        wanted = T._parse_datatype_string(schema)
        loose = T.StructType([
            T.StructField(f.name, T.StringType() if isinstance(
                f.dataType, (T.TimestampNTZType, T.DecimalType, T.TimestampType)) else f.dataType) for f in wanted])
        df = spark.createDataFrame([tuple(
            str(v) if v is not None and isinstance(f.dataType, T.StringType) else v
            for v, f in zip(r, loose)) for r in data], loose)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    return make
