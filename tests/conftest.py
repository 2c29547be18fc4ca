import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def send(spark):
    """Run a pipeline text on one message: the fields of what comes out, or None."""

    def run(text, **fields):
        from tidelog import model
        from tidelog.plans.compiler import transform

        names = list(fields) or ["_none"]
        df = spark.createDataFrame([tuple(fields.get(n) for n in names)], ", ".join(f"`{n}` string" for n in names))
        out = transform(text, df)
        if out is None:
            return None
        rows = out.collect()
        assert len(rows) <= 1
        if not rows:
            return None
        got = {k: v for k, v in rows[0].asDict().items() if not k.startswith("_") and v is not None}
        if model.REST in out.columns:
            got |= {k: v for k, v in (rows[0][model.REST] or {}).items()}
        return got

    return run
