import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    out = session(
        "tests", spark_master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="3g", spark_ui_showConsoleProgress="false",
        spark_sql_adaptive_coalescePartitions_enabled="true", spark_default_parallelism="4",
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
