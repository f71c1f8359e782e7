import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    s = SparkSession.builder.master("local[4]").config(
        map={
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": str(home / "checkpoint"),
        }
    ).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from rxnframe.session import tune

    yield tune(s)
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
