import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from copresence.session import prepare, use_local_folder
    return prepare(use_local_folder(s))


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    from catalog.fixtures import Tables
    return Tables(spark, SF)
