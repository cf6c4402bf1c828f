"""Session helpers: scratch location and package shipping."""

import os

from docket.session import _SHIPPED, shared_dir, ship_package


def test_shared_dir_is_under_the_checkpoint_dir(spark):
    base = spark.sparkContext.getCheckpointDir()
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(base) and b.startswith(base)
    assert os.path.isdir(a.replace("file:", "", 1))


def test_ship_package_once_per_application(spark):
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED
