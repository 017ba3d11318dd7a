"""The split size is read however it is spelt."""

import pytest

from tabsieve.operators.partitioning import is_narrow, split_bytes

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize("spelt, size", [("16m", 16 << 20), ("128MB", 128 << 20), ("1g", 1 << 30), ("4194304", 4 << 20), ("4194304b", 4 << 20)])
def test_split_size(spark, spelt, size):
    before = spark.conf.get(SPLIT)
    try:
        spark.conf.set(SPLIT, spelt)
        assert split_bytes(spark) == size
        assert is_narrow(spark.range(10))
    finally:
        spark.conf.set(SPLIT, before)
