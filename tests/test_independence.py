"""Results do not follow the number of partitions."""

import oracle
import pytest

from armature.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["action_chunks", "renumber_blocked", "smooth_blocked", "shuffled_frames", "mixture_draw", "stitch", "accept", "random_sources"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_for_one_and_many_partitions(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append(oracle.spark_rows(QUERIES[name](spark, SF_DIR)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] and found[0][1]
