from __future__ import annotations

import os

import pytest

from terracut.llm import scratch


class Unset:
    """A session without spark.checkpoint.dir."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:  # noqa: N801
        applicationId = "app-1"
        master = "local[2]"


class Cluster(Unset):
    class sparkContext:  # noqa: N801
        applicationId = "app-2"
        master = "spark://host:7077"


def test_stored_tables_lie_in_the_shared_folder(spark):
    df = spark.range(5).selectExpr("id", "cast(null as string) AS t")
    back = scratch.stored(df, "x")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 5
    assert all(f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in back.inputFiles())


def test_own_folder_where_none_is_set():
    folder = scratch.shared_folder(Unset)
    assert folder.startswith("file:///") and scratch.shared_folder(Unset) == folder


def test_clusters_need_a_shared_folder():
    with pytest.raises(ValueError):
        scratch.shared_folder(Cluster)


def test_discard(spark):
    path = scratch.stored(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    scratch.discard(spark)
    assert not os.path.exists(path)
    scratch.discard(spark)
