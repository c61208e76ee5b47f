"""Shared storage."""

import os
from types import SimpleNamespace

import pytest

from parcelwise import session


def stub(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder or other), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]", "localhost"])
def test_a_cluster_without_shared_storage_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(stub(master), "x")
    assert session.shared_base(stub(master, "hdfs://host/shared")) == "hdfs://host/shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]", "local[4,2]"])
def test_a_local_master_gets_a_temporary_folder(master):
    assert session.shared_base(stub(master)).startswith("file://")


def test_the_setting_is_read_and_left_as_it_is(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    session.stored(spark.range(3), "three")
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_released_removes_what_the_block_stored(spark):
    kept, path = session.stored_at(spark.range(3), "kept")
    with session.released(spark):
        inside, gone = session.stored_at(spark.range(5), "gone")
        assert inside.count() == 5
    assert kept.count() == 3 and os.path.exists(path.removeprefix("file://")) and not os.path.exists(gone.removeprefix("file://"))
    session.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 1009 as k").repartition(7)
    got = session.numbered(rows, "place", "k", "id").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(1000))
