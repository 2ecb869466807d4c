from types import SimpleNamespace

import pytest

from srcstrata import session


def test_a_cluster_needs_a_shared_folder():
    def spark(master):
        conf = SimpleNamespace(get=lambda key, default=None: {"spark.sql.warehouse.dir": "file:/here"}.get(key, default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(spark("spark://host:7077"), "x")


def test_scratch_folders_lie_in_the_shared_root(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    a, b = (session.shared_folder(spark, "x") for _ in range(2))
    assert a != b and a.startswith(f"{root.rstrip('/')}/x-")


def test_stored_rows_come_back(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sorted(session.stored(df, "x").collect()) == sorted(df.collect())
