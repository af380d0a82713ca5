from twinsieve import scratch


def test_own_folder_where_none_is_named(spark, monkeypatch):
    named = scratch.shared_dir(spark)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    own = scratch.shared_dir(spark)
    assert own != named and own == scratch.shared_dir(spark) and own.startswith("file://")
    assert scratch.cut(spark.range(3)).count() == 3
    scratch.clear(spark)
