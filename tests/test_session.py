from types import SimpleNamespace

from tillroll.session import fresh_path, shared_folder


def session(**settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.rsplit(".", 2)[1], default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))


def test_the_named_folder_is_used():
    spark = session(checkpoint="hdfs:///shared/", warehouse="hdfs:///warehouse")
    assert shared_folder(spark) == "hdfs:///shared"


def test_without_it_a_folder_beside_the_tables_is_used():
    """Never a temporary folder of one machine."""
    assert shared_folder(session(warehouse="hdfs:///warehouse")) == "hdfs:///warehouse/_shared"


def test_paths_are_fresh(spark):
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
