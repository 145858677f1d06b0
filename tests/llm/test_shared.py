from types import SimpleNamespace

import pytest

from millrace.llm.shared import new_folder, shared_folder, written


def session(told, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": told}[key] or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_clusters_folder_is_taken():
    assert shared_folder(session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert shared_folder(session("/mnt/x", "local[4]")) == "/mnt/x"


def test_only_a_local_session_gets_a_folder_of_its_own():
    assert shared_folder(session(None, "local[4]")).startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://x:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(None, master))


def test_folders_are_new_and_what_is_written_is_read(spark):
    assert new_folder(spark, "a") != new_folder(spark, "a")
    frame = spark.range(10).selectExpr("id", "cast(null as string) as s")
    again = written(frame, "ten")
    assert again.schema == frame.schema or again.columns == frame.columns
    assert sorted(map(tuple, again.collect())) == [(k, None) for k in range(10)]
