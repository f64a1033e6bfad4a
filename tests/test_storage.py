import os

import pytest
from pyspark.sql import functions as F

from pathloom import storage


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return None

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return Elsewhere.conf


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        storage.shared_dir(Elsewhere)


def test_cut_measures_and_release_deletes(spark):
    s = storage.Scratch(spark, "test")
    t = s.cut(spark.range(5), "t", top=F.max("id"))
    assert storage.rows(t) == 5 and storage.measured(t)["top"] == 4 and t.count() == 5
    assert storage.rows(s.cut(spark.range(5).where("id > 9"), "none")) == 0
    folder = s.root.removeprefix("file://")
    assert os.path.isdir(folder)
    storage.release()
    assert not os.path.exists(folder)


def test_kept_is_built_once_and_again_when_gone(spark):
    made = []

    def build():
        made.append(storage.Scratch(spark, "kept").cut(spark.range(3)))
        return made[-1]

    assert storage.kept(spark, ("test", 1), build) is storage.kept(spark, ("test", 1), build) and len(made) == 1
    storage.remove(spark, made[0]._pathloom_path)
    assert storage.kept(spark, ("test", 1), build).count() == 3 and len(made) == 2
