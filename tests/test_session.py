"""The shared scratch folder: needed on a cluster, and emptied by its owner."""

import os
from types import SimpleNamespace

import pytest

from sparkprep import session


def stub(master, folder=""):
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default="": folder or default), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(stub(master))
        assert session.shared_dir(stub(master, "hdfs://store/shared/")) == "hdfs://store/shared"


def test_stored_stages_are_deleted(spark):
    session.release()
    session.cut_lineage(spark.range(3)).count()
    path = session._OWNED[-1].removeprefix("file:")
    assert os.path.isdir(path)
    assert session.release() == 1 and not os.path.isdir(path)


def test_a_scope_releases_its_own_folders(spark):
    session.release()
    kept = session.cut_lineage(spark.range(3))
    with session.scratch_scope([]) as paths:
        session.cut_lineage(spark.range(5))
        with session.scratch_scope([]) as inner:
            session.cut_lineage(spark.range(7))
    assert len(paths) == len(inner) == 1 and session.release(paths) == 1 and paths == []
    assert kept.count() == 3 and len(session._OWNED) == 2 and session.release() == 2
