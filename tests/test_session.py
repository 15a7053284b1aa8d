from types import SimpleNamespace

import pytest

from tidemark.session import shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getConf=lambda: {}, setCheckpointDir=lambda f: None, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_single_machine_makes_its_own(master):
    assert shared_folder(session(master)).startswith("file:///")
