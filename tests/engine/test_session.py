from types import SimpleNamespace

import pytest

from thicket.session import shared_folder


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    of_context = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=lambda: of_context))


def test_the_shared_folder_is_the_one_that_the_session_names():
    assert shared_folder(session("yarn", "hdfs://host/shared/")) == "hdfs://host/shared"
    assert shared_folder(session("local[4]")) == shared_folder(session("local[4]")) != shared_folder(session("local"))
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
