import os
from types import SimpleNamespace

import pytest

from readloom import session


def test_scratch_tables_go(spark):
    with session.scratch(spark):
        df, path = session.written(spark.range(10), "x")
        with session.scratch(spark):
            inner = session.written(spark.range(3), "y")[1]
        assert df.count() == 10 and not os.path.exists(inner.removeprefix("file://")) and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_shared_folder_raises(master):
    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, getConf=lambda: none, applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
