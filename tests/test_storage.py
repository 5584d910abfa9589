"""The shared folder is the session's; a temporary one only where that is unset."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from junctura import storage


def session(of_session, of_context, master="local[2]"):
    get = lambda found: lambda key, default=None: found or default
    conf = SimpleNamespace(get=get(of_context))
    return SimpleNamespace(conf=SimpleNamespace(get=get(of_session)), sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))


def test_shared_dir():
    assert storage.shared_dir(session("hdfs://a/b/", None)) == "hdfs://a/b"
    assert storage.shared_dir(session(None, "file:///c")) == "file:///c"
    assert storage.shared_dir(session(None, None)) == storage.shared_dir(session(None, None))
    assert storage.shared_dir(session(None, None)).startswith("file:///")


def test_a_cluster_names_its_folder():
    assert storage.shared_dir(session(None, "file:///c", "yarn")) == "file:///c"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(None, None, master))


def test_written(spark):
    df = storage.written(spark.range(5), "numbers")
    assert sorted(r.id for r in df.collect()) == list(range(5))


def test_clean_deletes_what_was_written(spark):
    path = storage.written(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    kept, storage._made[:] = storage._made[:-1], storage._made[-1:]
    assert Path(path).exists()
    storage.clean(spark)
    assert not Path(path).exists() and not storage._made
    storage._made[:] = kept
