from types import SimpleNamespace

import pytest

from attestra.llm import staging


def session(master, folder):
    settings = {} if folder is None else {"spark.checkpoint.dir": folder}
    return SimpleNamespace(conf=SimpleNamespace(get=settings.get, set=settings.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder_is_the_clusters():
    assert staging.shared_dir(session("yarn", "s3a://shared/folder/")) == "s3a://shared/folder"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session("spark://host:7077", None))
    local = session("local[2]", None)
    assert staging.shared_dir(local) == staging.shared_dir(local)
