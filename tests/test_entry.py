"""The entry module and the session's folders."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from vesperflow import session

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True)


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/vesperflow/llm"), reason="the optional folder is absent")
def test_a_missing_dependency_is_no_missing_folder(tmp_path):
    shutil.copytree(f"{ROOT}/vesperflow", tmp_path / "vesperflow", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    got = run(tmp_path, "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__")
    assert got.returncode and "ahocorasick" in got.stderr
    shutil.rmtree(tmp_path / "vesperflow" / "llm")
    (tmp_path / "vesperflow" / "llm" / "__pycache__").mkdir(parents=True)
    got = run(tmp_path, "import __spark_entry__ as e; assert 'region_cone' in e.queries() and 'pipeline' not in e.queries()")
    assert not got.returncode, got.stderr


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Spark:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark())
