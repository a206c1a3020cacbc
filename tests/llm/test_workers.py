"""The operators in a session whose workers cannot import this repository."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from geoloom.llm.registry import QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
def alone(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("geoloom") is None] * b.num_rows)], names=["alone"])
assert spark.range(4).mapInArrow(alone, "alone boolean").where("alone").count() == 4
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    print(name, queries[name](spark, {data!r}).count(), flush=True)
"""


def test_workers_without_the_package(tmp_path, data):
    names = [*QUERIES, "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p).resolve().is_relative_to(ROOT)]
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), names=names, data=data)], cwd=tmp_path, env=env | {"PYTHONPATH": os.pathsep.join(tokenizers)}, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line] == names


def test_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from geoloom.llm.staging import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda _, default: folder or default), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("local[4]", None)).startswith("file:///tmp/")
    assert shared_dir(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master, None))
