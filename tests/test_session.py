import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
from marginalia.session import saved, shared_dir
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
assert shared_dir(s) == "file://" + sys.argv[1]
df = saved(s.range(5).selectExpr("id", "array(id) as a"), "x")
assert df.count() == 5 and sys.argv[1] in df.inputFiles()[0]
"""


def test_the_folder_of_the_session_is_used(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "shared")], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_small_scans_are_spread_and_large_ones_left(spark):
    from marginalia.session import spread

    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


def test_saved_tables_are_discarded_on_request(spark):
    import os

    from marginalia import session

    df = session.saved(spark.range(5).toDF("x"), "test")
    path = session._written[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert session.discard_saved(spark) >= 1 and not os.path.exists(path) and session.discard_saved(spark) == 0
