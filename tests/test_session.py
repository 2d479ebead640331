"""Written tables go with the process that wrote them."""

import os
import subprocess
import sys

CODE = """
import os
from pyspark.sql import SparkSession
from sparkseam.session import folder, materialise
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {path!r}).config("spark.ui.enabled", "false").getOrCreate()
rows = materialise(spark.range(5).toDF("n"), "kept")
spark.range(3).write.parquet(folder(spark, "engine"))
assert rows.count() == 5
print(sum(n.startswith("sparkseam-") for n in os.listdir({path!r})))
"""


def test_the_shared_folder_is_empty_after_the_process(tmp_path):
    path = str(tmp_path / "shared")
    os.mkdir(path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE.format(path=path)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.strip() == "2", done.stderr[-2000:]
    assert [n for n in os.listdir(path) if n.startswith("sparkseam-")] == []  # Spark keeps a folder of its own there
