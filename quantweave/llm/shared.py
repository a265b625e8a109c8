"""Tables in the folder that the driver and all executors share.

`spark.checkpoint.dir` names that folder. A table written there cuts the
lineage: a lost executor costs the tasks that were running, nothing older.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one; only a local session may lack the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _own[app] = tempfile.mkdtemp(prefix="quantweave-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = "file://" + _own[app]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
