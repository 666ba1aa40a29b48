"""A folder that the driver and all executors can reach."""

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set and Spark runs in one process, as in tests, a temporary one that goes at exit; on a cluster that
    would be a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return folder
