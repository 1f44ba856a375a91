"""Tables in storage that all executors share, and this package on the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one (local tests) a temporary folder is used;
    a cluster session without the setting is refused, as its disks are not shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="strandweave-")
        atexit.register(shutil.rmtree, _LOCAL_SHARED[app], True)
    return "file://" + _LOCAL_SHARED[app]


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_strandweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandweave-zip-")) / f"strandweave_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    sc.addPyFile(str(target))
    atexit.register(shutil.rmtree, str(target.parent), True)
    sc._strandweave_shipped = True


class Workspace:
    """Tables in the shared folder, to cut lineage at points that must survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def tidy(self) -> None:
        """Has the driver forget finished plans now, so that their shuffle files leave the executors' disks."""
        self.spark.sparkContext._jvm.System.gc()

    def _forget(self) -> None:
        try:
            if self.root.startswith("file:/"):
                shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)
            elif self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
