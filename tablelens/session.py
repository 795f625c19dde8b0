"""Session helpers: configuration defaults and lineage cutting.

Nothing here overrides settings a cluster already provides; defaults only
fill gaps (tests and local runs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Session time zone is pinned so that the
# few zone-aware expressions behave the same everywhere; AQE re-plans
# shuffles at runtime (partition coalescing, skew-join splitting).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows reach Python in batches of at most about this much, whatever their number
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def local_session(cores: int = 8, app: str = "tablelens") -> SparkSession:
    """Session for tests and the local bench (`local[cores]`, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults above where the session has no value of its own."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _checkpoint_dir(spark: SparkSession) -> None:
    """Sets the folder of `spark.checkpoint.dir`. Only a single-machine session that leaves
    it unset gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    sc.setCheckpointDir(where)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one that all executors share."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several later jobs re-read: a reliable checkpoint in
    the shared folder, so a lost executor does not force the upstream shuffles to be re-run."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
