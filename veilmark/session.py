"""Session helpers: a local session for tests and lineage cuts on the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local[*] session with AQE, Arrow and UTC; for tests and the bench only."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary folder is made, but
    only on a local master (tests on one machine): elsewhere it is an error, as executors share no local folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilmark-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows (of about 40 bytes) up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is (a shuffled join)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, used: str) -> DataFrame:
    """A scan that has fewer splits than there are cores, dealt out over the cores; a larger one as it is. used: a column that
    is read later; it is marked as not deterministic, as costly filters would be pushed back into the few splits else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores).withColumn(used, F.when(F.monotonically_increasing_id() >= 0, F.col(used))) if df.rdd.getNumPartitions() < cores else df


def one_copy(spark: SparkSession, folder: str, name: str, key: str, *columns: str, where: str = "true") -> DataFrame:
    """(key, columns...) of a stored table with one row a non-null key: of rows delivered several times one stays
    whole, always the same. Only keys and places are shuffled to find the repeated ones; the rows themselves stay where they
    are, unless so many keys are repeated that their list is no broadcast. where: a condition that reaches the scan.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = table(spark, folder, name).where(F.col(key).isNotNull()).where(where)
    repeated = rows.select(key, F.xxhash64(place).alias("_place")).groupBy(key).agg(F.count("*").alias("_n"), F.min("_place").alias("_first")).where("_n > 1").select(key, "_first")
    few = repeated.limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows <= BROADCAST_ROWS:
        repeated = F.broadcast(spark.createDataFrame(few))
    kept = spread(rows.select(key, *columns, F.xxhash64(place).alias("_place")), "_place").join(repeated, key, "left").where("_first IS NULL OR _place = _first")
    return kept.select(key, *columns)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, wherever they run, once a context."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_veilmark_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="veilmark-")) / "veilmark.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._veilmark_shipped = True
