"""Tables in the shared work folder, to cut lineage so that jobs survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the folder that setCheckpointDir() made: what driver and executors share.

    Only where all tasks run in the driver's own process (master local[...]) and the session has neither, a temporary
    folder is made and set; on a cluster that is an error, as no other machine would see the folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set, and {sc.master} has no folder of its own that all executors see")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-work-')}")
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = work_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_here(files: tuple[str, ...], columns: list[str], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Parquet files of the shared folder, read by the task itself in pieces of at most `rows` rows, through whichever file system their URLs name."""
    from pyarrow import fs

    for file in files:
        system, name = fs.FileSystem.from_uri(file)
        with system.open_input_file(name) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(batch_size=rows, columns=columns, use_threads=False):
                yield pa.Table.from_batches([batch])


def _file_system(spark: SparkSession, path: str):
    """(file system, path) by URL, in whatever store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _file_system(spark, path)
    return system.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    system, p = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(p) if f.isDirectory()) if system.exists(p) else []


def create(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False where there is one already, of which only one of several callers is told otherwise."""
    system, p = _file_system(spark, path)
    system.mkdirs(p.getParent())
    return system.createNewFile(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _file_system(spark, path)
    system.delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that written() made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        base = shared_folder(spark)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base.split(":", 1)[-1].lstrip("/") not in folder:
                raise ValueError(f"{folder} is not under {base}")
            remove(spark, folder)


def bucketed(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, in buckets by key and sorted within them: joins on key and sums by it do not move its rows."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table).alias(table)


def unbucketed(df: DataFrame) -> None:
    """Removes what bucketed() made."""
    folder = df.inputFiles()
    spark, path = df.sparkSession, (folder[0].rsplit("/", 1)[0] if folder else None)
    if path:
        spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")
        dropped(df)
