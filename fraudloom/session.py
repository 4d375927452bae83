"""Session helpers: shared folder for lineage cuts and staged tables."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_STAGED: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master (tests, bench) may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="fraudloom-")
    return _LOCAL_DIRS[app]


#: Has Spark delete the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_TIDYING: dict[SparkSession, list] = {}
_LOCK = threading.Lock()


def write_once(df: DataFrame, path: str) -> None:
    """Write a table whose plan nothing runs again, so that its shuffle files need not outlive the write.

    Writers may run at the same time: the first one changes the session's setting and the last one puts it back.
    """
    spark = df.sparkSession
    with _LOCK:
        writers = _TIDYING.setdefault(spark, [0, spark.conf.get(TIDY, None)])
        writers[0] += 1
        spark.conf.set(TIDY, True)
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            writers[0] -= 1
            if not writers[0]:
                before = _TIDYING.pop(spark)[1]
                spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage: write ``df`` as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fraudloom/{label}-{uuid.uuid4().hex}"
    write_once(df, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more; other tables are left alone."""
    spark, home = df.sparkSession, f"{shared_folder(df.sparkSession)}/fraudloom/"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if home.removeprefix("file://") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def together(*builders: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent builders at the same time, so that one's short stages fill the gaps of the other's."""
    with ThreadPoolExecutor(len(builders)) as pool:
        return list(pool.map(lambda build: build(), builders))


def source_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a folder's entries and of the files in its table folders."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(conf)
    if not store.exists(path):
        return ()
    entries = list(store.listStatus(path))
    inner = [x for e in entries if e.isDirectory() for x in store.listStatus(e.getPath())]
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in entries + inner))


def staged(spark: SparkSession, name: str, inputs: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a table once per application, input set and state of the source folders, then reuse its files.

    ``inputs`` are source folders (text) and configurations. The key holds the names, sizes and times of a folder's files, so a
    rewritten source or another configuration makes a new table.
    """
    key = (spark.sparkContext.applicationId, name, tuple(repr(x) for x in inputs), tuple(source_state(spark, x) for x in inputs if isinstance(x, str)))
    if key not in _STAGED:
        digest = hashlib.sha256(repr(key).encode()).hexdigest()[:16]
        path = f"{shared_folder(spark)}/fraudloom/{name}-{digest}-{uuid.uuid4().hex[:8]}"
        write_once(build(), path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])
