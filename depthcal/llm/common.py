"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for trimming and translating.
SPACES = " \t\n\x0b\f\r"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this session inside ``spark.checkpoint.dir``, seen by the driver and all executors.

    Where the setting is absent and all runs on one machine, a temporary folder takes its place; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not re.match(r"local(\[[^-]|$)", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            base = "file://" + tempfile.mkdtemp(prefix="depthcal-")
        root = f"{base.rstrip('/')}/depthcal-{app}-{uuid.uuid4().hex[:8]}"
        _roots[app] = root
        atexit.register(_forget, spark, root)
    return _roots[app]


def _forget(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the session may have ended: then the cluster's own cleaning applies
        pass


def drop_path(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder on whatever file system its URI names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The mounted path of a file URI; other stores go through :func:`open_uri`."""
    for head in ("file://", "file:"):
        if uri.startswith(head):
            return uri[len(head):]
    return uri


def open_uri(uri: str, mode: str):
    """Open a file by URI from Python: a mount for file paths, pyarrow's file systems otherwise."""
    if "://" not in uri or uri.startswith("file:"):
        path = local_path(uri)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def rename_uri(source: str, target: str) -> None:
    """Publish a finished file under its final name; a second attempt of a task replaces the first's."""
    if "://" not in source or source.startswith("file:"):
        os.replace(local_path(source), local_path(target))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(source)
    store.move(path, fs.FileSystem.from_uri(target)[1])


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def relieve(spark: SparkSession, garbage: bool = False) -> str | None:
    """Return freed memory of the driver to the system, of this process and of the Java runtime, which takes and frees much while it
    plans and compiles; with ``garbage`` its heap is collected before. Returns what the runtime says, if it has that command."""
    give_back()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    if garbage:
        jvm.System.gc()
    args = new(jvm.java.lang.Object, 4)
    try:
        # The server's own class is closed to calls from here, its interface isn't.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another runtime
        return None


def lean(run):
    """``run(batches)`` for a worker that gives back what it has freed when its task ends: workers are kept for later tasks and
    stages, beside whose memory theirs counts."""
    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def text_column(docs: DataFrame) -> int | None:
    """The place of the column text where it is a string already, so that whole texts needn't go to a worker twice."""
    at = [i for i, f in enumerate(docs.schema.fields) if f.name == "text" and f.dataType.typeName() == "string"]
    return at[0] if len(at) == 1 else None


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    Inside a lambda an outer expression is evaluated again for each element; bound this way it is a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


#: Ids (8 bytes each) that may be broadcast to pick documents; beyond it the join shuffles, with Spark's own bloom filter.
BROADCAST_IDS = 4_000_000


def broadcast_ids(ids: DataFrame) -> DataFrame:
    """Ids with a broadcast hint where their number is within the bound."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among the distinct ``id`` of ``ids``. Texts aren't shuffled up to the bound."""
    return docs.join(broadcast_ids(ids), docs.doc_id == ids.id, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Long texts: small Arrow batches keep the workers' memory bounded.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
