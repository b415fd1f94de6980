"""What the operators of this subpackage share: the shared folder, tables and checks of input."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillstack-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/quillstack/{what}-{uuid.uuid4().hex}"


class Tables:
    """The tables that one job has written and not deleted; jobs within it add those they leave."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def forget(self, spark: SparkSession, *keep: DataFrame) -> None:
        """Deletes them, but for those of the frames to keep: when nothing else is read any more."""
        for path in self.paths - {f._stored_at for f in keep}:
            _delete(spark, path)


_JOB: ContextVar[Tables | None] = ContextVar("job", default=None)


@contextmanager
def job() -> Iterator[Tables]:
    """Tables stored within are this job's. Other jobs of the session, in threads of their own, have theirs."""
    own, outer = Tables(), _JOB.get()
    token = _JOB.set(own)
    try:
        yield own
    finally:
        _JOB.reset(token)
        if outer is not None:
            outer.paths |= own.paths


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation of what stands above."""
    path = shared_path(frame.sparkSession, what)
    frame.write.parquet(path)
    if (own := _JOB.get()) is not None:
        own.paths.add(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if (own := _JOB.get()) is not None:
        own.paths.discard(path)


def forget(frame: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote for a frame that is no longer read."""
    _delete(frame.sparkSession, frame._stored_at)


def release(frame: DataFrame) -> None:
    """Collects the driver's garbage, as Spark deletes the files of a shuffle only once the driver has dropped
    its last reference to it: without this, shuffles of all finished tables of a job lie on the disks together."""
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()


def pseudonym_key(spark: SparkSession) -> str:
    """The session's secret, spark.quillstack.pseudonymKey; the stand-in is public and only for test tables."""
    return spark.conf.get("spark.quillstack.pseudonymKey", None) or "test tables only"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the frame has."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_USUAL = str(64 << 20)


def send_package(frame: DataFrame) -> None:
    """Lets the executors' Python workers import this package, and bounds the batches that they are sent: where the
    session has Spark's usual 64 MB, to 8 MB, as a batch is held more than once by either side."""
    conf, context = frame.sparkSession.conf, frame.sparkSession.sparkContext
    if conf.get(ARROW_BYTES).rstrip("bB") == _USUAL:
        conf.set(ARROW_BYTES, str(8 << 20))
    if not getattr(context, "_quillstack_sent", False):
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="quillstack-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
        context._quillstack_sent = True


def map_arrow(frame: DataFrame, f: Callable, schema) -> DataFrame:
    send_package(frame)
    return frame.mapInArrow(f, schema)
