"""Session helpers: configuration, lineage cuts in the shared folder, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[tuple[str, str]] = set()
_OWN: dict[str, str] = {}


def build(app: str = "readloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or, on a single machine (tests), a new one of ours where that is unset.

    On a cluster an unset spark.checkpoint.dir raises: executors' own temporary folders do not hold tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="readloom-")
            _remember(spark, _OWN[app])
        folder = _OWN[app]
    return folder


def _remember(spark: SparkSession, folder: str) -> None:
    if not _FOLDERS:
        atexit.register(_sweep)
    _FOLDERS.add((spark.sparkContext.applicationId, folder))


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for app, folder in _FOLDERS:
        try:
            if spark.sparkContext.applicationId == app:
                drop_table(spark, folder)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def written(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back; also its path.

    The rows are computed once (a reliable checkpoint computes its last stage twice), and survive the
    loss of any executor.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/readloom-{spark.sparkContext.applicationId}"
    _remember(spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block go when it ends; for results that are written or collected within it.

        with scratch(spark):
            connected_groups(links).write.parquet(target)
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by written()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files of plans no longer referenced go."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no path of ours."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="readloom-code-")) / "readloom_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
