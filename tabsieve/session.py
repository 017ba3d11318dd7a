"""Session helpers: one place that decides Spark settings for local runs and
reads the cluster's settings (never overriding them) elsewhere."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the session is created here (tests, bench).
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tabsieve", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass ``master=None`` and the
    launcher's settings win; locally we pin a few knobs for repeatability."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {}
    if master and master.startswith("local["):
        conf = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions),
                             "spark.driver.memory": os.environ.get("TABSIEVE_DRIVER_MEMORY", "16g")}
    conf |= extra or {}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must point at shared storage and is only read.
    When it is unset and the master is local (tests, bench) a scratch folder
    under /tmp is created and registered. A non-local master without the
    setting is an error: a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tabsieve-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabsieve`` importable in the Python workers of a local session
    (the functions run by ``mapInPandas`` refer to module-level helpers),
    whatever the working directory: the package is zipped and registered
    once per application with ``addPyFile``, as ``--py-files`` would. On a
    cluster the package is deployed with the job (``--py-files`` or an
    installed wheel), so nothing is written here. Skipped when the package
    is not a plain folder (already installed as a wheel/zip)."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or not sc.master.startswith("local"):
        return
    pkg = Path(__file__).resolve().parent
    if not (pkg / "__init__.py").exists():
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    out_dir = Path(tempfile.mkdtemp(prefix="tabsieve-pyfiles-"))
    target = out_dir / "tabsieve.zip"
    target.write_bytes(buf.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
