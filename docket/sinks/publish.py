"""Publication of whole report sets (R23-R25): readers see a set before or after, never between.

``publish_reports`` writes the reports of a run into a fresh folder ``versions/<id>`` and then
commits a manifest ``manifests/<n>.json`` that says for every report which version holds it.
Reports that the run leaves empty keep the version they had, unless ``replace_all``. The
commit is one rename that fails if another run took the number, which is then tried again on
top of that run's manifest; so two runs never lose each other's reports. A run that dies before
its commit leaves a folder that nobody reads.

A manifest has at most twelve entries, whatever the number of cases, and is all that the
driver holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.sinks.reports import write_reports

LINE_DDL = "filename string, line_no bigint, style string, text string"


class Conflict(RuntimeError):
    """Other runs took every manifest number that was tried."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, system = _place(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = (n[: -len(".json")] for n in _names(spark, f"{path}/manifests") if n.endswith(".json"))
    return sorted(int(n) for n in names if n.isdigit())


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """``{"number": n, "reports": {report: version}}``: the latest manifest, or number ``number``."""
    path = path.rstrip("/")
    if number is None:
        number = max(_numbers(spark, path), default=0)
        if not number:
            return {"number": 0, "reports": {}}
    place, system = _place(spark, f"{path}/manifests/{number:012d}.json")
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Put ``manifest`` in place under its number; False if that number is taken."""
    target, system = _place(spark, f"{path}/manifests/{manifest['number']:012d}.json")
    staged, _ = _place(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    stream = system.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode("utf-8")))
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration()) \
        if staged.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            system.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(staged, target, no_overwrite)
        return True
    except Exception:
        if not system.exists(target):
            raise
        system.delete(staged, False)
        return False


def stage_reports(lines: DataFrame, path: str, partitions: int | None = None) -> dict[str, str]:
    """Write ``report_lines`` into a version of their own; ``{report: version}``. No reader sees it yet."""
    spark, path = lines.sparkSession, path.rstrip("/")
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    write_reports(lines, folder, partitions, replace_all=True)
    mine = {}
    for level in _names(spark, folder):
        if level.startswith("folder="):
            for name in _names(spark, f"{folder}/{level}"):
                if name.startswith("name="):
                    mine[f"{level[len('folder='):]}/{name[len('name='):]}"] = version
    return mine


def commit_reports(spark: SparkSession, path: str, staged: dict[str, str], replace_all: bool = False,
                   attempts: int = 20) -> dict:
    """Make staged reports the ones that readers see; returns the manifest."""
    path = path.rstrip("/")
    for _ in range(attempts):
        last = read_manifest(spark, path)
        reports = dict(staged) if replace_all else {**last["reports"], **staged}
        manifest = {"number": last["number"] + 1, "reports": reports}
        if _commit(spark, path, manifest):
            return manifest
    raise Conflict(f"{path}: no manifest number was free in {attempts} attempts")


def publish_reports(lines: DataFrame, path: str, replace_all: bool = False, partitions: int | None = None) -> dict:
    """Write ``report_lines`` beside the published set and commit it; returns the manifest."""
    return commit_reports(lines.sparkSession, path, stage_reports(lines, path, partitions), replace_all)


def read_published(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``(report, filename, line_no, style, text, version)`` of the set that a manifest names.

    The manifest is read when this is called: the DataFrame keeps showing that set.
    """
    path = path.rstrip("/")
    parts = []
    for report, version in sorted(read_manifest(spark, path, number)["reports"].items()):
        folder, name = report.split("/", 1)
        part = spark.read.schema(LINE_DDL).parquet(f"{path}/versions/{version}/folder={folder}/name={name}")
        parts.append(part.select(F.lit(report).alias("report"), "*", F.lit(version).alias("version")))
    if not parts:
        return spark.createDataFrame([], f"report string, {LINE_DDL}, version string")
    out = parts[0]
    for part in parts[1:]:  # at most twelve
        out = out.unionByName(part)
    return out


def drop_unread(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the versions that none of the last ``keep`` manifests names; returns them.

    For times when no run is publishing: a run's version is unnamed until its commit.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    path = path.rstrip("/")
    named: set[str] = set()
    for number in _numbers(spark, path)[-keep:]:
        named |= set(read_manifest(spark, path, number)["reports"].values())
    unread = sorted(set(_names(spark, f"{path}/versions")) - named)
    for version in unread:
        place, system = _place(spark, f"{path}/versions/{version}")
        system.delete(place, True)
    return unread
