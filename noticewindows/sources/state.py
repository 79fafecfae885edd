"""State tables in partitions by firm, with a manifest per version and a pointer that is replaced last.

``root/data/<table>/w=<n>/part=<p>`` holds the rows of some firms as version ``n`` wrote them.  The manifest
``root/MANIFEST.<n>`` names, for every table and partition, the version whose rows are in force; ``root/CURRENT``
names the manifest in force.  A run writes the partitions of the firms that it touched and a new manifest; all
other partitions stay where they are.  A run that dies half way leaves folders that nobody points at.  Writing the
same version again with the same content is harmless, which is what a replayed micro-batch does.  Folders that
neither the manifest in force nor the one before it names are removed after the pointer has moved.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_TABLES = {
    "post_state": """
        firm string, post_key string, content_hash string, last_seen timestamp, url string,
        arrival_seq long, deferred_known boolean
    """,
    "tracked": """
        firm string, post_key string, arrival_seq long, pos long, event_key string, entry_id string,
        event_type string, summary string, start_iso string, end_iso string, evidence string
    """,
    "deferred": """
        firm string, post_key string, event_ord long, event_type string, start_time string,
        end_time string, stated_utc_offset string, affected string, confidence string, evidence string
    """,
    "rejected_lines": "firm string, post_key string, line string",
}

#: Partitions of a new state; an existing one keeps its own number.
PARTS = 64

# What a row written before a column existed means by leaving it out.
_WHEN_ABSENT = {
    "firm": "",
    "url": "",
    "summary": "",
    "start_iso": "",
    "event_type": "",
    "evidence": "",
    "deferred_known": False,
    "confidence": "high",
}
_TEXT_MAY_BE_NULL = {"deferred"}


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.exists(hadoop_path)


def _pointer_lines(spark: SparkSession, root: str) -> list[str]:
    pointer = f"{root}/CURRENT"
    if not _exists(spark, pointer):
        return []
    try:
        rows = spark.read.text(pointer, wholetext=True).limit(1).collect()
    except Exception:  # noqa: BLE001 - a pointer that cannot be read is a corrupt state
        return []
    return rows[0][0].splitlines() if rows else []


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version in force, or None when there is no state."""
    lines = _pointer_lines(spark, root)
    return int(lines[0]) if lines and lines[0].strip().isdigit() else None


def applied_step(spark: SparkSession, root: str) -> str | None:
    """What the version in force was made from, as its writer named it."""
    lines = _pointer_lines(spark, root)
    return lines[1] if len(lines) > 1 else None


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl) for name, ddl in STATE_TABLES.items()}


def upgrade(table: str, df: DataFrame) -> DataFrame:
    """``df`` with every column of the current schema; absent ones get their meaning."""
    target = df.sparkSession.createDataFrame([], STATE_TABLES[table]).schema
    out = []
    for field in target:
        absent = _WHEN_ABSENT.get(field.name)
        if field.name in df.columns:
            value = F.col(field.name).cast(field.dataType)
            if absent is not None and table not in _TEXT_MAY_BE_NULL:
                value = F.coalesce(value, F.lit(absent).cast(field.dataType))
        else:
            value = F.lit(absent).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def part_of(firm: Column, parts: int) -> Column:
    """The partition that holds a firm's rows."""
    return F.pmod(F.xxhash64(firm), F.lit(parts)).cast("int")


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    rows = spark.read.text(f"{root}/MANIFEST.{version}", wholetext=True).limit(1).collect()
    found = json.loads(rows[0][0])
    return {"parts": found["parts"], "tables": {t: {int(p): v for p, v in of.items()} for t, of in found["tables"].items()}}


def parts_of(spark: SparkSession, root: str, firms: DataFrame) -> set[int]:
    """The partitions of ``firms`` in the state in force, and that of rows without a firm where there are any."""
    version = current_version(spark, root)
    known = _manifest(spark, root, version) if version is not None and _exists(spark, f"{root}/MANIFEST.{version}") else {"parts": PARTS, "tables": {}}
    n = known["parts"]
    found = {r[0] for r in firms.select(part_of(F.col("firm"), n)).distinct().collect()}  # at most one row per partition
    blank = spark.range(1).select(part_of(F.lit(""), n)).first()[0]
    if blank not in found:
        for table, of in known["tables"].items():
            if blank in of and not _read(spark, root, table, of, {blank}).filter("firm = ''").isEmpty():
                found.add(blank)
                break
    return found


def _read(spark: SparkSession, root: str, table: str, of: dict[int, int], parts: Iterable[int] | None) -> DataFrame:
    paths = [f"{root}/data/{table}/w={v}/part={p}" for p, v in sorted(of.items()) if parts is None or p in parts]
    if not paths:
        return spark.createDataFrame([], STATE_TABLES[table])
    return upgrade(table, spark.read.option("mergeSchema", "true").parquet(*paths))


def read_state(spark: SparkSession, root: str, parts: Iterable[int] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(tables, warnings)`` of all partitions or of ``parts``; a state that cannot be read counts as empty, with a
    warning row."""
    ddl = "path string, warning string"
    version = current_version(spark, root)
    if version is None:
        pointer = f"{root}/CURRENT"
        found = [(pointer, "state pointer is unreadable; starting empty")] if _exists(spark, pointer) else []
        return empty_state(spark), spark.createDataFrame(found, ddl)
    path = f"{root}/MANIFEST.{version}"
    tables: dict[str, DataFrame] = {}
    try:
        known = _manifest(spark, root, version)
        for name in STATE_TABLES:
            path = f"{root}/data/{name}"
            tables[name] = _read(spark, root, name, known["tables"].get(name, {}), parts)
    except Exception as problem:  # noqa: BLE001 - any unreadable table voids the whole state
        text = str(problem).splitlines()[0]
        warning = [(path, f"state is unreadable; starting empty: {text}")]
        return empty_state(spark), spark.createDataFrame(warning, ddl)
    return tables, spark.createDataFrame([], ddl)


def write_state(
    spark: SparkSession, root: str, version: int, tables: dict[str, DataFrame], step: str = "", parts: set[int] | None = None
) -> None:
    """Write ``tables`` as the content of ``parts`` (None: of the whole state), a manifest, then the pointer: readers
    see the old state or the new, never a mix.

    ``step`` names what the version was made from; it is kept in the pointer.
    """
    before = current_version(spark, root)
    old = _manifest(spark, root, before) if parts is not None and before is not None else {"parts": PARTS, "tables": {}}
    new = {}
    for name in STATE_TABLES:
        rows = upgrade(name, tables[name]).withColumn("part", part_of(F.col("firm"), old["parts"]))
        if parts is not None:
            rows = rows.filter(F.col("part").isin(sorted(parts)))
        folder = f"{root}/data/{name}/w={version}"
        # partitions are made even by size: a large one is split over several files and tasks
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder)
        written = {int(n.removeprefix("part=")) for n in _names(spark, folder) if n.startswith("part=")}
        kept = {} if parts is None else {p: v for p, v in old["tables"].get(name, {}).items() if p not in parts}
        new[name] = {**kept, **dict.fromkeys(written, version)}
    _put(spark, f"{root}/MANIFEST.{version}", json.dumps({"parts": old["parts"], "tables": new}))
    _point(spark, root, version, step)
    _clean(spark, root, version, before)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _filesystem(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _filesystem(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _clean(spark: SparkSession, root: str, version: int, before: int | None) -> None:
    """Remove what neither this version nor the one before it reads; a reader has the time of one run to finish."""
    live = {version, before} - {None}
    named = [_manifest(spark, root, v) for v in live if _exists(spark, f"{root}/MANIFEST.{v}")]
    for name in STATE_TABLES:
        used = {(v, p) for m in named for p, v in m["tables"].get(name, {}).items()}
        for folder in _names(spark, f"{root}/data/{name}"):
            v = int(folder.removeprefix("w="))
            if v > version:
                continue  # a later run is writing it
            if not any(u == v for u, _ in used):
                remove(spark, f"{root}/data/{name}/{folder}")
                continue
            for part in _names(spark, f"{root}/data/{name}/{folder}"):
                if part.startswith("part=") and (v, int(part.removeprefix("part="))) not in used:
                    remove(spark, f"{root}/data/{name}/{folder}/{part}")
    for file in _names(spark, root):
        if file.startswith("MANIFEST.") and int(file.removeprefix("MANIFEST.")) < version and int(file.removeprefix("MANIFEST.")) not in live:
            remove(spark, f"{root}/{file}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


def _point(spark: SparkSession, root: str, version: int, step: str) -> None:
    """Write the pointer beside its place and rename it over the old one."""
    fs, _ = _filesystem(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new = path(f"{root}/CURRENT.{version}.{os.getpid()}")
    _put(spark, new.toString(), f"{version}\n{step}\n")
    target = path(f"{root}/CURRENT")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(target), options)
