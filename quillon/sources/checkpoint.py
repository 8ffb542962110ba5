"""Checkpoints: a Parquet table and a manifest, written beside the target and renamed into place.

The manifest holds all settings, the row count and a checksum that does not depend on row order (the sum of row hashes),
so that a missing, cut or altered file is noticed when the checkpoint is read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AlreadyExists, EngineConfig, InvalidArgument, NotFound

MAGIC, VERSION = "quillon-checkpoint", 1


def _sum(table: DataFrame) -> tuple[int, int]:
    crc = F.crc32(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(crc), F.lit(0))).first()
    return n, total


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write(table: DataFrame, cfg: EngineConfig, path: str, parts: dict[str, DataFrame] | None = None, overwrite: bool = False) -> dict:
    """Writes table as ``records`` and further tables (indexes) under one manifest, which is returned. ``lists`` go by their cid."""
    spark = table.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise AlreadyExists(path)
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    manifest = {"magic": MAGIC, "version": VERSION, "config": cfg.as_dict(), "tables": {}}
    for name, df in {"records": table, **(parts or {})}.items():
        (df.write.partitionBy("cid") if name == "lists" else df.write).parquet(f"{tmp}/{name}")
        n, total = _sum(spark.read.schema(df.schema).parquet(f"{tmp}/{name}"))
        manifest["tables"][name] = {"rows": n, "checksum": total, "schema": df.schema.json()}
    out = fs.create(_fs(spark, f"{tmp}/manifest.json")[0])
    out.write(json.dumps(manifest, indent=1).encode())
    out.close()
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(_fs(spark, tmp)[0], target):
        raise InvalidArgument(f"cannot rename to {path}")
    return manifest


def read(spark: SparkSession, path: str) -> tuple[EngineConfig, dict[str, DataFrame]]:
    """The settings and the tables, after their counts and checksums have been compared."""
    at, fs = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        raise NotFound(path)
    try:
        manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))
    except ValueError as e:
        raise InvalidArgument(f"corrupt manifest in {path}") from e
    if manifest.get("magic") != MAGIC or manifest.get("version") != VERSION:
        raise InvalidArgument(f"{path} is no checkpoint of version {VERSION}")
    tables = {}
    for name, t in manifest["tables"].items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(t["schema"]))).parquet(f"{path}/{name}")
        try:
            found = _sum(df)
        except (AnalysisException, Py4JJavaError) as e:
            raise InvalidArgument(f"corrupt table {name} in {path}") from e
        except Exception as e:
            if "FAILED_READ_FILE" in str(e) or "Parquet" in str(e) or "parquet" in str(e):
                raise InvalidArgument(f"corrupt table {name} in {path}") from e
            raise
        if found != (t["rows"], t["checksum"]):
            raise InvalidArgument(f"corrupt table {name} in {path}")
        tables[name] = df
    return EngineConfig(**manifest["config"]), tables
