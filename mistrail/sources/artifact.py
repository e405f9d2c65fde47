"""Results as folders of Parquet with a manifest, and their verified reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.config import content_hash


class StaleArtifact(ValueError):
    """What is read was written from another configuration, or has changed since."""


def _digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum, by an aggregate over the rows' hashes."""
    values = [F.col(c) for c in sorted(df.columns)]
    row = F.xxhash64(*values)
    n, x, s = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1_000_003)))).first()
    return n, f"{(x or 0) & (2**64 - 1):016x}{s or 0:x}"


def write_artifact(tables: dict[str, DataFrame], path: str, config: object, partition_by: str | None = "match_id") -> dict:
    """Each table under path/name, and path/manifest with rows, schema, checksum and the configuration's hash.

    Checksums are of what was written, read back; the manifest is written last.
    """
    spark = next(iter(tables.values())).sparkSession
    sections = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{path}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        rows, checksum = _digest(written)
        sections.append({"name": name, "rows": rows, "checksum": checksum, "schema": df.schema.json()})
    manifest = {"config": content_hash(config), "sections": sections}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_artifact(spark: SparkSession, path: str, config: object | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of an artifact. Raises StaleArtifact if ``config`` isn't the one it was written from, or if a table's
    rows or checksum differ from the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if config is not None and manifest["config"] != content_hash(config):
        raise StaleArtifact(f"{path} was written from configuration {manifest['config']}, not {content_hash(config)}")
    from pyspark.sql.types import StructType

    tables = {}
    for section in manifest["sections"]:
        df = spark.read.schema(StructType.fromJson(json.loads(section["schema"]))).parquet(f"{path}/{section['name']}")
        if verify and _digest(df) != (section["rows"], section["checksum"]):
            raise StaleArtifact(f"{path}/{section['name']} has changed since it was written")
        tables[section["name"]] = df
    return tables
