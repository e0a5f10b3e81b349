"""Markdown folders as tables, front matter in and out, and versions of a corpus on disk.

Files are read by Spark's binary source; front matter is parsed in Arrow batches, as YAML has no
native expression. Bodies stay in a column of their own, so plans that need only front matter
never decode them. Malformed front matter is a row with ``error`` set, never a failure.
"""

from __future__ import annotations

import json
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.operators.drafts import walked
from thicket.functions.text import content_hash

#: Front matter is looked for in so many bytes at the beginning of a file.
HEAD_BYTES = 262_144
#: Keys that must never be taken from a file.
FORBIDDEN = ("__proto__", "constructor", "prototype")
#: The order of keys when front matter is written; others follow by name.
KEY_ORDER = (
    "id", "type", "depth_role", "depth", "focus", "parents", "shared_covers", "covers", "tags", "domains", "aliases", "overlay_targets", "nests_into",
    "activation", "activation_defaults", "links", "source", "orientation", "generator", "mode", "layout_contract_path",
    "rebuild_needed", "rebuild_reasons", "rebuild_command", "entries", "children",
)


def read_files(spark: SparkSession, root: str, code: bool = False) -> DataFrame:
    """path (below ``root``), raw, size_bytes, hash of every file that a walk reaches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the root as the source writes it: with a scheme or without
    below = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").split("://")[-1].replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    files = files.select(below.alias("path"), F.col("content").cast("string").alias("raw"), F.col("length").alias("size_bytes"))
    return walked(files, "path", code).withColumn("hash", content_hash(F.col("raw")))


def _plain(value):
    """Dates as text, forbidden keys left out, everything else as it is."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items() if str(k) not in FORBIDDEN}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def split_matter(raw: str) -> tuple[str | None, str]:
    """The front matter block of a text, and its body; fences must use one kind of line end."""
    for end in ("\n", "\r\n"):
        fence = "---" + end
        if raw.startswith(fence):
            head = raw[: HEAD_BYTES]
            at = len(fence) - len(end) if head.startswith(fence + fence) else head.find(end + fence, len(fence) - len(end))
            if at >= 0:
                return raw[len(fence) : at + len(end)], raw[at + len(end) + len(fence) :]
            if head.rstrip("\r\n").endswith(end + "---"):
                at = head.rstrip("\r\n").rfind(end + "---")
                return raw[len(fence) : at + len(end)], ""
            raise ValueError("front matter isn't closed")
    return None, raw


def parse_matter(raw: str | None) -> tuple[dict, str, str | None]:
    """Data, body and error of a text."""
    import yaml

    try:
        block, body = split_matter((raw or "").removeprefix("﻿"))
        data = yaml.safe_load(block) if block else {}
        if data is not None and not isinstance(data, dict):
            return {}, raw or "", "front matter is no mapping"
        return _plain(data or {}), body, None
    except Exception as e:  # malformed front matter is data, not a failure
        return {}, raw or "", str(e).splitlines()[0][:200]


_SHAPE = "id string, type string, depth_role string, focus string, covers array<string>, tags array<string>, parents array<string>, aliases array<string>, overlay_targets array<string>, extra_json string, body string, error string"
_LISTS = ("covers", "tags", "parents", "aliases", "overlay_targets")


def entries_of(files: DataFrame) -> DataFrame:
    """``files`` (path, raw, …) with the fields of their front matter, the rest as JSON, and the body."""
    keep = [c for c in files.columns if c != "raw"]
    strings = lambda v: None if v is None else [str(x) for x in (v if isinstance(v, list) else [v]) if x is not None]

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(b.num_columns - 1):
                data, body, error = parse_matter(raw.as_py())
                row = {k: (None if data.get(k) is None else str(data[k])) for k in ("id", "type", "depth_role", "focus")}
                row |= {k: strings(data.get(k)) for k in _LISTS}
                rest = {k: v for k, v in data.items() if k not in row}
                rows.append(row | {"extra_json": json.dumps(rest, sort_keys=True, ensure_ascii=False, default=str), "body": body, "error": error})
            made = pa.Table.from_pylist(rows, pa.schema([(f, pa.list_(pa.string()) if f in _LISTS else pa.string()) for f in ("id", "type", "depth_role", "focus", *_LISTS, "extra_json", "body", "error")]))
            made = made.combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], made.schema)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *made.columns], names=[*keep, *made.schema.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema) + ", " + _SHAPE
    return files.select(*keep, "raw").mapInArrow(run, schema)


def render_matter(data: dict, body: str = "") -> str:
    """Text with front matter: keys in the fixed order, then the others by name."""
    import yaml

    keys = [k for k in KEY_ORDER if k in data] + sorted(k for k in data if k not in KEY_ORDER and k not in FORBIDDEN)
    block = "".join(yaml.safe_dump({k: data[k]}, sort_keys=False, allow_unicode=True, width=10**6) for k in keys)
    return f"---\n{block}---\n{body}"


def rendered(entries: DataFrame) -> DataFrame:
    """path, text: entries (path, id, type, …, body) as Markdown with front matter."""
    fields = [c for c in entries.columns if c in KEY_ORDER]

    def run(batches):
        for b in batches:
            texts = []
            for r in b.to_pylist():
                texts.append(render_matter({k: r[k] for k in fields if r[k] is not None}, r.get("body") or ""))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("path")), pa.array(texts, pa.string())], names=["path", "text"])

    return entries.select("path", *fields, *(["body"] if "body" in entries.columns else [])).mapInArrow(run, "path string, text string")


# ---------------------------------------------------------------- versions on disk


def write_version(entries: DataFrame, root: str, version: int, op: str, parent: int | None = None) -> None:
    """An immutable version: its entries by wiki, then its line in the log of versions.

    The line is written last, so a version that failed half way is never current.
    """
    entries.write.mode("errorifexists").partitionBy("wiki_id").parquet(f"{root}/entries/version={version}")
    spark = entries.sparkSession
    line = spark.createDataFrame([(version, parent, op)], "version long, parent long, op string").withColumn("at", F.current_timestamp())
    line.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def current_version(spark: SparkSession, root: str) -> int:
    """The version that the latest line of the log names; a rollback is a line that names an old one."""
    return spark.read.parquet(f"{root}/versions").agg(F.max_by("version", F.struct("at", "version"))).first()[0]


def roll_back(spark: SparkSession, root: str, version: int) -> None:
    known = spark.read.parquet(f"{root}/versions").where(F.col("version") == version).limit(1)
    if known.isEmpty():
        raise ValueError(f"no version {version}")
    known.select("version", "parent", F.lit("rollback").alias("op"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/entries/version={version}")
