"""Readers and writers of records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwright.functions import semistructured as ss

JSON_COLUMNS = ("messages", "tools", "reward_model", "extra_info")
STORED_COLUMNS = ("messages", "prompt", "tools", "reward_model", "extra_info")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows; a missing path raises."""
    return spark.read.parquet(path)


def parse_json_columns(df: DataFrame, columns: tuple[str, ...] = JSON_COLUMNS) -> DataFrame:
    """Text columns as VARIANT; text that does not parse stays in ``<name>_raw``."""
    for c in columns:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            value = F.try_parse_json(F.col(c))
            df = df.withColumn(f"{c}_raw", F.when(value.isNull(), F.col(c))).withColumn(c, value)
    return df


def number_lines(lines: DataFrame) -> DataFrame:
    """``idx`` from 0 in file order, by file part and place within it; blank and bad lines count too.

    Reading order is that of (file, offset of the block, line): rows of a text split come in order, and splits are
    numbered by their start, so that one count a split gives all first numbers."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    counts = placed.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return placed.withColumn("_w", within).join(counts, ["_f", "_b"]).select((F.col("_first") + F.col("_w")).alias("idx"), "value")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value, ok) of JSON lines: blank lines are dropped, lines that are no JSON are not ok, all count for idx."""
    lines = number_lines(spark.read.text(path))
    return parse_lines(lines.withColumnRenamed("value", "cell")).withColumnRenamed("cell", "value")


def parse_lines(lines: DataFrame, cell: str = "cell") -> DataFrame:
    """Lines that are not blank, and whether each parses."""
    bare = F.trim(F.coalesce(F.col(cell), F.lit("")))
    return lines.where(bare != "").withColumn("ok", F.try_parse_json(bare).isNotNull())


def read_json_array(spark: SparkSession, path: str, allow_data: bool = True) -> DataFrame:
    """Items of a JSON list, or of the list under ``data``, as JSON texts; anything else raises."""
    whole = spark.read.text(path, wholetext=True)
    data = F.get_json_object("value", "$.data") if allow_data else F.lit(None).cast("string")
    listed = F.when(ss.kind(F.col("value")) == "array", F.col("value")).when(ss.kind(data) == "array", data)
    checked = F.coalesce(listed, F.raise_error(F.lit("expected a JSON list")).cast("string"))
    return whole.select(F.explode(F.from_json(checked, "array<string>")).alias("item"))


def stored(value: Column, kind: str) -> Column:
    """JSON text of a nested value; text as it is; null stays null."""
    if kind == "string":
        return value
    nested = kind.startswith(("array", "struct", "map")) or kind == "variant"
    return F.to_json(value) if nested else value.cast("string")


def json_stable(df: DataFrame, columns: tuple[str, ...] = STORED_COLUMNS) -> DataFrame:
    """Nested columns as JSON text, as rows are kept at rest."""
    kinds = dict(df.dtypes)
    return df.select(*[stored(F.col(c), kinds[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def write_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    json_stable(df).write.mode(mode).parquet(path)


def json_array(df: DataFrame) -> Iterator[str]:
    """A pretty-printed JSON list, piece by piece and partition by partition: the driver holds one partition at a time."""
    empty = True
    for row in df.toJSON().toLocalIterator():
        text = json.dumps(json.loads(row), ensure_ascii=False, indent=2).replace("\n", "\n  ")
        yield ("[" if empty else ",") + "\n  " + text
        empty = False
    yield "[]\n" if empty else "\n]\n"


def write_json_array(df: DataFrame, path: str) -> None:
    """The list as one file of the driver's; large tables are better written as JSON lines."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json_array(df))


def write_split(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> list[str]:
    """The full table, then its train and validation rows beside it; an empty part is not written."""
    written = []
    for name, part in ((path, df.drop(split)), *[(split_path(path, s), df.where(F.col(split) == s).drop(split)) for s in ("train", "val")]):
        if name == path or not part.isEmpty():
            part.write.mode(mode).parquet(name)
            written.append(name)
    return written


def write_parts(df: DataFrame, number: Column, path: str, spread: int = 16) -> DataFrame:
    """The table with ``part``, written in one pass as a folder a part, so that a part is read alone.

    A part's rows go to ``spread`` files at most, each written by a task of its own."""
    numbered = df.withColumn("part", number.cast("long"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith(("map", "variant"))]), F.lit(spread))
    numbered.repartition("part", salt).write.mode("overwrite").partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows that have annotations to a JSON-lines log."""
    df.where(F.size("when2call_annotations") > 0).write.mode("append").json(path)


def with_default_source(df: DataFrame, source: str) -> DataFrame:
    """``data_source`` where the column is missing; a null in it stays."""
    return df if "data_source" in df.columns else df.withColumn("data_source", F.lit(source))


def read_config(path: str) -> dict:
    """A mapping from a JSON or YAML file."""
    text = open(path, encoding="utf-8").read()
    if PurePosixPath(path).suffix == ".json":
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("the top level of a configuration is a mapping")
    return value


def merged(base: dict, over: dict) -> dict:
    """Right-biased recursive merge."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def suffixed_path(path: str, suffix: str = "_forverl") -> str:
    p = PurePosixPath(path)
    return str(p.with_name(p.stem + suffix + p.suffix))


def split_path(path: str, split: str) -> str:
    return suffixed_path(path, f"_{split}")
