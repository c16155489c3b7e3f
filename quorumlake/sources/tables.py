"""Reading and writing tables and run files."""

from __future__ import annotations

import io
import json
import re
import tempfile
import tomllib
import uuid
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.text import first_filled, fuel, number, status

NAMES = ("name", "name_vi", "name_en", "plant_name", "plant")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a session
    whose executors are threads of this machine (as in tests); any other session is told to set it."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="quorumlake-"))
    return _local[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a written table that nothing needs any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory CSV files as text columns with normalised headers and the file's name; nothing is inferred."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_file", F.col("_metadata.file_name"))
    return raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])


def entities(rows: DataFrame) -> DataFrame:
    """Typed entities of inventory rows: the first filled name, fuel and status as categories, capacity as a number.
    Rows without a name or with a negative capacity are dropped."""
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = rows.select(
        first_filled(*[text(c) for c in NAMES]).alias("name"),
        fuel(text("fuel")).alias("fuel"),
        status(text("status")).alias("status"),
        first_filled(text("cod")).alias("cod"),
        first_filled(text("province")).alias("province"),
        number(F.regexp_replace(text("capacity_mwe"), ",", "")).alias("capacity_mwe"),
        *[F.col(c) for c in ("_file",) if c in have],
    )
    return out.where("name is not null and (capacity_mwe is null or capacity_mwe >= 0)")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Reply documents (one JSON object a file): response text or turns, usage and the model and run of the file name."""
    schema = "response string, turns array<struct<role: string, content: string>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint>, finish_reason string, error string, model_metadata struct<context_window: bigint>"
    return with_run(spark.read.schema(schema).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name")), F.col("_file"))


def with_run(df: DataFrame, file: Column) -> DataFrame:
    """Adds model and run from ``{model}-run{n}`` of a file name."""
    return df.withColumn("model", F.regexp_extract(file, r"^(.*)-run\d+", 1)).withColumn("run", F.regexp_extract(file, r"-run(\d+)", 1).try_cast("int"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_texts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, text): whole files, line ends made \\n. Bytes that are no UTF-8 become replacement characters, or, if
    ``strict``, give a file no text."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw) if strict else F.make_valid_utf8(raw)
    return files.select("file", F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def corpus(texts: DataFrame, between: str = "\n\n") -> DataFrame:
    """(text) of all of a short list of files, in the order of their names: one row, so a corpus that fits one."""
    parts = F.array_sort(F.collect_list(F.struct("file", "text")))
    return texts.agg(F.array_join(F.transform(parts, lambda x: x["text"]), between).alias("text"))


def without(rows: DataFrame, file: str, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Rows of files whose names begin and end with none of the given ones."""
    skip = F.lit(False)
    for x in prefixes:
        skip = skip | F.col(file).startswith(x)
    for x in suffixes:
        skip = skip | F.col(file).endswith(x)
    return rows.where(~skip)


def has_column(spark: SparkSession, path: str, column: str) -> bool:
    """Whether the header of CSV files names a column; only the header is read."""
    return column in [c.strip() for c in spark.read.csv(path, header=True).columns]


def named_rows(rows: DataFrame, name: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows of some kinds (trimmed) that have a name, the name trimmed."""
    return rows.where(F.trim(kind).isin(kinds) & (F.trim(F.coalesce(name, F.lit(""))) != "")).withColumn(name, F.trim(name))


_ODS = {"table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}


def _sheet_rows(sheet: str):
    def rows(batches):
        of = lambda p, n: f"{{{_ODS[p]}}}{n}"
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                root, out, at = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml")), [], 0
                for table_ in root.iter(of("table", "table")):
                    if table_.get(of("table", "name")) != sheet:
                        continue
                    for row in table_.iter(of("table", "table-row")):
                        cells: list[str] = []
                        blanks = 0  # empty cells count once a filled one follows, however often they are repeated
                        for cell in row:
                            if cell.tag in (of("table", "table-cell"), of("table", "covered-table-cell")):
                                text = "\n".join("".join(p.itertext()) for p in cell.iter(of("text", "p")))
                                n = int(cell.get(of("table", "number-columns-repeated"), 1))
                                if text:
                                    cells += [""] * blanks + [text] * n
                                blanks = 0 if text else blanks + n
                        times = int(row.get(of("table", "number-rows-repeated"), 1))
                        out += [(at + k, cells) for k in range(times if cells else 0)]
                        at += times
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out)), pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.list_(pa.string()))], ["path", "row_no", "cells"])

    return rows


def read_ods(spark: SparkSession, path: str, sheet: str, columns: dict[str, str], header: int = 0) -> DataFrame:
    """The columns of a sheet (by header name, renamed) as texts, from the row after ``header`` on; empty cells are null,
    rows without any cell are left out. A header that the sheet lacks is an error."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_sheet_rows(sheet), "path string, row_no long, cells array<string>")
    heads = rows.where(F.col("row_no") == header).select("path", F.col("cells").alias("_head"))
    at = lambda name: F.array_position("_head", name)
    missing = F.filter(F.array(*map(F.lit, columns)), lambda c: ~F.array_contains("_head", c))
    body = rows.where(F.col("row_no") > header).join(heads, "path").where("size(cells) > 0")
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("columns not in the sheet: "), F.array_join(missing, ", "))))
    value = lambda name: F.coalesce(checked.cast("string"), F.nullif(F.get("cells", (at(name) - 1).cast("int")), F.lit("")))
    return body.select("row_no", *(value(name).alias(out) for name, out in columns.items()))


def read_config(path: str) -> dict:
    """A TOML or YAML file of settings, on the driver (YAML where its library is installed)."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            return tomllib.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def config_table(spark: SparkSession, entries: dict[str, dict], key: str) -> DataFrame:
    """A row for each entry of a registry (name -> settings), all settings as texts; null where an entry lacks one."""
    names = sorted({k for x in entries.values() for k in x})
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    schema = ", ".join(f"`{c}` string" for c in [key, *names])
    return spark.createDataFrame([(k, *(text(x.get(c)) for c in names)) for k, x in sorted(entries.items())], schema)


def artifact_paths(rows: DataFrame, path: str) -> DataFrame:
    """``rows``, of which an absolute path or one that goes up a folder is an error."""
    bad = F.col(path).startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return rows.withColumn(path, F.when(bad, F.raise_error(F.concat(F.lit("not a path inside the repository: "), F.col(path))).cast("string")).otherwise(F.col(path)))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_records(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order, ranges of it to a file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """More rows for a folder of CSV files, each file with its header."""
    df.write.mode("append").option("header", True).csv(path)


def write_mart(df: DataFrame, path: str) -> None:
    """Parquet by record kind, so that a view reads its kind only."""
    df.write.mode("overwrite").partitionBy("record_kind").parquet(path)


def merge_mart(rows: DataFrame, path: str, keys: list[str], kind: str = "record_kind") -> None:
    """Records by kind (a plain word), one for each of ``keys`` (not null): ``rows``, of which equal ones count once, take the place of those
    that the mart has with their keys, of whatever kind; a batch that is written twice changes nothing.

    Only the kinds that lose or gain a record are written again: they are put together in a folder of their own first, as
    the mart can't be read and overwritten at once, then put in place by dynamic overwriting; a kind that has no record left
    goes. Two rows of a key that differ are an error.
    """
    spark = rows.sparkSession
    new = written(rows.distinct(), "mart-batch")
    if not new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"a batch with several records of one key {keys}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        new.write.partitionBy(kind).parquet(path)
        return
    old = spark.read.parquet(path)
    left = old.join(new.select(*keys), keys, "left_semi").select(kind).distinct()
    touched = [r[0] for r in left.union(new.select(kind)).distinct().collect()]  # kinds are few: each is a folder
    kept = old.where(F.col(kind).isin(touched)).join(new.select(*keys), keys, "left_anti")
    merged = written(kept.unionByName(new), "mart-merged")
    there = {r[0] for r in merged.select(kind).distinct().collect()}
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind).parquet(path)
    for gone in set(touched) - there:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{kind}={gone}"), True)
    dropped(new)
    dropped(merged)
