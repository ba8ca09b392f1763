"""Readers and writers, and tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrane-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder through Spark's file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for t in tables:
        remove(t.sparkSession, t.staged_path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, a byte order mark allowed; empty fields are null; every column a string without a schema. Line breaks within fields want multi_line, and then a file cannot be split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("nullValue", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_text(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "utf-8", "cp949")) -> DataFrame:
    """(path, text) of whole files, each decoded by the first encoding that fits; none: an error."""

    def run(batches):
        for b in batches:
            texts = []
            for name, content in zip(b["path"], b["content"]):
                for e in encodings:
                    try:
                        texts.append(content.decode(e))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"{name}: none of {encodings}")
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of a GeoJSON collection."""
    return read_json(spark, path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order, others left out, as CSV with a header."""
    df.select(*columns).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, md5) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def lineage(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status, bytes) of files (name, bytes, sha256) against a manifest of the same: ok, changed, missing or unlisted."""
    listed = manifest.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    status = F.when(F.col("h").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") == F.col("h")) & (F.col("bytes") == F.col("b")), "ok").otherwise("changed")
    return found.select("name", "bytes", "sha256").join(listed, "name", "full").select("name", status.alias("status"), F.coalesce("bytes", "b").alias("bytes"))


def read_wide_csv(spark: SparkSession, path: str, key: str, total: str, starts: tuple[str, ...]) -> DataFrame:
    """(key, total): of a wide CSV the sum of all columns whose header begins with one of starts, separators of thousands dropped; a repeated key is an error."""
    rows = read_csv(spark, path)
    wanted = [c for c in rows.columns if c.startswith(starts)]
    if not wanted:
        raise ValueError(f"no column begins with {starts}")
    summed = F.aggregate(F.array(*[F.replace(F.col(f"`{c}`"), F.lit(","), F.lit("")).cast("double") for c in wanted]), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    once = rows.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count("*").alias("n"), F.first(summed).alias(total))
    return once.select(key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(f"`{key}`"))).cast("double")).otherwise(F.col(total)).alias(total))


def read_pages(spark: SparkSession, path: str, max_pages: int = 1000) -> DataFrame:
    """Rows of paged answers kept as JSON files, from either envelope; more files than max_pages, or fewer rows than the total they state, is an error."""
    pages = spark.read.option("multiLine", True).option("primitivesAsString", True).text(path, wholetext=True)
    if pages.count() > max_pages:
        raise ValueError(f"more than {max_pages} pages")
    of = lambda name: F.coalesce(F.get_json_object("value", f"$.body.{name}"), F.get_json_object("value", f"$.response.body.{name}"))
    parts = pages.select(of("totalCount").cast("long").alias("total"), F.coalesce(of("items.item"), of("items")).alias("items"))
    rows = parts.select("total", F.explode(F.from_json(F.when(F.startswith("items", F.lit("[")), F.col("items")).otherwise(F.concat(F.lit("["), "items", F.lit("]"))), "array<map<string,string>>")).alias("row"))
    seen = rows.agg(F.max("total").alias("total"), F.count("*").alias("n")).first()
    if seen.total is not None and seen.n < seen.total:
        raise ValueError(f"{seen.n} rows of {seen.total}")
    return rows.select("row")


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report's table; more rows than most is an error, as a report is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])


def spliced(report: str, heading: str, body: str) -> str:
    """report with the section under heading put anew, or added at its end; what stands before and after stays. Doing it twice changes nothing."""
    lines, section = report.rstrip("\n").split("\n"), [heading, "", *body.strip("\n").split("\n")]
    level = heading.split(" ")[0] + " "
    if heading not in lines:
        return "\n".join([*lines, "", *section]) + "\n"
    at = lines.index(heading)
    end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith(level)), len(lines))
    rest = ["", *lines[end:]] if end < len(lines) else []
    return "\n".join([*lines[:at], *section, *rest]) + "\n"
