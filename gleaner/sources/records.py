"""Scans of crawl records: (url, value) files, tab-separated files, one-value-per-line lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

TEXT_CLASS = "org.apache.hadoop.io.Text"


def scan_pages(spark: SparkSession, path: str | list[str], name_part: str = "") -> DataFrame:
    """Parquet scan of the files whose name contains ``name_part``.

    A folder below ``path`` with such a name is a file written in parts: all of it is read.
    """
    paths = [path] if isinstance(path, str) else path
    if not name_part:
        return spark.read.parquet(*paths)
    named = [_named_files(spark, p, name_part) for p in paths]
    if any(n.where("in_parts").limit(1).collect() for n in named):
        return spark.read.parquet(*[row["path"] for n in named for row in n.orderBy("path").collect()])
    return spark.read.option("pathGlobFilter", f"*{name_part}*").parquet(*paths)


def scan_seq(
    spark: SparkSession,
    path: str,
    value: str = "value",
    name_part: str = "",
    source_file: str = "",
) -> DataFrame:
    """SequenceFile of (Text url, Text value) as two string columns.

    ``source_file`` names a further column for the name of the file each row came from.
    Rows pass a Python worker one by one: convert such files to Parquet once
    (``sinks.writers.write_pages``) and scan that from then on.
    """
    target = f"{path.rstrip('/')}/*{name_part}*" if name_part else path
    rows = spark.sparkContext.sequenceFile(target, TEXT_CLASS, TEXT_CLASS)
    # both are Text: checking each value in Python once more would double the cost
    df = spark.createDataFrame(rows, f"url string, {value} string", verifySchema=False)
    if not source_file:
        return df
    # every partition is a part of one file, so the name holds for all its rows
    return df.withColumn(source_file, F.substring_index(F.input_file_name(), "/", -1))


#: What stands for what in escaped text, in the order of writing; and a null.  Every
#: backslash starts one of these, so reading undoes them in the opposite order.
ESCAPES = (("\\", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
NULL = "\\N"


def _unescaped(part: Column) -> Column:
    value = part
    for plain, written in reversed(ESCAPES):
        value = F.replace(value, F.lit(written), F.lit(plain))
    return F.when(part != NULL, value)


def _tsv_fields(
    spark: SparkSession, path: str, schema: str, escaped: bool = False
) -> tuple[DataFrame, Column, list]:
    fields = StructType.fromDDL(schema).fields
    parts = F.split("value", "\t")
    texts = [F.get(parts, F.lit(i)) for i in range(len(fields))]
    nulls = [t == NULL if escaped else F.lit(False) for t in texts]
    columns = [(_unescaped(t) if escaped else t).try_cast(f.dataType) for t, f in zip(texts, fields, strict=True)]
    fits = F.size(parts) >= len(fields)
    for field, column, null in zip(fields, columns, nulls, strict=True):
        if field.dataType != StringType():
            fits = fits & (column.isNotNull() | null)
    named = [c.alias(f.name) for f, c in zip(fields, columns, strict=True)]
    return spark.read.text(path), fits, named


def scan_tsv(
    spark: SparkSession, path: str, schema: str, strict: bool = False, escaped: bool = False
) -> DataFrame:
    """Tab-separated text without quoting; further fields of a line are ignored.

    ``escaped`` reads what ``write_tsv(.., escape=True)`` wrote.

    Lines with too few fields or with text in a number column are left out
    (see :func:`tsv_misfits`), or raise if ``strict``.
    """
    lines, fits, columns = _tsv_fields(spark, path, schema, escaped)
    if strict:
        error = F.raise_error(F.concat(F.lit("line does not fit the schema: "), "value"))
        fits = F.when(fits, F.lit(True)).otherwise(error.cast("boolean"))
    return lines.where(fits).select(*columns)


def tsv_misfits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that :func:`scan_tsv` leaves out."""
    lines, fits, _ = _tsv_fields(spark, path, schema)
    return lines.where(~F.coalesce(fits, F.lit(False)))


def _named_files(spark: SparkSession, path: str, name_part: str) -> DataFrame:
    """``path, in_parts``: data files whose name contains ``name_part``, and folders of files with such a name.

    A file below several folders of that kind belongs to the outermost one; ``path`` itself is none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    if not name_part:
        return files.select("path", F.lit(False).alias("in_parts"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    depth = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).depth()
    steps = F.split(plain_path(F.col("path")), "/")  # the first one is empty
    below = F.slice(steps, F.lit(depth + 2), F.size(steps))
    below = F.when(F.size(below) > 0, below).otherwise(F.slice(steps, -1, 1))  # ``path`` is a file
    place = F.array_position(F.transform(below, lambda name: F.contains(name, F.lit(name_part))), True)
    rest = F.slice(below, place + 1, F.size(below))
    named = files.select("path", F.array_join(F.transform(rest, lambda name: F.concat(F.lit("/"), name)), "").alias("rest"), place.alias("place"))
    named = named.where("place > 0")
    return named.select(F.expr("left(path, length(path) - length(rest))").alias("path"), F.expr("rest <> ''").alias("in_parts")).distinct()


def first_files(
    spark: SparkSession, path: str, max_files: int, name_part: str = ""
) -> list[str]:
    """The first ``max_files`` file paths by name; the files themselves are not read.

    A folder whose name contains ``name_part`` counts as one file, written in parts.
    """
    rows = _named_files(spark, path, name_part).select("path").orderBy("path").limit(max_files).collect()
    return [row["path"] for row in rows]


def scan_first_files(
    spark: SparkSession, path: str, max_files: int, name_part: str = ""
) -> DataFrame:
    """Parquet scan of at most ``max_files`` files."""
    return scan_pages(spark, first_files(spark, path, max_files, name_part))


def read_list(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """A side list, one value per line, of any length: a table for the joins of ``operators.joins``."""
    return spark.read.text(path).select(F.col("value").alias(column))


def read_parameters(spark: SparkSession, path: str) -> list[str]:
    """A side list that is a parameter of a job, such as keywords: it goes into every task."""
    return [row["value"] for row in read_list(spark, path).collect()]


def with_source_file(df: DataFrame, column: str = "meta_file") -> DataFrame:
    """Add the name of the file each row was read from; use directly on a scan."""
    return df.withColumn(column, F.col("_metadata.file_name"))


def with_source_path(df: DataFrame, column: str = "arc_path", prefix: str = "") -> DataFrame:
    """Add the full path of each row's file, without the host and ``prefix``."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.withColumn(column, without_prefix(path, prefix))


SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def plain_path(path: Column) -> Column:
    """A path as it is below its file system: no scheme, no host, one leading slash.

    ``/d/x``, ``file:/d/x``, ``file:///d/x`` and ``hdfs://host:1/d/x`` all give ``/d/x``.
    """
    return F.regexp_replace(F.regexp_replace(path, SCHEME_AND_HOST, ""), "^/+", "/")


def without_prefix(path: Column, prefix: str) -> Column:
    """The plain path without ``prefix``, in whatever form that is given, at its start."""
    plain = plain_path(path)
    if not prefix:
        return plain
    start = plain_path(F.lit(prefix))
    return F.when(F.startswith(plain, start), F.substring(plain, F.length(start) + 1, F.length(plain))).otherwise(plain)
