"""Read, describe and write panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}
_DATETIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
# The default text patterns stop at milliseconds.
_TEXT_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
}

_QUOTING = {"quote": '"', "escape": '"'}


def format_of(path: str) -> str:
    for suffix, name in _FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return name
    raise ValueError(f"unsupported file format: {path}")


def load_panel(
    spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read a CSV (with header), JSON (array of records), JSON-lines or parquet file or folder, chosen by its suffix.

    Give ``schema`` for large text files: types are otherwise inferred, which reads the data once more. Quoted CSV values
    may hold line breaks and doubled quotes; ``multiline=False`` rules line breaks out and lets large files be split.
    """
    name = format or format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if name == "csv":
        return reader.options(**_QUOTING).csv(path, header=True, inferSchema=schema is None, multiLine=multiline)
    if name == "json":
        return reader.json(path, multiLine=True)
    if name == "jsonl":
        return reader.json(path)
    if name == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported file format: {name}")


def write_panel(
    df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None
) -> None:
    """Write parquet, CSV (with header) or JSON lines; ``partition_by`` lays files out for partition pruning."""
    name = format or format_of(path)
    writer = df.write.mode(mode)
    if name != "parquet":
        writer = writer.options(**_TEXT_TIMES)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name == "parquet":
        writer.parquet(path)
    elif name == "csv":
        kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        writer.options(**_QUOTING, **kept).csv(path, header=True)
    elif name in ("json", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(f"unsupported file format: {name}")


def _is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if _is_datetime(t):
        return "datetime"
    return "categorical" if isinstance(t, T.StringType) else "other"


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, kind, rows, missing values. One pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(_kind(f.dataType)).alias("kind"),
            F.col("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("missing"),
        )
        for i, f in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*rows)))


def format_datetimes(df: DataFrame) -> DataFrame:
    """Every date or timestamp column as ``yyyy-MM-dd HH:mm:ss`` text."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.date_format(c, _DATETIME_PATTERN).alias(f.name) if _is_datetime(f.dataType) else c

    return df.select(*[text(f) for f in df.schema])
