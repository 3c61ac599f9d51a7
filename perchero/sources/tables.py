"""Table sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perchero import schemas as S
from perchero.operators.dataset import KEYS, standard_key

CSV_SCHEMAS = {
    "users": S.USERS_CSV,
    "garments": S.GARMENTS_CSV,
    "contexts": S.CONTEXTS_CSV,
    "ratings": S.RATINGS_CSV,
}

# Rows of one written CSV file.
CSV_ROWS = 100_000


class MissingTables(Exception):
    """Required input tables do not exist."""


class MissingColumns(Exception):
    """A file's header lacks required columns."""


def _raw_csv(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path)  # all columns as text, named by the header


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file or folder by column name: any order, further columns are left out.

    An empty field is null, also a quoted one, as the original's reader has it.
    Rows with a value that does not fit its type are left out too; :func:`bad_csv_rows` has them.
    """
    good, _ = _parted_csv(spark, path, schema)
    return good


def bad_csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that :func:`read_csv` leaves out, as text, with the names of the columns that do not fit."""
    _, bad = _parted_csv(spark, path, schema)
    return bad


def _parted_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    raw = _raw_csv(spark, path)
    absent = [c for c in schema.names if c not in raw.columns]
    if absent:
        raise MissingColumns(f"{path} lacks the columns {', '.join(absent)}")
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    wrong = [
        F.when(F.col(f"`{n}`").isNotNull() & value.isNull(), n) for n, value in typed.items()
    ]
    marked = raw.select(*schema.names, F.concat_ws(",", *wrong).alias("_wrong"))
    good = marked.filter(F.col("_wrong") == "").select(*[c.alias(n) for n, c in typed.items()])
    return good, marked.filter(F.col("_wrong") != "").withColumnRenamed("_wrong", "wrong_columns")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
              partitions: int, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table, read in parallel ranges of its integer key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("numPartitions", partitions)
    reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1])
    return reader.options(**dict(options or {})).load()


def read_csv_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """All four CSV tables with standard keys; one error names everything that is missing."""
    tables, missing = {}, []
    for name, schema in CSV_SCHEMAS.items():
        try:
            path = paths[name]
            tables[name] = standard_key(read_csv(spark, path, schema), KEYS[name])
        except KeyError:
            missing.append(name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    if missing:
        raise MissingTables(f"missing input tables: {', '.join(missing)}")
    return tables


def write_csv(table: DataFrame, path: str) -> None:
    """Files of at most ``CSV_ROWS`` rows: where fields may hold line ends, one task reads a whole file."""
    writer = table.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("maxRecordsPerFile", CSV_ROWS).csv(path)


def append_contexts(contexts: DataFrame, path: str, mode: str = "append") -> None:
    """One context row per answered request; streams overwrite the folder of their batch."""
    contexts.write.mode(mode).parquet(path)


def write_params(spark: SparkSession, params: Mapping, path: str) -> None:
    """Model name and parameters as a one-row JSON table."""
    text = json.dumps(dict(params))
    row = spark.range(1).select(F.lit(text).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
