"""CSV and Parquet tables with declared schemas."""

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostweave import schemas
from hostweave.operators.clean import normalise_nulls, with_optional_column


def header_forms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by their header line.

    A file's header is the first line of the block that starts it, so only first
    blocks are looked at; per file one line reaches the driver, which lists the
    files anyway.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.withColumn("row", F.monotonically_increasing_id()).filter("at = 0").groupBy("file").agg(
        F.min_by("value", "row").alias("header"))
    forms: dict[str, list[str]] = {}
    for row in first.collect():
        forms.setdefault(row["header"].rstrip("\r"), []).append(row["file"])
    return {header: sorted(files) for header, files in sorted(forms.items())}


def read_csv(spark: SparkSession, path: str, multiline: bool = False, placed: bool = False) -> DataFrame:
    """All columns as text, by the header name of each file.

    Files may order their columns differently; files with one header are read
    together. Identifiers contain backslashes, so the quote character is the only
    escape. ``multiline`` is for files with line breaks inside quoted fields; such
    a file cannot be split, so it is read by one task. ``placed`` adds ``__file``,
    ``__block`` and ``__row``, from which input order can be told.
    """
    forms = header_forms(spark, path)
    parts = []
    for files in forms.values() if len(forms) > 1 else [path]:
        part = spark.read.csv(
            files, header=True, quote='"', escape='"', multiLine=multiline,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        names = part.columns
        if placed:
            part = part.select(
                *names, F.col("_metadata.file_path").alias("__file"),
                F.col("_metadata.file_block_start").alias("__block"),
                F.monotonically_increasing_id().alias("__row"))
        parts.append(normalise_nulls(part, names))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_file_position(placed: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of ``read_csv(..., placed=True)`` in input order: by file name, then as written.

    Rows of a block are numbered inside the block and blocks by the rows before
    them, so nothing is sorted but one row per block.
    """
    block = ["__file", "__block"]
    sizes = placed.groupBy(*block).agg(
        F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(
        Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*block, "__first", before.alias("__before"))
    return placed.join(starts, block).withColumn(
        name, F.col("__before") + F.col("__row") - F.col("__first")).drop(
        *block, "__row", "__first", "__before")


def _typed(
    df: DataFrame, schema: str, renamed: dict[str, str] | None = None, optional: Sequence[str] = ()
) -> DataFrame:
    """Cast text columns to the declared schema.

    A column the source lacks is an error unless it is ``optional``, and so is a
    text that does not parse.
    """
    df = df.withColumnsRenamed(renamed or {})
    wanted = [part.split() for part in schema.split(",")]
    missing = [n for n, _ in wanted if n not in df.columns and n not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name in optional:
        df = with_optional_column(df, name)
    return df.select(*[_strict(name, data_type).alias(name) for name, data_type in wanted])


def _cast(name: str, data_type: str) -> Column:
    if data_type == "INT":
        # Whole numbers may be written as "53.0"; any other fraction does not parse.
        number = F.col(name).try_cast("double")
        return F.when(number == F.rint(number), number.try_cast("int"))
    if data_type == "STRING":
        return F.col(name)
    return F.col(name).try_cast(data_type)


def _unreadable(name: str, data_type: str) -> Column:
    return F.col(name).isNotNull() & _cast(name, data_type).isNull()


def _strict(name: str, data_type: str) -> Column:
    if data_type == "STRING":
        return F.col(name)
    return F.when(_unreadable(name, data_type), F.raise_error(
        F.concat(F.lit(f"{name} is not a {data_type}: "), F.col(name).cast("string")))).otherwise(
        _cast(name, data_type))


_EVENT_NAMES = {"timestamp": "ts", "predicate_object": "object"}


def _event_texts(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """Event columns as read; without an ``ordinal`` column rows are numbered as the files hold them."""
    texts = read_csv(spark, path, multiline, placed=True).withColumnsRenamed(_EVENT_NAMES)
    if "ordinal" in texts.columns:
        return texts.drop("__file", "__block", "__row")
    return with_file_position(texts)


def read_events(
    spark: SparkSession, path: str, multiline: bool = False, reject: bool = False
) -> DataFrame:
    """Event log. Input order is the column ``ordinal`` or, without it, the order in the files.

    A row with an unreadable number or time is an error; with ``reject`` such rows
    are left to ``rejected_events``.
    """
    texts = _event_texts(spark, path, multiline)
    if reject:
        texts = texts.filter(~_any_unreadable(texts, schemas.EVENTS))
    return _typed(texts, schemas.EVENTS, optional=["object"])


def rejected_events(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The rows that ``read_events(..., reject=True)`` leaves out, as texts."""
    texts = _event_texts(spark, path, multiline)
    return texts.filter(_any_unreadable(texts, schemas.EVENTS))


def _any_unreadable(df: DataFrame, schema: str) -> Column:
    parts = [part.split() for part in schema.split(",")]
    return functools.reduce(
        lambda a, b: a | b, [_unreadable(n, t) for n, t in parts if n in df.columns and t != "STRING"])


def read_subjects(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return _typed(read_csv(spark, path, multiline), schemas.SUBJECTS)


def read_network(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return _typed(read_csv(spark, path, multiline), schemas.NETWORK)


def read_files(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return _typed(read_csv(spark, path, multiline), schemas.FILES)


def read_registry(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return _typed(read_csv(spark, path, multiline), schemas.REGISTRY)


def registry_values(registry: DataFrame) -> DataFrame:
    """``value_name``, a printed record, as columns."""
    def field(name: str) -> Column:
        """A printed value: in single quotes, in double quotes if it holds a single one, or bare."""
        shape = (rf"'{name}': (?:b?'((?:[^'\\]|\\.)*)'|b?\"((?:[^\"\\]|\\.)*)\"|([^,}}]*))")
        parts = [F.regexp_extract("value_name", shape, i) for i in (1, 2, 3)]
        bare = F.when((parts[2] != "") & (parts[2] != "None"), parts[2])
        return F.coalesce(*[F.when(p != "", p) for p in parts[:2]], bare)
    return registry.select(
        "uuid", "key", field("size").try_cast("int").alias("value_size"),
        field("type").alias("value_type"), field("valueDataType").alias("value_data_type"),
        (field("isNull") == "True").alias("value_is_null"), field("name").alias("value_name"),
        field("valueBytes").alias("value_bytes"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("timestampNTZFormat", schemas.TIMESTAMP_FORMAT).csv(
        path, header=True, quote='"', escape='"', nullValue="None")


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def labels_with_graphs(labels: DataFrame, graphs: DataFrame) -> DataFrame:
    """Label rows whose window has a graph."""
    return labels.join(graphs.select("window_start"), "window_start", "left_semi")
