"""Event cleaning: allow-list, identifiers, missing columns, duplicates."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hostweave.functions.ids import clean_id, clean_object_id
from hostweave.schemas import GRAPH_EVENT_TYPES, NULL_TOKENS


def keep_event_types(
    events: DataFrame, allowed: Sequence[str] | None = GRAPH_EVENT_TYPES, column: str = "type"
) -> DataFrame:
    """Rows whose type is on the list; ``None`` keeps every row."""
    if allowed is None:
        return events
    return events.filter(F.col(column).isin(list(allowed)))


def normalise_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Texts that stand for a missing value become null."""
    chosen = columns if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns(
        {c: F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)) for c in chosen})


def with_optional_column(df: DataFrame, name: str, data_type: str = "string") -> DataFrame:
    """Add ``name`` as null if the source does not have it."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(data_type))


def clean_identifiers(
    events: DataFrame, null_subject: str | None = None, double_quoted: bool = True
) -> DataFrame:
    """Decode subject and object ids.

    Rows without a subject are dropped; ``null_subject="nan"`` keeps them under
    that id instead.
    """
    events = with_optional_column(events, "object")
    subject = clean_id("subject", double_quoted)
    if null_subject is None:
        events = events.filter(F.col("subject").isNotNull())
    else:
        subject = F.coalesce(subject, F.lit(null_subject))
    return events.withColumns(
        {"subject": subject, "object": clean_object_id("object", double_quoted)})


def drop_duplicate_records(records: DataFrame, key: str = "uuid") -> DataFrame:
    """One row per record id; copies of a record are identical, so any one will do."""
    return records.dropDuplicates([key])


def graph_events(
    events: DataFrame,
    allowed: Sequence[str] | None = GRAPH_EVENT_TYPES,
    null_subject: str | None = None,
) -> DataFrame:
    """The event rows that go into window graphs."""
    return clean_identifiers(keep_event_types(events, allowed), null_subject)
