"""Output that appears as a whole: several tables at once, reports as Markdown, and words that say what a column is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.derive import escaped
from cadenza.sources.store import Store

CURRENT, REPORT_ROWS = "CURRENT", 1000


def publish(tables: dict[str, DataFrame], folder: str, check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """All tables or none: written under a new version, checked as written, and only then named by the file CURRENT.  A
    version that fails stays unnamed and is removed; readers keep the one before."""
    spark = next(iter(tables.values())).sparkSession
    store, version = Store(spark), f"v-{uuid.uuid4().hex}"
    place = f"{folder.rstrip('/')}/{version}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{place}/{name}")
        if check:
            check({name: spark.read.schema(df.schema).parquet(f"{place}/{name}") for name, df in tables.items()})
    except BaseException:
        store.delete(place)
        raise
    store.write(f"{folder.rstrip('/')}/{CURRENT}", version)
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{Store(spark).read(f'{folder.rstrip("/")}/{CURRENT}')}/{name}")


def commented(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Columns with a comment, kept in Parquet and in the catalog."""
    for name, text in comments.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df


def comments_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema.fields if "comment" in f.metadata}


def shown(c: Column) -> Column:
    """A value in a cell: nulls as a dash, text that could be markup escaped."""
    return F.coalesce(escaped(c.cast("string")), F.lit("-"))


def markdown(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """A table of at most ``rows`` rows, in the order of df; one line says how many more there are."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    found = df.select(*[shown(F.col(f"`{c}`")).alias(c) for c in df.columns]).limit(rows + 1).collect()
    lines += ["| " + " | ".join(r) + " |" for r in found[:rows]]
    return "\n".join(lines + ([f"more than {rows} rows"] if len(found) > rows else []))


def report(title: str, sections: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown(df)}" for name, df in sections.items()]]) + "\n"


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], sources: list[str], every: list[str]) -> str | None:
    """The report of a run over every source.  A run over some of them gives its text and leaves the file as it is."""
    text = report(title, sections)
    if sorted(sources) != sorted(every):
        return text
    Store(spark).write(path, text)
    return None
