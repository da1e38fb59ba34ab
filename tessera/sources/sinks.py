"""Sinks: result tables in any of Spark's formats, small results as text, nested values as flat columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")
#: Rows that a table shown as text may have.
SHOWN = 1000


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Write a result table. The committer makes it visible as a whole: readers see what was there before, or all of it."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    out = df.write.mode(mode).format(fmt)
    out = out.option("header", True) if fmt == "csv" else out
    (out.partitionBy(*by) if by else out).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    source = spark.read.format(fmt)
    source = source.option("header", True) if fmt == "csv" else source
    return (source.schema(schema) if schema else source).load(path)


def to_text(df: DataFrame) -> str:
    """A small result as aligned columns; a result of more than SHOWN rows is an error, not a cut."""
    rows = df.limit(SHOWN + 1).collect()
    if len(rows) > SHOWN:
        raise ValueError(f"more than {SHOWN} rows: write the table instead")
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(c, width, strict=True)).rstrip() for c in cells) + "\n"


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """df with every field of a struct as a column of its own, named by its path."""

    def columns(schema: T.StructType, path: list[str]) -> list:
        out = []
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += columns(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)))
        return out

    return df.select(*columns(df.schema, []))


def unflatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """The reverse of :func:`flatten`: columns whose names share a first part become fields of one struct."""

    def nest(paths: list[list[str]], level: int) -> list:
        out = []
        for first in dict.fromkeys(p[level] for p in paths):
            own = [p for p in paths if p[level] == first]
            if len(own) == 1 and len(own[0]) == level + 1:
                out.append(F.col(f"`{separator.join(own[0])}`").alias(first))
            else:
                out.append(F.struct(*nest(own, level + 1)).alias(first))
        return out

    return df.select(*nest([c.split(separator) for c in df.columns], 0))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all of the columns; the ones it lacks are named in the error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
