"""Output shaping shared by every registered query, and its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9


def flat(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floats rounded, arrays joined with '|', maps as sorted k=v text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), DIGITS)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
                column = F.transform(column, lambda item: F.round(item, DIGITS))
            column = F.array_join(column.cast("array<string>"), "|")
        elif isinstance(kind, T.MapType):
            entries = F.transform(
                F.map_entries(column),
                lambda entry: F.concat(entry["key"].cast("string"), F.lit("="), entry["value"].cast("string")),
            )
            column = F.array_join(F.array_sort(entries), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _items(text: str) -> list[tuple[str, str]]:
    out = []
    for part in text.split(";"):
        if part.strip():
            name, _, expression = part.strip().partition(":=")
            out.append((name.strip(), expression.strip() or name.strip()))
    return out


def cols(ints: str = "", dbls: str = "", raw: str = "", arrs: str = "", strs: str = "") -> str:
    """DuckDB select list with the same shaping; each part is ``name`` or ``name := expression``."""
    out = [f"cast({e} as bigint) as {n}" for n, e in _items(ints)]
    out += [f"round(cast({e} as double), {DIGITS}) as {n}" for n, e in _items(dbls)]
    out += [f"{e} as {n}" for n, e in _items(raw)]
    out += [f"cast({e} as varchar) as {n}" for n, e in _items(strs)]
    out += [f"array_to_string({e}, '|') as {n}" for n, e in _items(arrs)]
    return ", ".join(out)
