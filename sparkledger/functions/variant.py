"""Strict JSON access: values are tested for their type and never coerced.

A value of the wrong type is null (or 0 for counters), as an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


#: How a line that holds an object ends.
ENDED = r"\}\s*$"


def boxed(line: Column) -> Column:
    """What stands on a line, parsed as the elements of an array."""
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))


def unboxed(box: Column) -> Column:
    """The only element of an array; null if there are more."""
    return F.when(at(box, "$[1]").isNull(), at(box, "$[0]"))


def parse_line(line: Column) -> Column:
    """A JSON object line as a variant; null for anything else, trailing text included."""
    return F.when(line.rlike(ENDED), unboxed(boxed(line)))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT<"), F.lit(False))


def string_or_null(v: Column, path: str, keep_empty: bool = True) -> Column:
    x = at(v, path)
    s = F.when(kind(x) == "STRING", F.try_variant_get(v, path, "string"))
    return s if keep_empty else F.nullif(s, F.lit(""))


def number_or_zero(v: Column, path: str, negative: bool = True) -> Column:
    """A finite JSON number as a long (fractions are cut off, beyond the range of a long it is 0)."""
    x = at(v, path)
    d = F.try_variant_get(v, path, "double")
    ok = kind(x).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)") & (F.abs(d) < float("inf"))
    if not negative:
        ok = ok & (d >= 0)
    return F.when(F.coalesce(ok, F.lit(False)), F.coalesce(d.try_cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def iso_timestamp(s: Column) -> Column:
    """An ISO 8601 date or date-time in milliseconds; null if it is no date."""
    norm = F.regexp_replace(F.regexp_replace(s, r"(T\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(s.rlike(_ISO), F.date_trunc("millisecond", F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).otherwise(norm))))


def iso_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def leading_int(s: Column) -> Column:
    """The integer at the start of a text, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("long"), F.lit(0))


def members(df: DataFrame, column: str) -> DataFrame:
    """df with a row for each member of an object, as key and value (a variant)."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer()))
