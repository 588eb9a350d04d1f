"""The JSON value surface on VARIANT, arrays, maps and structs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column, strict: bool = True) -> Column:
    """VARIANT; strict fails on malformed text, else it is null."""
    return F.parse_json(text) if strict else F.try_parse_json(text)


def unparse(value: Column) -> Column:
    return F.to_json(value)


def print_number(v: Column) -> Column:
    """A number as JSON: whole ones without a point, NaN and infinities as null."""
    v = v.cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v.isNull() | odd, F.lit("null")).when(whole, F.format_string("%.0f", v)).otherwise(v.cast("string"))


def finite(v: Column) -> Column:
    """v, or null for NaN and infinities, which JSON can't say: for numbers that go into unparse()."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def minified(text: Column) -> Column:
    """Without comments and white space outside strings; order and repeated keys stay."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|\s+|/\*(?s:.*?)\*/|//[^\n]*', "$1")


def null_value() -> Column:
    return F.parse_json(F.lit("null"))


def scalar_value(v: Column) -> Column:
    """A boolean, number or string as VARIANT; a null column is the JSON null."""
    return F.coalesce(v.cast("variant"), null_value())


def raw_value(text: Column) -> Column:
    """Text that is JSON already."""
    return F.parse_json(text)


def array_value(*items: Column) -> Column:
    return F.to_variant_object(F.array(*[i.cast("variant") for i in items]))


def object_value(**items: Column) -> Column:
    return F.to_variant_object(F.struct(*[v.cast("variant").alias(k) for k, v in items.items()]))


def number_list(values: Column) -> Column:
    """An array of numbers as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, print_number), ","), F.lit("]"))


def string_list(values: Column) -> Column:
    """An array of strings as JSON text."""
    return F.to_json(values)


def duplicate(value: Column) -> Column:
    """Columns are values: a copy is the value itself."""
    return value


def array_size(array: Column) -> Column:
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))


def array_item(array: Column, index: Column | int) -> Column:
    """0-based; null out of range."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def object_item(obj: Column, key: str, case_sensitive: bool = False) -> Column:
    """Of a map: the first value whose key matches."""
    if case_sensitive:
        return F.try_element_at(obj, F.lit(key))
    hit = F.filter(F.map_entries(obj), lambda e: F.lower(e["key"]) == F.lit(key.lower()))
    return F.get(hit, F.lit(0))["value"]


def has_item(obj: Column, key: str) -> Column:
    return object_item(obj, key).isNotNull() | F.coalesce(F.exists(F.map_keys(obj), lambda k: F.lower(k) == F.lit(key.lower())), F.lit(False))


def string_value(value: Column, path: str = "$") -> Column:
    """Null unless the value there is a string."""
    return F.when(kind(value, path) == "string", F.try_variant_get(value, path, "string"))


def number_value(value: Column, path: str = "$") -> Column:
    """NaN unless the value there is a number."""
    return F.when(kind(value, path) == "number", F.try_variant_get(value, path, "double")).otherwise(F.lit(float("nan")))


def kind(value: Column, path: str = "$") -> Column:
    """invalid, null, bool, number, string, array or object."""
    there = F.try_variant_get(value, path, "variant")
    name = F.upper(F.schema_of_variant(there))
    return (
        F.when(there.isNull(), F.lit("invalid"))
        .when(F.is_variant_null(there), F.lit("null"))
        .when(name == "BOOLEAN", F.lit("bool"))
        .when(name == "STRING", F.lit("string"))
        .when(F.startswith(name, F.lit("ARRAY")), F.lit("array"))
        .when(F.startswith(name, F.lit("OBJECT")), F.lit("object"))
        .otherwise(F.lit("number"))
    )


def insert(array: Column, index: int, value: Column) -> Column:
    """Before the 0-based index; at the end if that is beyond it."""
    return F.concat(F.slice(array, 1, index), F.array(value), F.slice(array, F.lit(index + 1), F.greatest(F.size(array), F.lit(1))))


def replaced(array: Column, index: int, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == index, value).otherwise(x))


def removed(array: Column, index: int) -> Column:
    return F.filter(array, lambda x, i: i != index)


def add_item(obj: Column, key: str, value: Column) -> Column:
    """Of a map: with that item; one of the very same key goes."""
    return F.map_concat(remove_key(obj, key, True), F.create_map(F.lit(key), value))


def set_field(struct: Column, name: str, value: Column) -> Column:
    return struct.withField(name, value)


def drop_field(struct: Column, name: str) -> Column:
    return struct.dropFields(name)


def remove_key(obj: Column, key: str, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return F.map_filter(obj, lambda k, v: k != F.lit(key))
    return F.map_filter(obj, lambda k, v: F.lower(k) != F.lit(key.lower()))


def equal_numbers(a: Column, b: Column) -> Column:
    """Within one unit in the last place of 1, relative to the larger."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(2.0**-52)


def equal_documents(a: Column, b: Column) -> Column:
    """Of JSON texts: equal whatever the order of keys."""
    return F.to_json(F.parse_json(a)).eqNullSafe(F.to_json(F.parse_json(b)))


def _same(a, b, fold) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= max(abs(a), abs(b)) * 2.0**-52
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(_same(x, y, fold) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        a, b = ({fold(k): v for k, v in reversed(x.items())} for x in (a, b))
        return a.keys() == b.keys() and all(_same(v, b[k], fold) for k, v in a.items())
    return a == b


def _compared(a: pd.Series, b: pd.Series, case: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None, exact: bool) -> bool:
        try:
            return x is not None and y is not None and _same(json.loads(x), json.loads(y), str if exact else str.lower)
        except ValueError:
            return False

    return pd.Series([one(x, y, c) for x, y, c in zip(a, b, case, strict=True)], dtype=bool)


def compare(a: Column, b: Column, case_sensitive: bool = True) -> Column:
    """Of JSON texts: equal at every depth, numbers as equal_numbers has them, keys in any case if asked. Malformed or null text equals nothing.

    Recursion over a document of any depth isn't a built-in function: an Arrow UDF.
    """
    return F.pandas_udf(_compared, "boolean")(a, b, F.lit(case_sensitive))
