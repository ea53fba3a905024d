"""Strict JSON parsing and typed views over JSON text, on Spark's VARIANT type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Columns are expression trees: using one Python variable several times repeats its
    whole tree, which grows exponentially over nested steps. A one-element transform
    binds the value to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def strict_json(text: Column) -> Column:
    """VARIANT of exactly one JSON value, else null.

    ``try_parse_json`` stops after the first value; wrapping the text in an array
    with a closing element makes trailing garbage visible. Of duplicate keys the last
    counts, which the parser does only under a session setting: it is set here.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(",null]")))
    return let(wrapped, lambda w: F.when(_at(w, "$[1]").isNotNull() & _at(w, "$[2]").isNull(), _at(w, "$[0]")))


def json_kind(v: Column) -> Column:
    """object, array, string, int, float, bool or null (SQL null when there is no value)."""
    return let(
        F.schema_of_variant(v),
        lambda s: F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when((s == "BIGINT") | s.endswith(",0)"), "int")
        .when(s == "BOOLEAN", "bool")
        .when(s == "VOID", "null")
        .otherwise("float"),
    )


def member(v: Column, key: str) -> Column:
    """Object member as VARIANT; SQL null when absent."""
    return _at(v, f"$.{key}")


def member_text(json_text: Column, key: str) -> Column:
    """Object member as text: strings unquoted, nested values as compact JSON in source order."""
    return F.get_json_object(json_text, f"$.{key}")


def entries(object_text: Column) -> Column:
    """``array<struct<key,kind,text>>`` of an object in source order; the last duplicate wins."""

    def build(s: Column) -> Column:
        def last(e: Column, i: Column) -> Column:
            return ~F.array_contains(F.slice(s["keys"], i + 2, F.size(s["keys"])), e["key"])

        return F.transform(
            F.filter(s["pairs"], last),
            lambda e: F.struct(
                e["key"].alias("key"),
                json_kind(s["typed"][e["key"]]).alias("kind"),
                F.coalesce(e["value"], F.lit("null")).alias("text"),
            ),
        )

    parsed = F.from_json(object_text, _MAP)
    return F.when(
        object_text.isNotNull(),
        let(
            F.struct(
                F.map_entries(parsed).alias("pairs"),
                F.map_keys(parsed).alias("keys"),
                strict_json(object_text).cast("map<string,variant>").alias("typed"),
            ),
            build,
        ),
    )


def python_str(kind: Column, text: Column) -> Column:
    """``str(value)`` of a decoded scalar; lists and objects stay JSON with spaced separators."""
    from rolloom.functions.text import spaced_json

    return (
        F.when(kind == "null", "None")
        .when((kind == "bool") & (text == "true"), "True")
        .when(kind == "bool", "False")
        .when(kind.isin("array", "object"), spaced_json(text))
        .otherwise(text)
    )
