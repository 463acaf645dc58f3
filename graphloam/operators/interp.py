"""Interpretations: typed reading, validation and audit of string values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INTERP, Graph

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DAY = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
INSTANT = rf"^{DAY}([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{{1,6}})?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?)?\z"
IRI = r"^([A-Za-z][A-Za-z0-9+.-]*:)?[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\x{80}-\x{10FFFF}-]*\z"


class InterpretationError(ValueError):
    """A value that doesn't keep its contract."""


class UnknownInterpretation(KeyError):
    """An interpretation that the registry doesn't have."""


@dataclass
class Interpretation:
    """``check``: a Column test; ``read``: the typed Column, null where the check fails; ``write``: a typed Column as the string that reads back as it."""

    check: Callable[[Column], Column]
    read: Callable[[Column], Column]
    write: Callable[[Column], Column] = lambda v: v.cast("string")


def _gated(check, read, write=lambda v: v.cast("string")):
    return Interpretation(check, lambda v: F.when(check(v), read(v)), write)


def of_function(check: Callable, read: Callable, kind: str, write: Callable = str) -> Interpretation:
    """An interpretation of plain Python functions on one value, run over Arrow batches; ``kind`` is what ``read`` gives."""

    def test(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bool(check(v)))

    def value(values: pd.Series) -> pd.Series:
        return values.map(lambda v: read(v) if v is not None and check(v) else None)

    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else write(v))

    return Interpretation(*(F.pandas_udf(f, k) for f, k in ((test, "boolean"), (value, kind), (text, "string"))))


class Registry(dict):
    """Interpretations by IRI. ``register`` refuses a name that is taken, ``get_strict`` one that is not there."""

    def register(self, iri: str, interpretation: Interpretation, replace: bool = False) -> None:
        if iri in self and not replace:
            raise ValueError(f"{iri} is registered")
        self[iri] = interpretation

    def get_strict(self, iri: str) -> Interpretation:
        if iri not in self:
            raise UnknownInterpretation(iri)
        return self[iri]


def _datetime_check(v: Column) -> Column:
    return v.rlike(INSTANT) & F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()


def _iso(v: Column) -> Column:
    """A date, or a time with as many digits of seconds as it has."""
    whole = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.typeof(v) == "date", F.date_format(v, "yyyy-MM-dd")).when(F.date_format(v, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.date_format(v, "SSSSSS")))


DEFAULT: Registry = Registry({
    INTERP + "number": _gated(lambda v: v.rlike(NUMBER), lambda v: v.try_cast("decimal(38,18)"), lambda v: canonical_number(v.cast("string"))),
    INTERP + "datetime": _gated(_datetime_check, lambda v: v.try_cast("timestamp"), _iso),
    INTERP + "boolean": _gated(lambda v: v.isin("true", "false"), lambda v: v == "true"),
    INTERP + "iri": _gated(lambda v: v.rlike(IRI), lambda v: v),
    INTERP + "text": Interpretation(lambda v: F.lit(True), lambda v: v),
})


def checked(registry: dict[str, Interpretation] = DEFAULT) -> Column:
    """One CASE over ``interp``: whether ``value`` keeps its contract; null where there is none or it is unknown."""
    out = F.lit(None).cast("boolean")
    for iri, i in registry.items():
        out = F.when(F.col("interp") == iri, i.check(F.col("value"))).otherwise(out)
    return out


def validate(g: Graph, registry: dict[str, Interpretation] = DEFAULT) -> DataFrame:
    """Findings: properties of known interpretations whose value breaks the contract, at any depth."""
    bad = g.assertions.where((F.col("kind") == "P") & ~checked(registry))
    return bad.select("graph", "occ", "origin", "label", "interp", "value", F.concat(F.lit("not "), F.substring_index("interp", "/", -1)).alias("message"))


def unknown_rows(g: Graph, registry: dict[str, Interpretation] = DEFAULT) -> DataFrame:
    """The assertions whose interpretation the registry doesn't have."""
    return g.assertions.where(F.col("interp").isNotNull() & ~F.col("interp").isin(list(registry)))


def unknown_interps(g: Graph, registry: dict[str, Interpretation] = DEFAULT) -> DataFrame:
    """(interp, n) of those in use that the registry doesn't have."""
    return unknown_rows(g, registry).groupBy("interp").agg(F.count("*").alias("n"))


def value_of(g: Graph, iri: str, registry: Registry = DEFAULT, strict: bool = False) -> DataFrame:
    """(graph, occ, value) of the properties of one interpretation, read; strict raises where one breaks its contract or the registry lacks it."""
    if iri not in registry and not strict:
        return g.assertions.where(F.lit(False)).select("graph", "occ", "value")
    i, rows = Registry(registry).get_strict(iri), g.assertions.where((F.col("kind") == "P") & (F.col("interp") == iri))
    bad = rows.where(~i.check(F.col("value"))).limit(1).collect() if strict else []
    if bad:
        raise InterpretationError(f"{bad[0].value!r} is not {iri.rpartition('/')[2]}")
    return rows.select("graph", "occ", i.read(F.col("value")).alias("value"))


def typed(g: Graph, registry: dict[str, Interpretation] = DEFAULT, strict: bool = False) -> DataFrame:
    """Properties with ``value_<name>`` for each interpretation; strict raises where a value breaks its contract."""
    props = g.assertions.where("kind = 'P'")
    if strict:
        bad = validate(g, registry).limit(1).collect()
        if bad:
            raise InterpretationError(f"{bad[0].value!r} is {bad[0].message}")
    return props.withColumns({"value_" + iri.rpartition("/")[2]: F.when(F.col("interp") == iri, i.read(F.col("value"))) for iri, i in registry.items()})


def read_number(value: str):
    """An int where there is no point and no exponent, else an exact Decimal."""
    return Decimal(value) if set(value) & set(".eE") else int(value)


def write_number(number) -> str:
    """The shortest exact decimal; an exponent only for very large or small ones."""
    if isinstance(number, bool):
        raise TypeError("a truth value is no number")
    if isinstance(number, int):
        return str(number)
    d = number if isinstance(number, Decimal) else Decimal(str(number))
    with localcontext() as c:
        c.prec = max(1, len(d.as_tuple().digits))
        d = d.normalize()
    return format(d, "f") if -25 < d.as_tuple().exponent <= 6 else str(d)


def write_plain(number) -> str:
    """The shortest exact decimal with no exponent, however large or small."""
    text = write_number(number)
    return format(Decimal(text), "f") if "E" in text else text


def _rendered(values: pd.Series, write: Callable) -> pd.Series:
    import re

    good = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$", re.ASCII)
    return values.map(lambda v: write(read_number(v)) if isinstance(v, str) and good.match(v) else None)


@F.pandas_udf(T.StringType())
def canonical_number(values: pd.Series) -> pd.Series:
    """Exact canonical form without bound on digits; null where it is no number."""
    return _rendered(values, write_number)


@F.pandas_udf(T.StringType())
def plain_number(values: pd.Series) -> pd.Series:
    """The canonical form, but in plain digits where that has an exponent."""
    return _rendered(values, write_plain)


def has_time(v: Column) -> Column:
    """Whether a datetime value is a date with a time and not a date alone."""
    return v.rlike("[T:]")


def typed_instants(g: Graph) -> DataFrame:
    """(graph, occ, day, instant) of datetime properties: a date alone has a day only."""
    own = (F.col("kind") == "P") & (F.col("interp") == INTERP + "datetime")
    rows = g.assertions.where(own).withColumn("read", DEFAULT[INTERP + "datetime"].read(F.col("value"))).where("read is not null")
    return rows.select("graph", "occ", F.col("read").cast("date").alias("day"), F.when(has_time(F.col("value")), F.col("read")).alias("instant"))


def set_value(g: Graph, values: DataFrame, label: str, interp: str | None, registry: Registry = DEFAULT) -> Graph:
    """Append a property for each (id, value) or (graph, id, value) of ``values`` on nodes that exist, written as its interpretation reads it back.

    Null values are left out. Every row is an occurrence of its own, also where the same value is there already.
    """
    key = ["graph", "id"] if "graph" in values.columns else ["id"]
    write = registry.get_strict(interp).write if interp else lambda v: v.cast("string")
    rows = values.where("value is not null").join(g.nodes.select("graph", "id"), key).select("graph", "id", write(F.col("value")).alias("value"))
    null, had = F.lit(None).cast("string"), g.assertions.where((F.col("label") == label) & (F.col("depth") == 0)).groupBy("graph", F.col("root").alias("id")).count()
    rows = rows.join(had, ["graph", "id"], "left").withColumn("n", F.row_number().over(Window.partitionBy("graph", "id").orderBy("value")) + F.coalesce("count", F.lit(0)))
    rows = rows.select(
        "graph", F.sha2(F.concat_ws("\x1f", F.lit("set"), "graph", "id", F.lit(label), "value", F.col("n").cast("string")), 256).alias("occ"), null.alias("parent_occ"), F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit("P").alias("kind"),
        F.col("id").alias("origin"), F.lit(label).alias("label"), null.alias("target"), "value", null.alias("id"), F.lit(interp).cast("string").alias("interp"),
    )
    return Graph(g.nodes, g.assertions.unionByName(rows))
