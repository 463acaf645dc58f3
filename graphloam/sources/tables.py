"""The relational tables as a graph, in one of two layouts with the same rows.

By label every branch is a projection with literal kind, label and interpretation, so that Catalyst can prune whole branches.
By row a table is read once and all assertions of one of its rows follow each other, so that what they share is squeezed out
wherever they are shuffled or written.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import INTERP, Graph

NS, V = "http://example.org/kg/", "http://example.org/v/"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _id(entity: str, key: str) -> str:
    return f"'{NS}{entity}/' || cast({key} as string)"


@dataclass(frozen=True)
class Branch:
    """The rows that a table gives with one label: an expression for each column."""

    table: str
    cells: dict[str, str]
    where: str = ""

    @property
    def sql(self) -> str:
        return f"select {', '.join(f'{v} as {k}' for k, v in self.cells.items())} from {self.table}{' where ' + self.where if self.where else ''}"


def _row(table: str, entity: str, key: str, label: str, target=None, value=None, interp="null", occ="", ident="null", where="", parent="null", depth=0, origin=None) -> Branch:
    root = _id(entity, key)
    own = f"'{entity}/{label}/' || cast({occ or key} as string)"
    interp = interp if interp.startswith(("null", "case")) else f"'{INTERP}{interp}'"
    null = "cast(null as string)"
    cells = {
        "graph": "'main'", "occ": own, "parent_occ": null if parent == "null" else parent, "root": root, "depth": str(depth), "kind": "'E'" if target else "'P'", "origin": origin or root, "label": f"'{V}{label}'",
        "target": target or null, "value": value or null, "id": null if ident == "null" else ident, "interp": null if interp == "null" else interp,
    }
    return Branch(table, cells, where)


def _money(x: str) -> str:
    return f"cast(cast({x} as decimal(18,2)) as string)"


def _day(x: str) -> str:
    return f"cast(cast({x} as date) as string)"


_minus = "'-' || cast(o_orderkey as string)"
_line = "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || " + _money("l_quantity") + " || '-' || " + _money("l_extendedprice")
_line_id = f"'{NS}line/' || cast(l_orderkey as string) || '-1-' || cast(l_partkey as string)"
_line_ident = f"case when l_linenumber = 1 then {_line_id} end"
_line_occ = f"'order/contains/' || {_line}"
_chain = "(select o_orderkey, o_custkey, coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey), case when o_custkey % 7 = 0 then min(o_orderkey) over (partition by o_custkey) end) as o_next from orders) chain"

ASSERTION_BRANCHES = [
    _row("region", "region", "r_regionkey", "name", value="r_name"),
    _row("nation", "nation", "n_nationkey", "name", value="n_name"),
    _row("nation", "nation", "n_nationkey", "inRegion", target=_id("region", "n_regionkey")),
    _row("customer", "customer", "c_custkey", "name", value="c_name", interp=f"case when c_custkey % 50 = 0 then '{INTERP}number' end"),
    _row("customer", "customer", "c_custkey", "acctbal", value=_money("c_acctbal"), interp="number"),
    _row("customer", "customer", "c_custkey", "mktsegment", value="c_mktsegment", interp="text"),
    _row("customer", "customer", "c_custkey", "active", value="case c_custkey % 3 when 0 then 'true' when 1 then 'false' else 'True' end", interp="boolean"),
    _row("customer", "customer", "c_custkey", "inNation", target=_id("nation", "c_nationkey")),
    _row("supplier", "supplier", "s_suppkey", "name", value="s_name"),
    _row("supplier", "supplier", "s_suppkey", "acctbal", value=_money("s_acctbal"), interp="number"),
    _row("supplier", "supplier", "s_suppkey", "inNation", target=_id("nation", "s_nationkey")),
    _row("part", "part", "p_partkey", "name", value="p_name"),
    _row("part", "part", "p_partkey", "brand", value="p_brand"),
    _row("part", "part", "p_partkey", "type", value="p_type"),
    _row("part", "part", "p_partkey", "size", value="cast(p_size as string)", interp="size"),
    _row("orders", "order", "o_orderkey", "totalprice", value=_money("o_totalprice"), interp="number"),
    _row("orders", "order", "o_orderkey", "totalprice", value=_money("o_totalprice"), interp="number", occ=_minus, where="o_orderkey % 10 = 0"),
    _row("orders", "order", "o_orderkey", "totalprice", value=_money("o_totalprice"), occ="o_orderkey + 0.5", where="o_orderkey % 30 = 0"),
    _row("orders", "order", "o_orderkey", "totalprice", value=_money("o_totalprice"), interp="text", occ="o_orderkey + 0.25", where="o_orderkey % 70 = 0"),
    *(
        _row("orders", "order", "o_orderkey", "checkedBy", value=f"'{who}'", where="o_orderkey % 10 = 0", occ=key, depth=1, origin="cast(null as string)", parent=f"'order/totalprice/' || cast({key} as string)")
        for who, key in (("audit", "o_orderkey"), ("desk", _minus))
    ),
    _row("orders", "order", "o_orderkey", "orderdate", value=_day("o_orderdate"), interp="datetime"),
    _row("orders", "order", "o_orderkey", "placedBy", target=_id("customer", "o_custkey")),
    _row("orders", "order", "o_orderkey", "placedBy", target=_id("customer", "o_custkey"), occ=_minus, where="o_orderkey % 10 = 0"),
    _row(_chain, "order", "o_orderkey", "followedBy", target=_id("order", "o_next"), where="o_next is not null"),
    _row("lineitem", "order", "l_orderkey", "contains", target=_id("part", "l_partkey"), occ=_line, ident=_line_ident),
    _row("lineitem", "order", "l_orderkey", "quantity", value=_money("l_quantity"), interp="number", occ=_line, parent=_line_occ, depth=1, origin=_line_ident),
    _row("lineitem", "order", "l_orderkey", "shipdate", value=_day("l_shipdate"), interp="datetime", occ=_line, parent=_line_occ, depth=1, origin=_line_ident),
    _row("lineitem", "order", "l_orderkey", "suppliedBy", target=_id("supplier", "l_suppkey"), occ=_line, parent=_line_occ, depth=1, origin=_line_ident),
    _row("lineitem", "note", "l_orderkey", "disputes", target=_line_id, occ=_line, where="l_linenumber = 1 and l_orderkey % 100 = 0"),
    _row("events", "user", "user_id", "performed", target="'" + NS + "event/' || event_type", occ="event_id"),
    _row("events", "user", "user_id", "at", value=_day("ts"), interp="datetime", occ="event_id", parent="'user/performed/' || cast(event_id as string)", depth=1, origin="cast(null as string)"),
    _row("events", "user", "user_id", "amount", value=_money("value"), interp="number", occ="event_id", parent="'user/performed/' || cast(event_id as string)", depth=1, origin="cast(null as string)"),
]


def _node(table: str, entity: str, key: str, types: str) -> str:
    return f"select 'main' as graph, {_id(entity, key)} as id, {types} as types from {table}"


def _types(*names: str) -> str:
    return "array(" + ", ".join(f"'{V}{n}'" for n in names) + ")"


NODE_BRANCHES = [
    _node("region", "region", "r_regionkey", _types("Region")),
    _node("nation", "nation", "n_nationkey", _types("Nation")),
    _node("customer", "customer", "c_custkey", _types("Customer", "Party")),
    _node("supplier", "supplier", "s_suppkey", _types("Party", "Supplier")),
    _node("part", "part", "p_partkey", _types("Part")),
    _node("orders", "order", "o_orderkey", _types("Order")),
    _node("(select distinct l_orderkey from lineitem where l_linenumber = 1 and l_orderkey % 100 = 0) n", "note", "l_orderkey", _types("Note")),
    _node("(select distinct user_id from events) u", "user", "user_id", _types("User")),
    _node("(select distinct event_type from events) t", "event", "event_type", _types("EventType")),
]
ASSERTION_SQL = "\nunion all ".join(b.sql for b in ASSERTION_BRANCHES)
NODE_SQL = "\nunion all ".join(NODE_BRANCHES)
#: For DuckDB: common table expressions ``nodes`` and ``a``.
CTES = f"nodes as materialized (select graph, id, types from ({NODE_SQL.replace('array(', 'list_value(')}) n),\na as materialized ({ASSERTION_SQL})"


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _branches(spark: SparkSession, branches: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for sql in branches:
        text = sql
        for t in TABLES:
            text = text.replace(f" from {t}", f" from {{{t}}}")
        df = spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})
        out = df if out is None else out.unionByName(df)
    return out


def _by_row(branches: list[Branch]) -> list[str]:
    """One SELECT a table: its rows times its branches, with a CASE over the branch's number where these differ."""
    tables: dict[str, list[Branch]] = {}
    for b in branches:
        tables.setdefault(b.table, []).append(b)
    out = []
    for table, mine in tables.items():
        cells = [{c: v.replace(_line, "line_") for c, v in b.cells.items()} for b in mine]
        shared = Counter(v for row in cells for v in row.values() if "||" in v and "line_" not in v)
        names = {v: f"shared{i}_" for i, v in enumerate(v for v, n in shared.items() if n > 1)}
        cells = [{c: names.get(v, v) for c, v in row.items()} for row in cells]
        below = [f"{v} as {n}" for v, n in names.items()] + ([f"{_line} as line_"] if table == "lineitem" else [])
        columns = []
        for c in cells[0]:
            common = Counter(row[c] for row in cells).most_common(1)[0][0]
            others = [f"when {i} then {row[c]}" for i, row in enumerate(cells) if row[c] != common]
            columns.append((f"case k_ {' '.join(others)} else {common} end" if others else common) + f" as {c}")
        some = [f"when {i} then {b.where}" for i, b in enumerate(mine) if b.where]
        rows = f"select {', '.join(['*', *below])} from {table}"
        numbered = f"select *, explode(array({', '.join(map(str, range(len(mine))))})) as k_ from ({rows}) rows_"
        out.append(f"select {', '.join(columns)} from ({numbered}) numbered_" + (f" where case k_ {' '.join(some)} else true end" if some else ""))
    return out


def table_graph(spark: SparkSession, sf_dir: str, by_row: bool = False) -> Graph:
    """The whole projection: types, first-level and nested assertions, repeated, dirty and identified rows."""
    tables = read_tables(spark, sf_dir)
    return Graph(_branches(spark, NODE_BRANCHES, tables), _branches(spark, _by_row(ASSERTION_BRANCHES) if by_row else [b.sql for b in ASSERTION_BRANCHES], tables))
