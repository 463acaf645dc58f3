"""The graph engine: merge rules against a plain model, text round trips, store, values, and every query against DuckDB."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from graphloam.operators import analytics, interp, merge, paths, select
from graphloam.plans.emit import mermaid_lines
from graphloam.plans.queries import ORACLE, QUERIES
from graphloam.schema import ASSERTIONS, INTERP, NODES, Graph, GraphMergeError, IdConflictError, structure_faults
from graphloam.session import meeting, missing, write_table
from graphloam.sources import literate
from graphloam.sources.store import StoreError, open_store

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def graph(spark, rows, nodes=("n",)):
    """rows: (occ, parent, root, depth, kind, label, payload, id, interp)."""
    ids = {r[0]: r[7] for r in rows}
    full = [("g", o, p, root, d, k, ids.get(p) if p else root, lab, v if k == "E" else None, v if k == "P" else None, i, n) for o, p, root, d, k, lab, v, i, n in rows]
    return Graph(spark.createDataFrame([("g", n, []) for n in nodes], NODES), spark.createDataFrame(full, ASSERTIONS))


def model(rows):
    """The merge rules said plainly: a sorted nest of (kind, label, payload, id, interp, children)."""
    below = {}
    for r in rows:
        below.setdefault(r[1] or ("root", r[2]), []).append(r)

    def fold(siblings):
        groups = {}
        for r in siblings:
            groups.setdefault((r[4], r[5], r[6], r[7] or ""), []).append(r)
        out = []
        for (k, lab, v, i), members in groups.items():
            interps = sorted({r[8] for r in members if r[8]})
            for n in interps or [None]:
                mine = [r for r in members if r[8] == n or (r[8] is None and len(interps) <= 1)]
                out.append((k, lab, v, i, n or "", fold([c for r in mine for c in below.get(r[0], [])])))
        return tuple(sorted(out))

    return {root: fold(below[("root", root)]) for kind, root in (k for k in below if isinstance(k, tuple)) if kind == "root"}


def nest(g):
    rows = [(r.occ, r.parent_occ, r.root, r.depth, r.kind, r.label, r.target or r.value, r.id, r.interp) for r in g.assertions.collect()]
    below = {}
    for r in rows:
        below.setdefault(r[1] or ("root", r[2]), []).append(r)
    fold = lambda rs: tuple(sorted((r[4], r[5], r[6], r[7] or "", r[8] or "", fold(below.get(r[0], []))) for r in rs))
    return {k[1]: fold(v) for k, v in below.items() if isinstance(k, tuple)}


def test_merge_agrees_with_the_model(spark):
    rng = random.Random(3)
    rows, places = [], [(None, f"n{i}", 0) for i in range(4)]
    for o in range(160):
        parent, root, depth = rng.choice(places)
        rows.append((f"o{o}", parent, root, depth, rng.choice("EP"), rng.choice("ab"), rng.choice("xy"), None, rng.choice([None, None, "i", "j"])))
        if depth < 3:
            places.append((f"o{o}", root, depth + 1))
    g = graph(spark, rows, ("n0", "n1", "n2", "n3"))
    once = merge.merge(g)
    assert nest(once) == model(rows)
    assert nest(merge.merge(once)) == model(rows)


def test_identified_rows(spark):
    same = [("a", None, "n", 0, "P", "age", "28", "i", None), ("b", None, "n", 0, "P", "age", "28", "i", "num"), ("c", None, "n", 0, "P", "age", "28", None, None), ("d", "a", "n", 1, "P", "by", "x", None, None), ("e", "b", "n", 1, "P", "by", "y", None, None)]
    assert nest(merge.merge(graph(spark, same))) == model(same)
    for other in (("b", None, "n", 0, "P", "age", "29", "i", None), ("b", None, "m", 0, "P", "age", "28", "i", None)):
        with pytest.raises(GraphMergeError):
            merge.merge(graph(spark, [same[0], other]))
    with pytest.raises(GraphMergeError):
        merge.merge(graph(spark, [same[0][:8] + ("p",), same[1]]))
    with pytest.raises(IdConflictError):
        merge.union(graph(spark, same[:1]), graph(spark, [], ("i",)))


def test_empty_graph(spark):
    g = graph(spark, [], ())
    assert merge.merge(g).assertions.count() == 0 and select.match(g).count() == 0 and paths.reachable(g, "x", "y", 3).count() == 0


def test_hashes(spark):
    rows = [("a", None, "n", 0, "P", "l", "v", None, None), ("b", "a", "n", 1, "E", "m", "t", None, None), ("c", None, "n", 0, "E", "l", "t", "i", None), ("d", "c", "n", 1, "P", "m", "w", None, None)]
    h = lambda *x: hashlib.sha256("\x1f".join(x).encode()).hexdigest()
    got = {r.occ: r.skeleton for r in merge.with_hashes(graph(spark, rows)).collect()}
    assert got == {"a": h("P", "n", "l", "v"), "b": h("E", h("P", "n", "l", "v"), "m", "t"), "c": h("E", "n", "l", "t"), "d": h("P", "i", "m", "w")}


def test_select_and_cycles(spark):
    rows = [(f"e{i}", None, f"n{i}", 0, "E", "to", f"n{(i + 1) % 4}", None, None) for i in range(4)]
    g = graph(spark, rows, ("n0", "n1", "n2", "n3"))
    assert sorted(r.id for r in paths.reachable(g, "n0", "to", 2).collect()) == ["n1", "n2"]
    assert sorted(r.id for r in paths.reachable(g, "n0", "to", 9).collect()) == ["n0", "n1", "n2", "n3"]
    sub = paths.subgraph(g, spark.createDataFrame([("n0",)], "id string"), 1)
    assert {r.id for r in sub.nodes.collect()} == {"n0", "n1", "n2"} and sub.assertions.count() == 2
    with pytest.raises(ValueError):
        select.select(g, value="a", target="b")


@pytest.mark.parametrize("text", ["28", "-0", "+7", "1.50", ".5", "1e-9", "6.02214076e23", "0.00000000001", "12345678901234567890123456789012345678901234567890.1"])
def test_numbers(text):
    n = interp.read_number(text)
    assert Decimal(interp.write_number(n)) == Decimal(text) and interp.write_number(interp.read_number(interp.write_number(n))) == interp.write_number(n)


def test_contracts(spark):
    cases = {"number": (["28", ".5", "1e-9", "-105.2705"], ["", "spring", "1 2", "٣", "5\n"]), "datetime": (["2018-03-15", "2018-03-15T10:30:00"], ["spring 1958", "1958-06", "2018-02-30"]), "boolean": (["true", "false"], ["True", "yes"])}
    rows = [(f"{k}{ok}{i}", None, "n", 0, "P", "l", v, None, INTERP + k) for k, (good, bad) in cases.items() for ok, vs in ((1, good), (0, bad)) for i, v in enumerate(vs)]
    found = {r.occ for r in interp.validate(graph(spark, rows)).collect()}
    assert found == {r[0] for r in rows if r[0][-2] == "0"}


DOC = '''<!-- a comment -->
# @docheader

* @document: http://e.org/doc
* @nodebase: http://e.org/n/
* @schema: http://e.org/v/
* @iri:
    * ex: http://ex.org/
* title: "A: \\"quoted\\" title"

# Ann [Person ex:Cook]

* name: Ann <!-- kept out -->
* age: 28
    * @as: number
    * source:: note
* knows -> Bob
    * @id: edge1
    * since: 2001
* <http://o.org/x>: plain

# Bob

* disputes → edge1

:note = """two
lines"""
'''


def test_parse():
    p = literate.parse(DOC, "d")
    assert not p.errors and p.doc == "http://e.org/doc"
    rows = {(r["label"], r["target"] or r["value"]): r for r in p.rows}
    assert rows["http://e.org/v/title", 'A: "quoted" title']["root"] == "http://e.org/doc"
    assert rows["http://e.org/v/age", "28"]["interp"] == INTERP + "number"
    assert rows["http://e.org/v/source", "two\nlines"]["depth"] == 1
    assert rows["http://e.org/v/since", "2001"]["origin"] == "http://e.org/n/edge1"
    assert p.nodes["http://e.org/n/Ann"] == ["http://e.org/v/Person", "http://ex.org/Cook"]
    assert ("http://e.org/v/disputes", "http://e.org/n/edge1") in rows and "http://e.org/n/edge1" not in p.nodes


def test_faults_are_told():
    text = "# A [T\n\n# a b c\n\n# X [T]\n\n* knows => Y\n```\nprose\n"
    assert [e[1] for e in literate.parse(text).errors] == ["type-bracket", "node-id-space", "bad-arrow", "code-fence", "unexpected"]
    assert literate.parse("").errors[0][1] == "empty"
    assert literate.parse("# X [T]\n\n* knows => Y\n", lenient_arrows=True).rows[0]["kind"] == "E"


def test_parser_options():
    head = "# @docheader\n\n* @document: http://e.org/d\n* @schema: http://e.org/v\n* title: x\n\n# N [T]\n\n* a: 1\n\t* b: 2\n"
    p = literate.parse(head, add_source=True)
    assert [e[1] for e in p.errors] == ["namespace-base-warning"] and [e[1] for e in literate.parse(head, strict_namespace_bases=True).errors] == ["namespace-base"]
    assert [r["depth"] for r in p.rows if r["label"] != literate.SOURCE] == [0, 0, 1] and sum(r["label"] == literate.SOURCE for r in p.rows) == 3
    assert [e[1] for e in literate.parse(head.replace("/v\n", "/v/\n"), warn_implicit_doc_ids=True).errors] == ["implicit-document"]
    clash = "# @docheader\n\n* @schema: http://e.org/v/\n* @iri:\n    * schema: http://o.org/\n* @interpretations:\n    * a: number\n    * a: text\n"
    assert [e[1] for e in literate.parse(clash).errors] == ["interp-twice", "schema-prefix"]
    assert not literate.parse("# X\n", warn_empty_blocks=False).errors and literate.parse("a", "n").errors


def test_targets_in_other_documents(spark):
    one = "# A [T]\n\n* knows -> B\n    * @id: http://e.org/e1\n"
    two = "# C [T]\n\n* doubts -> <http://e.org/e1>\n* likes -> <http://e.org/nobody>\n"
    texts = spark.createDataFrame([(None, one), (None, two)], "name string, text string")
    g = literate.read_literate(spark, texts, graph="g", mode="failfast")
    assert {r.id for r in g.nodes.collect()} == {"A", "B", "C", "http://e.org/nobody"}
    assert g.assertions.count() == g.assertions.select("occ").distinct().count() == 3


def test_text_round_trip(spark):
    texts = spark.createDataFrame([("d", DOC)], "name string, text string")
    g = literate.read_literate(spark, texts)
    again = literate.read_literate(spark, literate.write_literate(g, schema="http://e.org/v/", nodebase="http://e.org/n/").withColumnRenamed("graph", "name"))
    assert nest(again) == nest(g) and {(r.id, tuple(r.types)) for r in again.nodes.collect()} == {(r.id, tuple(r.types)) for r in g.nodes.collect()}


def test_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    a = graph(spark, [("a", None, "n", 0, "P", "l", "v", None, None), ("b", "a", "n", 1, "P", "m", "w", None, None)])
    store.put("one / x", a)
    store.put("one / x", graph(spark, [("a", None, "n", 0, "P", "l", "v", None, "i"), ("k", None, "n", 0, "E", "to", "n", "edge", None)]))
    assert store.names() == ["one / x"]
    assert nest(store.get("one / x")) == {"n": (("E", "to", "n", "edge", "", ()), ("P", "l", "v", "", "i", (("P", "m", "w", "", "", ()),)))}
    with pytest.raises(StoreError):
        store.add("one / x", "edge", "l", "v")
    store.remove("one / x", "n", "l", "v")
    assert store.match("one / x").count() == 1 and store.match("none").count() == 0
    store.drop("one / x")
    with pytest.raises(KeyError):
        store.get("one / x")


def test_entry_without_the_optional_part(tmp_path):
    for name in ("graphloam", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "graphloam" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'select_all' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_diagram_numbers_are_places_in_order(spark):
    """Over several sampled ranges too: their bounds come out otherwise when a plan runs again."""
    from pyspark.sql import functions as F

    nodes = spark.range(0, 60_000, 1, 8).select(F.lit("g").alias("graph"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.array(F.sha2(F.col("id").cast("string"), 224)).alias("types"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = [r.line for r in mermaid_lines(Graph(nodes, spark.createDataFrame([], ASSERTIONS)), most=160).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sorted((r.id, r.types[0]) for r in nodes.collect())
    assert sorted(lines) == sorted(f'  n{i}["{x} {t}"]' for i, (x, t) in enumerate(found))


def test_round_numbers_in_plain_digits(spark):
    values = ["300000.00e2", "12345678.000", "10000000.000", "-5e9", "1e-30", "7", "x"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(interp.plain_number("v")).collect()]
    assert got == ["30000000", "12345678", "10000000", "-5000000000", "0." + "0" * 29 + "1", "7", None]
    assert interp.write_number(Decimal("300000.00e2")) == "3E+7"


def test_canonical_number_of_round_prices(spark, tmp_path):
    from pyspark.sql import functions as F

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "orders":
            rows = rows.withColumn("o_totalprice", F.lit(30_000_000).cast(rows.schema["o_totalprice"].dataType))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES["canonical_number"](spark, str(tmp_path)).toPandas(), con.sql(ORACLE["canonical_number"]).df()
    plain = lambda d: sorted(map(tuple, d[sorted(want.columns)].astype(str).values.tolist()))
    assert plain(got) == plain(want)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_merging_takes_one_exchange(spark):
    rows = [("a", None, "n", 0, "P", "l", "v", None, "i"), ("b", "a", "n", 1, "P", "m", "w", None, None), ("c", "b", "n", 2, "P", "k", "w", None, None), ("d", None, "n", 0, "P", "l", "v", None, None)]
    g = graph(spark, rows)
    assert exchanges(merge.merge(g).assertions) == 1 and nest(merge.merge(g)) == model(rows)
    assert exchanges(merge.union(g, g).assertions) == 1 and nest(merge.union(g, g)) == model(rows)
    assert exchanges(merge.with_hashes(g)) == 1 and merge.with_hashes(g).count() == 4


def test_identified_rows_below_others(spark):
    top = [("a", None, "n", 0, "P", "l", "v", None, "i"), ("b", None, "n", 0, "P", "l", "v", None, None), ("c", None, "n", 0, "P", "l", "w", None, None)]
    said = lambda o, parent, value="x", interp=None: (o, parent, "n", 1, "P", "m", value, "id", interp)
    assert nest(merge.merge(graph(spark, top + [said("d", "a"), said("e", "b")]))) == model(top + [said("d", "a"), said("e", "b")])
    for pair in ((said("d", "a"), said("e", "c")), (said("d", "a"), said("e", "a", "y")), (said("d", "a", interp="p"), said("e", "b", interp="q")), (said("d", "a"), ("e", None, "n", 0, "P", "m", "x", "id", None))):
        with pytest.raises(GraphMergeError):
            merge.merge(graph(spark, top + list(pair)))
    rival = [("f", None, "n", 0, "P", "l", "v", None, "j")]
    assert len(nest(merge.merge(graph(spark, top + rival + [said("d", "b"), said("e", "a")])))["n"]) == 3  # b goes with what is below it


def test_small_tables_leave_the_rest_in_place(spark):
    rows = [("a", None, "n", 0, "E", "l", "m", None, None), ("b", "a", "n", 1, "P", "k", "w", None, None), ("c", None, "m", 0, "P", "l", "v", None, None)]
    g = graph(spark, rows, ("n", "m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = select.remove(g, g.assertions.where("occ = 'a'")).assertions
        near = paths.subgraph(g, spark.createDataFrame([("n",)], "id string"), 0).assertions
        assert exchanges(left) == exchanges(near) == 0
        assert [r.occ for r in left.collect()] == ["c"] and sorted(r.occ for r in near.collect()) == ["a", "b"]
        assert exchanges(select.annotations(g)) == 1 and select.annotations(g).first().annotations == {"k": "w"}
        assert exchanges(analytics.edges(g)) == 0 and analytics.edges(g).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bitmap_joins(spark):
    right = write_table(spark.range(0, 600_000, 2).selectExpr("cast(id as string) as k"), "right")
    left = spark.range(590_000, 610_000).selectExpr("cast(id as string) as k", "id as v").union(spark.createDataFrame([(None, 1)], "k string, v long"))
    assert {r.v for r in meeting(left, right, ["k"]).collect()} == set(range(590_000, 600_000, 2))
    assert sorted(r.v for r in missing(left, right, ["k"]).collect()) == [1, *sorted({*range(590_000, 610_000)} - {*range(590_000, 600_000, 2)})]


def test_components_over_several_tasks(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(900)}", f"n{rng.randrange(900)}") for _ in range(500)]
    least = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    for parts in (1, 16):
        got = analytics.connected_components(spark.createDataFrame(pairs, "source string, target string").repartition(parts))
        assert {r.id: r.component for r in got.collect()} == least
    chain = spark.range(0, 3000, 1, 1).selectExpr("format_string('%05d', id) as source", "format_string('%05d', id + 1) as target")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = analytics.connected_components(chain)
    assert got.select("component").distinct().collect()[0][0] == "00000" and len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 12


def test_faults_below_the_first_level(spark):
    rows = [("a", None, "n", 0, "P", "l", "v", None, None), ("b", "a", "n", 1, "P", "l", "v", None, None), ("c", "b", "n", 1, "P", "l", "v", None, None), ("d", "x", "n", 1, "P", "l", "v", None, None), ("e", "a", "n", 2, "P", "l", "v", None, None), ("f", "b", "n", 2, "P", "l", "v", None, None)]
    assert sorted(map(tuple, structure_faults(graph(spark, rows)).collect())) == [("c", "wrong depth"), ("d", "orphan"), ("e", "wrong depth")]
    assert structure_faults(graph(spark, rows[:2])).count() == 0


def test_pagerank_plain(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "b")]
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(4):
        outs = {s: [t for x, t in set(pairs) if x == s] for s in rank}
        moved = sum(r for s, r in rank.items() if outs[s])
        rank = {i: 0.15 / 4 + 0.85 * (1 - moved) / 4 + 0.85 * sum(rank[s] / len(ts) for s, ts in outs.items() if i in ts) for i in rank}
    got = {r.id: r["rank"] for r in analytics.pagerank(spark.createDataFrame(pairs, "source string, target string"), 4).collect()}
    assert got == pytest.approx(rank)
