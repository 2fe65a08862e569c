"""Operators and bindings over whole tables against brute force."""

import duckdb

from tomewise.operators import merging
from tomewise.plans import bindings, catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_every_row_gets_its_candidate(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (60, "b"), (70, "b"), (80, "alone"), (90, None), (91, None), (None, "a")]
    got = {r["book"]: (r["candidate"], r["n"]) for r in merging.key_candidates(spark.createDataFrame(rows, "book long, key string"), "book", "key").collect()}
    pairs = {(a, b, k) for a, k in rows for b, j in rows if k == j and None not in (a, b, k) and a != b}
    assert got == {a: (min(b for x, b, _ in pairs if x == a), sum(x == a for x, _, _ in pairs)) for a, _, _ in pairs}


def test_key_join_over_all_parts(spark):
    parts = {r["p_partkey"]: set(r["p_name"].split(" ")) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {}
    for a, words in parts.items():
        shared = {b: len(words & other) for b, other in parts.items() if b != a and words & other}
        if shared:
            want[a] = (min(shared), sum(shared.values()))
    got = {r["book"]: (r["candidate"], r["n"]) for r in bindings.QUERIES["key_join"](spark, SF).collect()}
    assert got == want and max(got) > 50


def test_bindings_over_tables(spark):
    rows = lambda name: [tuple(r) for r in bindings.QUERIES[name](spark, SF).collect()]
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    orders = {r[0] for r in table("orders").select("o_orderkey").collect()}
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").collect()
    children = sum(r["l_orderkey"] in orders for r in lines)
    assert len(rows("child_rows")) == len(rows("child_rows_nullif")) == children
    flags = {s: [r["l_returnflag"] for r in lines if r["l_suppkey"] == s] for (s,) in table("supplier").select("s_suppkey").collect()}
    assert dict(rows("majority_value")) == {s: min(set(f), key=lambda x: (-f.count(x), x)) if f else "(unknown)" for s, f in flags.items()}
    assert {p for p, _ in rows("search_exists")} >= {r["l_partkey"] for r in lines if r["l_returnflag"] == "R"} & {p for (p,) in table("part").select("p_partkey").collect()}
    changes = {d: c for d, c, *_ in rows("map_diff")}
    labels = {r["doc_id"]: r for r in table("labels").collect()}
    assert {d for d, c in changes.items() if c != "added"} == {d for d, r in labels.items() if r["toxic"] == 1}
    last = {}
    for r in table("events").orderBy("event_id").collect():
        last.setdefault(r["user_id"], []).append(r["event_type"])
    assert dict(rows("guarded_merge")) == {u: e[0] if e[-1] == "error" != e[0] else e[-1] for u, e in last.items()}


def held_against_sql(spark, folder, name, tables):
    """(rows of a query, rows of its SQL) over small tables: name -> (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(bindings.ORACLE_SQL[name])
    got = bindings.QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_search_exists_leaves_out_parts_without_a_hit(spark, tmp_path):
    parts = [(1, "x", "x"), (2, "x", "x"), (3, "an A1r", None), (4, None, "a1R"), (5, None, None), (6, "x", None), (None, "x", "x"), (7, "twice", "x"), (7, "twice", "x"), (8, "no line", "x")]
    lines = [(1, "R"), (1, "R"), (1, "A"), (2, "A"), (2, None), (5, "r"), (6, "N"), (7, "R"), (None, "R"), (9, "R")]
    got, want = held_against_sql(spark, tmp_path, "search_exists", {"part": (parts, "p_partkey long, p_name string, p_type string"), "lineitem": (lines, "l_partkey long, l_returnflag string")})
    assert got == want and [p for p, _ in got] == [1, 3, 4, 5, 7, 7]


def test_resolved_stages_rounds_halves_as_its_sql_does(spark, tmp_path):
    values = [(1, "a", 50.05), (1, "a", 50.04), (2, "a", 50.06), (2, "a", 50.05), (3, "a", 50.15), (4, None, 50.05), (None, "a", 50.05), (5, "a", None), (6, "a", -0.05), (7, "a", 49.95), (8, "a", 50.050000000000004), (8, "b", 50.0500000001)]
    rows = [(at, *x) for at, x in enumerate(values)]
    got, want = held_against_sql(spark, tmp_path, "resolved_stages", {"events": (rows, "event_id long, user_id long, event_type string, value double")})
    assert got == want and {("1", "a", 0), ("2", "a", 3), ("4", None, 5), (None, "a", 6)} <= set(got)
