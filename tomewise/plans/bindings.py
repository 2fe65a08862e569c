"""Registered queries: the library's operators bound to the star-schema tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.functions import fields
from tomewise.operators import lists, merging, paging, picks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None = None) -> Callable:
    """Register ``f(tables)`` under its name; ``tables(name)`` reads a table."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Counts and lists


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey")
def author_counts(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_list(t: Tables) -> DataFrame:
    return lists.ordered_list(t("conversations"), ["conv_id"], ["turn"], "role", "roles")


@query("""
SELECT o_orderkey, coalesce((SELECT list(p ORDER BY p) FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey = o_orderkey)), CAST([] AS BIGINT[])) AS parts FROM orders
""")
def list_default_empty(t: Tables) -> DataFrame:
    child = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    return lists.with_list(t("orders").select("o_orderkey"), child, "o_orderkey", ["l_partkey"], "l_partkey", "parts", kind="bigint")


@query("""
SELECT o_orderkey, x.l_partkey AS first_part, x.l_suppkey AS first_supplier, x.l_linenumber AS first_line FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_returnflag = 'R') x ON l_orderkey = o_orderkey AND rn = 1
""")
def primary_pick(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    first = picks.pick(t("lineitem").where("l_returnflag = 'R'"), ["l_orderkey"], order, ["l_partkey", "l_suppkey", "l_linenumber"])
    orders = t("orders").select("o_orderkey")
    return orders.join(first, orders.o_orderkey == first.l_orderkey, "left").select("o_orderkey", F.col("l_partkey").alias("first_part"), F.col("l_suppkey").alias("first_supplier"), F.col("l_linenumber").alias("first_line"))


@query("SELECT nullif(l_linestatus, 'O') AS status, l_returnflag, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def nullif_group(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(F.nullif(F.col("l_linestatus"), F.lit("O")).alias("status"), "l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT event_type, count(DISTINCT c_custkey) AS n_users FROM events JOIN customer ON user_id = c_custkey GROUP BY event_type")
def join_count(t: Tables) -> DataFrame:
    e, c = t("events"), t("customer")
    return e.join(c, e.user_id == c.c_custkey).groupBy("event_type").agg(F.count_distinct("c_custkey").alias("n_users"))


@query("SELECT o_orderkey, o_orderstatus, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def child_rows(t: Tables) -> DataFrame:
    o, li = t("orders"), t("lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "o_orderstatus", "l_partkey")


@query("SELECT nullif(l_linestatus, 'O') AS series, o_orderkey, l_linenumber AS position FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def child_rows_nullif(t: Tables) -> DataFrame:
    o, li = t("orders"), t("lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.nullif(F.col("l_linestatus"), F.lit("O")).alias("series"), "o_orderkey", F.col("l_linenumber").alias("position"))


@query("""
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, text AS user_text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, text AS assistant_text FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.position, a.position) AS position, user_text, assistant_text FROM u FULL OUTER JOIN a ON u.conv_id = a.conv_id AND u.position = a.position
""")
def full_outer_positional(t: Tables) -> DataFrame:
    def of(role: str, out: str) -> DataFrame:
        rows = paging.numbered(t("conversations").where(F.col("role") == role), ["conv_id"], [F.col("turn")], "position")
        return rows.select("conv_id", long("position").alias("position"), F.col("text").alias(out))

    return merging.full_outer_by_position(of("user", "user_text"), of("assistant", "assistant_text"), ["conv_id", "position"])


@query("""
WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS rn FROM n)
SELECT s_suppkey, coalesce(l_returnflag, '(unknown)') AS flag FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey AND rn = 1
""")
def majority_value(t: Tables) -> DataFrame:
    s, best = t("supplier").select("s_suppkey"), picks.majority(t("lineitem"), ["l_suppkey"], "l_returnflag", "flag")
    return s.join(best, s.s_suppkey == best.l_suppkey, "left").select("s_suppkey", F.coalesce("flag", F.lit("(unknown)")).alias("flag"))


# Search, top-k and pages


@query("""
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A1R%' OR p_type ILIKE '%A1R%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND 'a1' || l_returnflag ILIKE '%A1R%')
""")
def search_exists(t: Tables) -> DataFrame:
    child = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("a1"), F.col("l_returnflag")).alias("tag"))
    return paging.search(t("part"), ["p_name", "p_type"], "A1R", child, "p_partkey", "tag").select("p_partkey", "p_name")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(t: Tables) -> DataFrame:
    return paging.top(t("events").select("event_id", "ts", "user_id"), [F.col("ts").desc_nulls_last(), F.col("event_id").desc()], 20)


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def page_offset(t: Tables) -> DataFrame:
    return paging.top(t("events").select("event_id", "ts", "user_id"), [F.col("ts").desc_nulls_last(), F.col("event_id").desc()], 20, 40)


@query("SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 500")
def paged_total(t: Tables) -> DataFrame:
    return paging.with_total(t("documents").where("lang = 'en'").select("doc_id", "lang"), [F.col("doc_id")], 500)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t: Tables) -> DataFrame:
    return merging.delete_keys(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(t: Tables) -> DataFrame:
    big = t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("""
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_customers, (SELECT max(o_orderdate) FROM orders) AS latest, (SELECT count(*) FROM labels WHERE quality = 1) AS n_good
""")
def dashboard(t: Tables) -> DataFrame:
    orders = t("orders").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.max("o_orderdate").alias("latest"))
    return orders.crossJoin(t("labels").where("quality = 1").agg(F.count("*").alias("n_good")))  # one row each


@query("SELECT year(o_orderdate + INTERVAL 9 HOUR)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1")
def shifted_year(t: Tables) -> DataFrame:
    return t("orders").groupBy(long(F.year(F.col("o_orderdate") + F.expr("interval 9 hour"))).alias("year")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING list_has_any(list(role), ['system'])")
def list_overlap(t: Tables) -> DataFrame:
    return lists.ordered_list(t("conversations"), ["conv_id"], ["turn"], "role", "roles").where(lists.overlaps("roles", ["system"]))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING array_to_string(list(role ORDER BY turn), ' ') ILIKE '%SYSTEM user%'")
def list_text(t: Tables) -> DataFrame:
    return lists.ordered_list(t("conversations"), ["conv_id"], ["turn"], "role", "roles").where(lists.contains_text("roles", "SYSTEM user"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'E%'")
def prefix_filter(t: Tables) -> DataFrame:
    return t("part").where(F.col("p_type").startswith("E")).select("p_partkey", "p_type")


@query("""
SELECT e.event_type, l.label, count(*) AS n FROM events e LEFT JOIN (VALUES ('cli', 'click'), ('pur', 'purchase'), ('vie', 'view')) l(code, label) ON l.code = substr(e.event_type, 1, 3) GROUP BY ALL
""")
def label_lookup(t: Tables) -> DataFrame:
    e = t("events")
    labels = e.sparkSession.sql("SELECT * FROM VALUES ('cli', 'click'), ('pur', 'purchase'), ('vie', 'view') AS t(code, label)")  # a local relation
    return e.join(F.broadcast(labels), F.substring("event_type", 1, 3) == F.col("code"), "left").groupBy("event_type", "label").agg(F.count("*").alias("n"))


# Import


@query("SELECT p_partkey, i::BIGINT AS part_order, trim(string_split(p_name, ' ')[i]) AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) WHERE trim(string_split(p_name, ' ')[i]) <> ''")
def split_explode(t: Tables) -> DataFrame:
    return lists.split_explode(t("part"), ["p_partkey"], "p_name", " ", "word", "part_order").withColumn("part_order", long("part_order"))


@query("SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS role_order FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL)")
def first_occurrence(t: Tables) -> DataFrame:
    return picks.first_occurrence(t("conversations"), ["conv_id"], "role", "turn", "role_order").withColumn("role_order", long("role_order"))


@query("""
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1
""")
def first_wins(t: Tables) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return picks.first_wins(t("lineitem"), ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, regexp_extract(c_name, '^(.+)#([0-9]+)$', 1) AS name, nullif(regexp_extract(c_name, '^(.+)#([0-9]+)$', 2), '') AS id FROM customer")
def suffix_split(t: Tables) -> DataFrame:
    name, code = fields.suffix_split(F.col("c_name"), "^(.+)#([0-9]+)$")
    return t("customer").select("c_custkey", name.alias("name"), code.alias("id"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def safe_int(t: Tables) -> DataFrame:
    return t("events").select("event_id", fields.safe_int(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT count(*) AS n FROM (SELECT s_suppkey FROM supplier UNION SELECT l_suppkey FROM lineitem UNION SELECT c_custkey FROM customer)")
def union_distinct(t: Tables) -> DataFrame:
    parts = [t("supplier").select("s_suppkey"), t("lineitem").select("l_suppkey"), t("customer").select("c_custkey")]
    return merging.union_distinct(parts).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return merging.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)")
def delete_set(t: Tables) -> DataFrame:
    deleted = t("events").where("event_type = 'error' and value > 90").select("user_id")
    return merging.delete_keys(t("events").select("event_id", "user_id"), deleted, "user_id")


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_pairs(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_returnflag").distinct()


# Text and numbers


@query("""
SELECT p_partkey, c || ((10 - (list_sum([substr(c, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10)) % 10)::INT::VARCHAR AS isbn
FROM (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS c FROM part)
""")
def isbn13(t: Tables) -> DataFrame:
    ten = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("X"))
    return t("part").select("p_partkey", fields.isbn13(ten).alias("isbn"))


@query("""
SELECT p_partkey, (10 - (list_sum([substr(c, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10)) % 10 = substr(c, 13, 1)::INT AS ok
FROM (SELECT p_partkey, '978' || lpad(((p_partkey * 7919) % 10000000000)::VARCHAR, 10, '0') AS c FROM part)
""")
def isbn_ok(t: Tables) -> DataFrame:
    code = F.concat(F.lit("978"), F.lpad(((F.col("p_partkey") * 7919) % 10000000000).cast("string"), 10, "0"))
    return t("part").select("p_partkey", fields.isbn_ok(code).alias("ok"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS issued FROM orders")
def issued_format(t: Tables) -> DataFrame:
    text = F.concat(F.lit("["), F.year("o_orderdate").cast("string"), F.lit("."), F.month("o_orderdate").cast("string"), F.lit("]"))
    return t("orders").select("o_orderkey", fields.issued(text).alias("issued"))


@query("SELECT o_orderkey, greatest(o_orderkey % 500, 17)::INTEGER AS pages FROM orders")
def pages_format(t: Tables) -> DataFrame:
    text = F.concat((F.col("o_orderkey") % 500).cast("string"), F.lit(", 17p 図版999枚 ; 2000cm"))
    return t("orders").select("o_orderkey", fields.pages(text).alias("pages"))


@query("""
SELECT conv_id, list(DISTINCT text ORDER BY text) AS notes FROM (SELECT conv_id, trim(role) AS text FROM conversations WHERE trim(role) NOT IN ('', '出版')) GROUP BY conv_id
""")
def notes_format(t: Tables) -> DataFrame:
    rows = lists.ordered_list(t("conversations").withColumn("text", F.concat(F.lit(" "), F.col("role"), F.lit(" "))).unionByName(t("conversations").withColumn("text", F.lit("出版"))), ["conv_id"], ["role", "turn"], "text", "all")
    return rows.select("conv_id", F.array_sort(fields.notes(F.col("all"))).alias("notes"))


@query("""
SELECT l_orderkey, arg_min(l_returnflag, (CASE l_linenumber WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 4 END) * 100000000 + l_partkey * 10 + l_linenumber) AS code
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS l_returnflag FROM lineitem) GROUP BY l_orderkey
""")
def preferred_class(t: Tables) -> DataFrame:
    edition = F.when(F.col("l_linenumber") == 3, "10").when(F.col("l_linenumber") == 2, "9").when(F.col("l_linenumber") == 1, "8").otherwise("7")
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    packed = lists.ordered_list(rows.withColumn("entry", F.struct(edition.alias("edition"), F.col("l_returnflag").alias("code"))), ["l_orderkey"], ["l_partkey", "l_linenumber"], "entry", "classes")
    return packed.select("l_orderkey", fields.preferred_class(F.col("classes"))["code"].alias("code"))


# Matching and state


@query("SELECT conv_id, turn FROM (SELECT *, max(length(text) > 600) OVER (PARTITION BY conv_id) AS any_long FROM conversations) WHERE NOT any_long OR length(text) > 600")
def narrow_if_any(t: Tables) -> DataFrame:
    return picks.narrow_if_any(t("conversations"), ["conv_id"], F.length("text") > 600).select("conv_id", "turn")


@query("SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 AND count(role) = count(*) THEN max(role) END AS role FROM conversations GROUP BY conv_id")
def common_value(t: Tables) -> DataFrame:
    return lists.common_value(t("conversations"), ["conv_id"], "role", "role")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, arg_min(flags, l_linenumber) AS first, count(*) AS n FROM l GROUP BY l_orderkey),
c AS (SELECT l.l_orderkey, x.v, count(*) AS n FROM l, unnest(flags) x(v) GROUP BY ALL)
SELECT f.l_orderkey, coalesce(list(c.v ORDER BY c.v) FILTER (WHERE c.n = f.n), CAST([] AS VARCHAR[])) AS flags FROM f LEFT JOIN c ON c.l_orderkey = f.l_orderkey AND list_contains(f.first, c.v) GROUP BY f.l_orderkey
""")
def common_values(t: Tables) -> DataFrame:
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set("l_returnflag")).alias("values"))
    return lists.common_values(rows, ["l_orderkey"], ["l_linenumber"], "values", "flags")


@query("""
WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE toxic = 1 AND quality = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.quality AS old_value, b.quality AS new_value
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality IS DISTINCT FROM b.quality
""")
def map_diff(t: Tables) -> DataFrame:
    """All labels against a version without toxic ones of quality 0, those of quality 1 lowered, and unlabelled documents as 0."""
    old, docs = t("labels").select("doc_id", "quality"), t("documents").select("doc_id")
    kept = t("labels").where("toxic = 0 or quality = 1").select("doc_id", F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    return merging.map_diff(old, kept.unionByName(docs.join(old, "doc_id", "left_anti").withColumn("quality", F.lit(0))), "doc_id", "quality")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels")
def keyed_merge(t: Tables) -> DataFrame:
    labels = t("labels")
    return merging.keyed_merge(labels, labels.where("toxic = 1").withColumn("quality", (1 - F.col("quality")).cast(labels.schema["quality"].dataType)), "doc_id")


@query("""
SELECT e.user_id, CASE WHEN n.event_type IS NULL OR (n.event_type = 'error' AND e.event_type <> 'error') THEN e.event_type ELSE n.event_type END AS status
FROM (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id) e LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) n USING (user_id)
""")
def guarded_merge(t: Tables) -> DataFrame:
    current = picks.pick(t("events"), ["user_id"], [F.col("event_id")], ["event_type"]).select("user_id", F.col("event_type").alias("status"))
    results = t("events").select("user_id", F.col("event_type").alias("status"), "event_id")
    return merging.latest_result(current, results, "user_id", "status", [F.col("event_id").desc()])


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unfetched' WHEN l.quality = 0 THEN 'error' WHEN l.toxic = 1 THEN 'incomplete' ELSE 'found' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500) AND (l.doc_id IS NULL OR l.quality = 0 OR l.toxic = 1)
""")
def target_state(t: Tables) -> DataFrame:
    wanted = t("documents").where("n_chars > 500").select("doc_id")
    state = F.when(F.col("seen").isNull(), "unfetched").when(F.col("quality") == 0, "error").when(F.col("toxic") == 1, "incomplete").otherwise("found")
    rows = t("documents").select("doc_id").join(t("labels").withColumn("seen", F.lit(True)), "doc_id", "left").join(wanted, "doc_id", "left_semi")
    return rows.select("doc_id", state.alias("state")).where("state <> 'found'")


@query("""
WITH s AS (SELECT user_id, event_type, min(event_id) AS ref FROM events WHERE value <= 50 GROUP BY ALL)
SELECT user_id, arg_min(event_type, ref) AS stage, min(ref) AS ref FROM s GROUP BY user_id
""")
def staged_resolution(t: Tables) -> DataFrame:
    """Per stage the first answer within the limit, then the first stage that has one."""
    resolved = t("events").where("value <= 50").groupBy("user_id", "event_type").agg(F.min("event_id").alias("ref"))
    return picks.pick(resolved, ["user_id"], [F.col("ref")], ["event_type", "ref"]).select("user_id", F.col("event_type").alias("stage"), "ref")


@query("""
WITH k AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part), d AS (SELECT DISTINCT p_partkey, key FROM k)
SELECT a.p_partkey AS book, min(b.p_partkey) AS candidate, count(*) AS n FROM d a JOIN d b ON a.key = b.key AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey
""")
def key_join(t: Tables) -> DataFrame:
    """Entity resolution: rows that share exploded keys, one row per book."""
    keys = t("part").select(F.col("p_partkey").alias("book"), F.explode(F.split("p_name", " ")).alias("key"))
    return merging.key_candidates(keys, "book", "key")
