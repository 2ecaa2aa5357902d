"""One query per operator over the supplied tables, with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tempora.functions.lineage import scratch
from tempora.model import OPEN, Graph, PropertySpec
from tempora.operators import adjacency, analytics as A, relational, temporal, write
from tempora.operators.write import GraphWriter
from tempora.plans import ir
from tempora.plans.lower import Snapshot
from tempora.session import GraphSession
from tempora.sources import tables
from tempora.sources.provider import Provider
from tempora.sources.store import export_snapshot
from tempora.streaming.ingest import ChangeFeed, Ingest
from tempora.streaming.jobs import Jobs

V = tables.VALID_AT
DAY = 86_400_000_000
#: The window of the temporal algorithms: two days from the probe instant.
START, END = V, V + 2 * DAY

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- SQL of the graphs

_DEAD, _GONE = "(event_type = 'error' AND event_id % 16 = 0)", "(event_type = 'error' AND event_id % 16 = 8)"
_AV = f"""av AS (SELECT user_id + 1 AS id, event_id + 1 AS version, CASE WHEN NOT {_DEAD} THEN epoch_us(ts) END AS valid_from, CASE WHEN NOT {_DEAD} THEN 9223372036854775807 END AS valid_to,
 event_id + 1 AS tx_time, {_DEAD} AS tombstone, event_id + 1 AS log_index, 0 AS ordinal, value, event_type FROM events)"""
_AE = f"""ae AS (SELECT user_id * 100 + k + 1 AS id, event_id + 1 AS version, CASE WHEN NOT {_GONE} THEN epoch_us(ts) END AS valid_from, CASE WHEN NOT {_GONE} THEN epoch_us(ts) + 604800000000 END AS valid_to,
 event_id + 1 AS tx_time, {_GONE} AS tombstone, event_id + 1 AS log_index, 1 AS ordinal, user_id + 1 AS src, k + 1 AS dst, upper(event_type) AS edge_type, value
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_TX = "(SELECT count(*) * 7 // 10 FROM events)"


def _seen(table: str, name: str, valid: int = V, tx: str = _TX) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_time DESC, version DESC, tombstone, log_index, ordinal) AS rn
 FROM {table} WHERE tx_time <= {tx} AND (tombstone OR (valid_from <= {valid} AND {valid} < valid_to))) WHERE rn = 1 AND NOT tombstone)"""


_BOTH = f"WITH {_AV}, {_AE}, {_seen('av', 'vs')}, {_seen('ae', 'es')}"
_ALL = f"WITH {_AV}, {_AE}"
_CONTACTS = """c AS (SELECT event_id + 1 AS id, user_id + 1 AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS dst, epoch_us(ts) AS dep,
 epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS arr, value AS w FROM events), n AS (SELECT src AS id FROM c UNION SELECT dst FROM c)"""
_PAIRS = "e AS (SELECT src, dst, count(*) AS k FROM c GROUP BY src, dst)"


def activity(spark: SparkSession, d: str) -> tuple[GraphSession, dict]:
    v, t = tables.probe(spark, d)
    return GraphSession(spark, tables.activity(spark, d)), {"v": v, "t": t}


def ask(spark: SparkSession, d: str, text: str, names: list[str], **params) -> DataFrame:
    s, at = activity(spark, d)
    return s.query(text, params, at["v"], at["t"]).toDF(*names)


def shop(spark: SparkSession, d: str) -> GraphSession:
    return GraphSession(spark, tables.commerce(spark, d))


def _at(spark: SparkSession, d: str) -> Snapshot:
    v, t = tables.probe(spark, d)
    return Snapshot(v, t)


def var(name: str) -> ir.Variable:
    return ir.Variable(name)


def prop(v: str, p: str) -> ir.Property:
    return ir.Property(var(v), p)


def items(*pairs) -> tuple:
    return tuple(pairs)


# ---- scans, points, history, changes

@query("scan_vertices_asof", f"{_BOTH} SELECT id, value, event_type FROM vs")
def scan_vertices_asof(spark, d):
    s, at = activity(spark, d)
    return s.query("MATCH (n) FOR SYSTEM_TIME AS OF $t FOR VALID_TIME AS OF $v RETURN n.id, n.value, n.event_type ORDER BY n.id", at).toDF("id", "value", "event_type")


@query("scan_edges_asof", f"{_BOTH} SELECT id, src, dst, edge_type, value FROM es")
def scan_edges_asof(spark, d):
    s, _ = activity(spark, d)
    return s.plan(ir.Project(ir.RelationshipScan("r"), items(*((prop("r", p), p) for p in ("id", "src", "dst", "edge_type", "value")))), snapshot=_at(spark, d))


@query("vertex_point", f"{_BOTH} SELECT id, value FROM vs WHERE id = 5")
def vertex_point(spark, d):
    return ask(spark, d, "MATCH (n) WHERE n.id = $id RETURN n.id, n.value", ["id", "value"], id=5)


@query("edge_point", f"{_BOTH} SELECT id, src, dst, value FROM es WHERE id = (SELECT max(id) FROM es WHERE id <= 1400)")
def edge_point(spark, d):
    s, at = activity(spark, d)
    known = temporal.visible(s.default.edges.where(F.col("id") <= 1400), at["v"], at["t"], []).agg(F.max("id")).first()[0]
    return s.plan(ir.Project(ir.RelationshipLookup("r", ir.Literal(known)), items(*((prop("r", p), p) for p in ("id", "src", "dst", "value")))), snapshot=_at(spark, d))


@query("vertex_history_range", f"{_ALL} SELECT id, version, tx_time, valid_from, value FROM av WHERE id = 8 AND tx_time BETWEEN 10 AND 5000 AND NOT tombstone ORDER BY tx_time, version LIMIT 40")
def vertex_history_range(spark, d):
    return temporal.history_of(tables.activity(spark, d).vertices, 8, 10, 5000, 40).select("id", "version", "tx_time", "valid_from", "value")


@query("edge_history_range", f"{_ALL} SELECT id, version, tx_time, src, dst FROM ae WHERE id = (SELECT max(id) FROM ae WHERE id <= 1400 AND NOT tombstone AND tx_time <= (SELECT count(*) * 7 // 10 FROM events)) AND tx_time BETWEEN 1 AND {_TX} AND NOT tombstone")
def edge_history_range(spark, d):
    e, tx = tables.activity(spark, d).edges, tables.probe(spark, d)[1]
    known = e.where((F.col("id") <= 1400) & ~F.col("tombstone") & (F.col("tx_time") <= tx)).agg(F.max("id")).first()[0]
    return temporal.history_of(e, known, 1, tx).select("id", "version", "tx_time", "src", "dst")


_LOG = """SELECT log_index, ordinal, 'vertex' AS entity, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS change_kind, id, version, tx_time, valid_from, valid_to FROM av
 UNION ALL SELECT log_index, ordinal, 'edge', CASE WHEN tombstone THEN 'delete' ELSE 'put' END, id, version, tx_time, valid_from, valid_to FROM ae"""


@query("changes_page", f"{_ALL} SELECT log_index, ordinal, entity, change_kind, id, version FROM ({_LOG}) WHERE log_index <= 400 AND (log_index > 100 OR (log_index = 100 AND ordinal > 0)) ORDER BY log_index, ordinal LIMIT 50")
def changes_page(spark, d):
    g = tables.activity(spark, d)
    return temporal.changes(temporal.change_log(g.vertices, g.edges), (100, 0), 400, 50).select("log_index", "ordinal", "entity", "change_kind", "id", "version")


_OVER = f"""known AS (SELECT * FROM ae WHERE tx_time <= {_TX}), dead AS (SELECT id, max(tx_time) AS dead FROM known WHERE tombstone GROUP BY id),
 latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, valid_from ORDER BY tx_time DESC, version DESC) AS rn FROM known WHERE NOT tombstone AND valid_from < {{b}} AND {{a}} < valid_to) WHERE rn = 1),
 alive AS (SELECT l.* FROM latest l LEFT JOIN dead d USING (id) WHERE d.dead IS NULL OR l.tx_time >= d.dead)"""


@query("valid_overlap", f"{_ALL}, {_OVER.format(a=V, b=V + DAY)} SELECT id, version, valid_from FROM alive")
def valid_overlap(spark, d):
    s, at = activity(spark, d)
    plan = ir.Project(ir.RelationshipScan("r", (), ir.Scope(("as_of", at["t"]), ("between", V, V + DAY))), items(*((prop("r", p), p) for p in ("id", "version", "valid_from"))))
    return s.plan(plan)


@query("changes_system", f"{_ALL} SELECT id, version, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS change_kind FROM av WHERE tx_time BETWEEN 200 AND 900")
def changes_system(spark, d):
    return ask(spark, d, "CHANGES FOR SYSTEM_TIME BETWEEN 200 AND 900 MATCH (n) RETURN n.id, n.version, n.change_kind", ["id", "version", "change_kind"])


@query("changes_valid", f"""{_ALL}, {_OVER.format(a='(-9223372036854775807 - 1)', b='9223372036854775807')}
 SELECT id, version, CASE WHEN b AND e THEN 'both' WHEN b THEN 'begin' ELSE 'end' END AS change_kind FROM (SELECT *, valid_from BETWEEN {V} AND {V + DAY} AS b, valid_to BETWEEN {V} AND {V + DAY} AS e FROM alive) WHERE b OR e""")
def changes_valid(spark, d):
    s, at = activity(spark, d)
    plan = ir.Project(ir.RelationshipScan("r", (), ir.Scope(("as_of", at["t"]), ("changes", V, V + DAY))), items(*((prop("r", p), p) for p in ("id", "version", "change_kind"))))
    return s.plan(plan)


# ---- filters, projections, expressions

@query("filter_property", f"{_BOTH} SELECT id, value FROM vs WHERE event_type = 'click'")
def filter_property(spark, d):
    return ask(spark, d, "MATCH (n {event_type: $e}) RETURN n.id, n.value", ["id", "value"], e="click")


@query("filter_label_type", "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def filter_label_type(spark, d):
    return shop(spark, d).query("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN c.name, n.name").toDF("customer", "nation")


@query("project_alias", f"{_BOTH} SELECT id AS \"n.id\", id AS \"n.id_2\", 'x' AS expression_2, CAST(7 AS BIGINT) AS \"$p\" FROM vs")
def project_alias(spark, d):
    s, at = activity(spark, d)
    return s.query("MATCH (n) RETURN n.id, n.id, 'x', $p", {"p": 7}, at["v"], at["t"])


@query("expr_arith_bool", f"""{_BOTH} SELECT id, (id * 3 - 1) // 2 AS a, -id AS b, id > 50 AND value < 80.0 AS c, NOT (id = 7) OR value IS NULL AS d, contains(event_type, 'rr') AS e, TRUE AS f, FALSE AS g, CAST(NULL AS BOOLEAN) AS h,
 list_contains([1, 2, 3], id) AS i FROM vs""")
def expr_arith_bool(spark, d):
    s, _ = activity(spark, d)
    b, lit, i, v = ir.Binary, ir.Literal, prop("n", "id"), prop("n", "value")
    exprs = items(
        (i, "id"), (b("/", b("-", b("*", i, lit(3)), lit(1)), lit(2)), "a"), (ir.Unary("negate", i), "b"),
        (b("and", b(">", i, lit(50)), b("<", v, lit(80.0))), "c"), (b("or", ir.Unary("not", b("=", i, lit(7))), ir.Unary("is_null", v)), "d"),
        (b("contains", prop("n", "event_type"), lit("rr")), "e"), (b("<", i, v), "f"), (b("=", i, v), "g"), (b("=", i, lit(None)), "h"),
        (b("contains", ir.ListOf((lit(1), lit(2), lit(3))), i), "i"),
    )
    return s.plan(ir.Project(ir.NodeScan("n"), exprs), snapshot=_at(spark, d))


@query("expr_compare", f"""{_BOTH} SELECT id, id + 3 AS a, id + (-id) AS b, id <> 7 AS c, value <> 20.0 AS d, id <= 9 AS e, id >= 9 AS f, value <= 50.0 AS g, event_type >= 'purchase' AS h, event_type <> 'view' AS i,
 TRUE AS j, CAST(NULL AS BOOLEAN) AS k, id + 1 AS l, event_type AS m, CAST(NULL AS BIGINT) AS n FROM vs""")
def expr_compare(spark, d):
    s, _ = activity(spark, d)
    b, lit, i, v, t = ir.Binary, ir.Literal, prop("n", "id"), prop("n", "value"), prop("n", "event_type")
    m = ir.MapOf((("p", b("+", i, lit(1))),))
    exprs = items(
        (i, "id"), (b("+", i, lit(3)), "a"), (b("+", i, ir.Unary("negate", i)), "b"), (b("<>", i, lit(7)), "c"), (b("<>", v, lit(20.0)), "d"),
        (b("<=", i, lit(9)), "e"), (b(">=", i, lit(9)), "f"), (b("<=", v, lit(50.0)), "g"), (b(">=", t, lit("purchase")), "h"), (b("<>", t, lit("view")), "i"),
        (b("<>", i, lit("7")), "j"), (b(">=", i, lit(None)), "k"), (ir.Property(m, "p"), "l"), (ir.Property(ir.MapOf((("q", t),)), "q"), "m"), (ir.Property(m, "absent"), "n"),
    )
    return s.plan(ir.Project(ir.NodeScan("n"), exprs), snapshot=_at(spark, d))


@query("entity_shape", f"{_BOTH} SELECT r.id, r.src AS source, r.dst AS target, r.edge_type AS type, r.value, a.id AS vertex, 'User' AS labels, a.value AS score FROM es r JOIN vs a ON a.id = r.src JOIN vs b ON b.id = r.dst")
def entity_shape(spark, d):
    rows = ask(spark, d, "MATCH (a)-[r]->(b) RETURN r, a", ["r", "a"])
    return rows.select("r.id", "r.source", "r.target", "r.type", "r.value", F.col("a.id").alias("vertex"), F.array_join("a.labels", ",").alias("labels"), F.col("a.value").alias("score"))


# ---- joins

def _keyed(spark, d) -> GraphSession:
    """Customers and suppliers with a nation key that is null for nation 0."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"), F.lit("C").alias("label"), F.nullif(F.col("c_nationkey"), F.lit(0)).cast("bigint").alias("k"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 10_000_000).alias("i"), F.lit("S").alias("label"), F.nullif(F.col("s_nationkey"), F.lit(0)).cast("bigint").alias("k"))
    one = F.lit(1).cast("bigint")
    v = c.unionByName(s).select((F.col("i") + 1).alias("id"), one.alias("version"), F.lit(0).cast("bigint").alias("valid_from"), F.lit((1 << 63) - 1).alias("valid_to"), one.alias("tx_time"), F.lit(False).alias("tombstone"), one.alias("log_index"), F.col("i").alias("ordinal"), F.array("label").alias("labels"), "k")
    return GraphSession(spark, Graph(v, tables.activity(spark, d).edges.limit(0), [PropertySpec("k", "integer")], []))


def _side(v: str, label: str) -> ir.Project:
    return ir.Project(ir.NodeScan(v, (label,)), items((prop(v, "id"), f"{v}_id"), (prop(v, "k"), f"{v}_k")))


_KEYED = "c AS (SELECT c_custkey + 1 AS c_id, nullif(c_nationkey, 0) AS c_k FROM customer), s AS (SELECT s_suppkey + 10000001 AS s_id, nullif(s_nationkey, 0) AS s_k FROM supplier WHERE s_nationkey < 12)"


def _joined(spark, d, kind: str) -> DataFrame:
    right = ir.Filter(_side("s", "S"), ir.Binary("or", ir.Unary("is_null", var("s_k")), ir.Binary("<", var("s_k"), ir.Literal(12))))
    return _keyed(spark, d).plan(ir.Join(_side("c", "C"), right, kind, ir.Binary("=", var("c_k"), var("s_k"))))


@query("join_inner_nullsafe", f"WITH {_KEYED} SELECT c_k, count(*) AS n, CAST(sum(s_id) AS BIGINT) AS t FROM c JOIN s ON c_k IS NOT DISTINCT FROM s_k GROUP BY c_k")
def join_inner_nullsafe(spark, d):
    return _joined(spark, d, "inner").groupBy("c_k").agg(F.count("*").alias("n"), F.sum("s_id").alias("t"))


@query("join_left", f"WITH {_KEYED} SELECT c_k, count(*) AS n, count(s_id) AS m FROM c LEFT JOIN s ON c_k IS NOT DISTINCT FROM s_k GROUP BY c_k")
def join_left(spark, d):
    return _joined(spark, d, "left").groupBy("c_k").agg(F.count("*").alias("n"), F.count("s_id").alias("m"))


@query("join_semi", f"WITH {_KEYED} SELECT c_id, c_k FROM c WHERE EXISTS (SELECT 1 FROM s WHERE c_k IS NOT DISTINCT FROM s_k)")
def join_semi(spark, d):
    return _joined(spark, d, "left_semi")


@query("join_anti", f"WITH {_KEYED} SELECT c_id, c_k FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE c_k IS NOT DISTINCT FROM s_k)")
def join_anti(spark, d):
    return _joined(spark, d, "left_anti")


@query("cross_match_where", "SELECT s_name AS supplier, n_name AS nation FROM supplier CROSS JOIN nation WHERE n_name = 'NATION_3'")
def cross_match_where(spark, d):
    return shop(spark, d).query("MATCH (a:Supplier) MATCH (b:Nation) WHERE b.name = 'NATION_3' RETURN a.name, b.name").toDF("supplier", "nation")


@query("join_theta", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def join_theta(spark, d):
    plan = ir.Join(ir.NodeScan("a", ("Region",)), ir.NodeScan("b", ("Region",)), "inner", ir.Binary("<", prop("a", "id"), prop("b", "id")))
    return shop(spark, d).plan(ir.Project(plan, items((prop("a", "name"), "x"), (prop("b", "name"), "y"))))


@query("subquery_semi", f"{_BOTH} SELECT id, value FROM vs WHERE EXISTS (SELECT 1 FROM es WHERE es.dst = vs.id)")
def subquery_semi(spark, d):
    s, _ = activity(spark, d)
    plan = ir.Subquery(ir.NodeScan("n"), ir.RelationshipScan("r"), "left_semi", ir.Binary("=", prop("r", "dst"), prop("n", "id")))
    return s.plan(ir.Project(plan, items((prop("n", "id"), "id"), (prop("n", "value"), "value"))), snapshot=_at(spark, d))


# ---- expansion

_HOP = f"{_BOTH} SELECT a.id AS a, b.id AS b, r.value AS value FROM vs a JOIN es r ON {{on}} JOIN vs b ON {{far}}"


@query("expand_out", _HOP.format(on="a.id = r.src", far="b.id = r.dst"))
def expand_out(spark, d):
    return ask(spark, d, "MATCH (a)-[r]->(b) RETURN a.id, b.id, r.value", ["a", "b", "value"])


@query("expand_in", _HOP.format(on="a.id = r.dst", far="b.id = r.src"))
def expand_in(spark, d):
    return ask(spark, d, "MATCH (a)<-[r]-(b) RETURN a.id, b.id, r.value", ["a", "b", "value"])


@query("expand_either", _HOP.format(on="a.id = r.src OR a.id = r.dst", far="b.id = CASE WHEN a.id = r.src THEN r.dst ELSE r.src END"))
def expand_either(spark, d):
    return ask(spark, d, "MATCH (a)-[r]-(b) RETURN a.id, b.id, r.value", ["a", "b", "value"])


@query("expand_edges_only", f"{_BOTH} SELECT a.id AS a, r.id AS r, r.edge_type AS t FROM vs a JOIN es r ON a.id = r.src WHERE r.edge_type IN ('CLICK', 'VIEW')")
def expand_edges_only(spark, d):
    s, _ = activity(spark, d)
    plan = ir.Expand(ir.NodeScan("a"), "a", "r", None, "out", ("CLICK", "VIEW"))
    return s.plan(ir.Project(plan, items((prop("a", "id"), "a"), (prop("r", "id"), "r"), (prop("r", "edge_type"), "t"))), snapshot=_at(spark, d))


@query("adjacency_point", f"{_BOTH} SELECT r.id AS id, r.dst AS dst FROM vs a JOIN es r ON a.id = r.src JOIN vs b ON b.id = r.dst WHERE a.id = 3")
def adjacency_point(spark, d):
    return ask(spark, d, "MATCH (a)-[r]->(b) WHERE a.id = 3 RETURN r.id, r.dst", ["id", "dst"])


@query("traverse_two_hop", f"{_BOTH} SELECT a.id AS a, r2.id AS second FROM vs a JOIN es r1 ON a.id = r1.src JOIN vs m ON m.id = r1.dst JOIN es r2 ON m.id = r2.src JOIN vs z ON z.id = r2.dst WHERE a.id = 3")
def traverse_two_hop(spark, d):
    return ask(spark, d, "MATCH (a)-[first]->(middle)-[second]->(destination) WHERE a.id = $id RETURN a.id, second.id", ["a", "second"], id=3)


@query("pattern_three_hop", "SELECT c_custkey + 3000000001 AS customer, o_orderkey + 6000000001 AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def pattern_three_hop(spark, d):
    return shop(spark, d).query("MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN c.id, o.id").toDF("customer", "o")


_LINES = "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
_TAIL = "JOIN l l2 ON l2.p = l1.p JOIN orders o2 ON o2.o_orderkey = l2.o JOIN customer c2 ON c2.c_custkey = o2.o_custkey JOIN nation n2 ON n2.n_nationkey = c2.c_nationkey JOIN nation m ON m.n_regionkey = n2.n_regionkey JOIN supplier s ON s.s_nationkey = m.n_nationkey"


@query("traverse_four_hop", f"{_LINES} SELECT l1.p + 5000000001 AS p, c_custkey + 3000000001 AS c FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN l l1 ON l1.o = o_orderkey WHERE r_regionkey = 2")
def traverse_four_hop(spark, d):
    text = "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE r.id = $id RETURN p.id, c.id"
    return shop(spark, d).query(text, {"id": tables.REGION + 3}).toDF("p", "c")


@query("traverse_six_hop", f"{_LINES} SELECT s_suppkey + 4000000001 AS s, count(*) AS n FROM l l1 {_TAIL} WHERE l1.o = 7 GROUP BY s_suppkey")
def traverse_six_hop(spark, d):
    text = """MATCH (o:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(q:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(m:Nation)<-[:IN_NATION]-(s:Supplier)
     WHERE o.id = $id RETURN s.id"""
    return shop(spark, d).query(text, {"id": tables.ORDER + 8}).toDF("s").groupBy("s").agg(F.count("*").alias("n"))


@query("traverse_eight_hop", f"{_LINES} SELECT s_suppkey + 4000000001 AS s, count(*) AS n FROM orders o1 JOIN l l1 ON l1.o = o1.o_orderkey {_TAIL} WHERE o1.o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY s_suppkey")
def traverse_eight_hop(spark, d):
    text = """MATCH (a:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(q:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(m:Nation)<-[:IN_NATION]-(s:Supplier)
     WHERE a.id = $id RETURN s.id"""
    first = spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_custkey")).first()[0]
    return shop(spark, d).query(text, {"id": tables.CUSTOMER + first + 1}).toDF("s").groupBy("s").agg(F.count("*").alias("n"))


@query("csr_neighbours", f"""{_BOTH}, p AS (SELECT src, dst, id, row_number() OVER (ORDER BY src, dst, id) - 1 AS place FROM es), v AS (SELECT src AS x FROM es UNION SELECT dst FROM es)
 SELECT x AS vertex, (SELECT count(*) FROM es WHERE src < x) AS first, (SELECT count(*) FROM es WHERE src = x) AS degree, p.dst AS neighbor, p.id AS edge_id, p.place FROM v LEFT JOIN p ON p.src = x""")
def csr_neighbours(spark, d):
    v, t = tables.probe(spark, d)
    edges = temporal.visible(tables.activity(spark, d).edges, v, t, ["src", "dst"])
    a = adjacency.build(edges, scratch(spark, "adjacency"))
    return a.offsets.join(a.neighbours, F.col("vertex") == F.col("anchor"), "left").select("vertex", "first", "degree", "neighbor", "edge_id", "place")


@query("match_correlated", f"""{_BOTH} SELECT a.id AS a, b.id AS b, count(*) AS n FROM vs a JOIN es r ON a.id = r.src JOIN vs b ON b.id = r.dst JOIN es s ON b.id = s.src JOIN vs z ON z.id = s.dst
 WHERE r.edge_type = 'CLICK' AND s.edge_type = 'VIEW' GROUP BY a.id, b.id""")
def match_correlated(spark, d):
    return ask(spark, d, "MATCH (a)-[r:CLICK]->(b) MATCH (b)-[s:VIEW]->(z) RETURN a.id, b.id, z.id", ["a", "b", "z"]).groupBy("a", "b").agg(F.count("*").alias("n"))


# ---- coverage, overlays

@query("interval_coverage", f"""{_ALL}, first AS (SELECT id, min(valid_from) AS f FROM av WHERE NOT tombstone GROUP BY id)
 SELECT e.id, e.version, coalesce(s.f <= e.valid_from AND t.f <= e.valid_from, FALSE) AS covered FROM ae e LEFT JOIN first s ON s.id = e.src LEFT JOIN first t ON t.id = e.dst WHERE NOT e.tombstone""")
def interval_coverage(spark, d):
    g = tables.activity(spark, d)
    puts = g.edges.where(~F.col("tombstone")).select("id", "version", "src", "dst", "valid_from", "valid_to")
    return temporal.covered(puts, g.vertices.where(~F.col("tombstone"))).select("id", "version", "covered")


@query("overlay_ryow", f"""{_BOTH}, st AS (SELECT id, event_type = 'signup' AS gone, value + 1000 AS value FROM vs WHERE event_type IN ('signup', 'view') UNION ALL SELECT 999999, FALSE, 1.5)
 SELECT id, value FROM vs WHERE id NOT IN (SELECT id FROM st) UNION ALL SELECT id, value FROM st WHERE NOT gone""")
def overlay_ryow(spark, d):
    v, t = tables.probe(spark, d)
    base = temporal.visible(tables.activity(spark, d).vertices, v, t, ["value", "event_type"])
    gone = F.col("event_type") == "signup"
    staged = base.where(F.col("event_type").isin("signup", "view")).select("id", (F.col("value") + 1000).alias("value"), F.lit(0).alias("valid_from"), F.lit((1 << 62)).alias("valid_to"), gone.alias("tombstone"), F.col("id").alias("ordinal"))
    new = spark.createDataFrame([(999999, 1.5, 0, 1 << 62, False, 999999)], "id bigint, value double, valid_from bigint, valid_to bigint, tombstone boolean, ordinal bigint")
    return temporal.overlay(base.select("id", "value"), staged.unionByName(new), v)


@query("csr_overlay_latest", f"""{_ALL}, m AS (SELECT id, src, dst, tx_time, version, tombstone FROM ae WHERE tx_time > 500 OR NOT tombstone) SELECT id, src, dst, tx_time, version FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tx_time DESC, version DESC, tombstone DESC) AS rn FROM m) WHERE rn = 1 AND NOT tombstone""")
def csr_overlay_latest(spark, d):
    e = tables.activity(spark, d).edges
    keep = ["id", "src", "dst", "tx_time", "version"]
    base = e.where((F.col("tx_time") <= 500) & ~F.col("tombstone"))
    latest = base.groupBy("id").agg(F.max_by(F.struct(*keep[1:]), F.struct("tx_time", "version")).alias("w")).select("id", *[f"w.{c}" for c in keep[1:]])
    return temporal.fresh_adjacency(latest, e.where(F.col("tx_time") > 500).select(*keep, "tombstone"))


# ---- aggregates, order, sets

@query("count_all", f"{_BOTH} SELECT count(*) AS n FROM vs")
def count_all(spark, d):
    return ask(spark, d, "MATCH (n) RETURN COUNT(*)", ["n"])


def _grouped(spark, d, groups, calls) -> DataFrame:
    s, _ = activity(spark, d)
    return s.plan(ir.Aggregate(ir.RelationshipScan("r"), groups, calls), snapshot=_at(spark, d))


@query("count_by_key", f"{_BOTH} SELECT edge_type, count(*) AS n FROM es GROUP BY edge_type")
def count_by_key(spark, d):
    return _grouped(spark, d, items((prop("r", "edge_type"), "edge_type")), (ir.AggregateCall("count", None, "n"),))


@query("agg_multi", f"""{_BOTH} SELECT edge_type, dst, count(value) AS n, count(DISTINCT src) AS u, CAST(sum(src) AS BIGINT) AS s, CAST(sum(DISTINCT src) AS BIGINT) AS sd, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM es GROUP BY edge_type, dst""")
def agg_multi(spark, d):
    c = ir.AggregateCall
    calls = (c("count", prop("r", "value"), "n"), c("count", prop("r", "src"), "u", True), c("sum", prop("r", "src"), "s"), c("sum", prop("r", "src"), "sd", True), c("avg", prop("r", "value"), "a"), c("min", prop("r", "value"), "lo"), c("max", prop("r", "value"), "hi"))
    return _grouped(spark, d, items((prop("r", "edge_type"), "edge_type"), (prop("r", "dst"), "dst")), calls).withColumn("a", F.round("a", 6))


@query("agg_collect", f"{_BOTH} SELECT edge_type, array_to_string(list_sort(list(dst)), ',') AS all_dst, array_to_string(list_sort(list(DISTINCT dst)), ',') AS kinds FROM es GROUP BY edge_type")
def agg_collect(spark, d):
    c = ir.AggregateCall
    out = _grouped(spark, d, items((prop("r", "edge_type"), "edge_type")), (c("collect", prop("r", "dst"), "l"), c("collect", prop("r", "dst"), "k", True)))
    return out.select("edge_type", F.array_join(F.col("l").cast("array<string>"), ",").alias("all_dst"), F.array_join(F.col("k").cast("array<string>"), ",").alias("kinds"))


_NULLED = "SELECT id, nullif(event_type, 'view') AS t, value FROM vs"


def _nulled(spark, d) -> tuple[GraphSession, Snapshot]:
    g = tables.activity(spark, d)
    g = replace(g, vertices=g.vertices.withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view"))))
    return GraphSession(spark, g), _at(spark, d)


@query("sort_multi_nulls", f"{_BOTH} SELECT id, t, value FROM ({_NULLED}) ORDER BY t DESC NULLS LAST, value ASC NULLS FIRST, id LIMIT 60")
def sort_multi_nulls(spark, d):
    s, at = _nulled(spark, d)
    keys = ((prop("n", "event_type"), True), (prop("n", "value"), False))
    return s.plan(ir.Limit(ir.Project(ir.Sort(ir.NodeScan("n"), keys), items((prop("n", "id"), "id"), (prop("n", "event_type"), "t"), (prop("n", "value"), "value"))), 0, 60), snapshot=at)


@query("skip_limit", f"{_BOTH} SELECT id, value FROM vs ORDER BY value DESC, id LIMIT 25 OFFSET 10")
def skip_limit(spark, d):
    s, _ = activity(spark, d)
    return s.plan(ir.Limit(ir.Project(ir.Sort(ir.NodeScan("n"), ((prop("n", "value"), True), (prop("n", "id"), False))), items((prop("n", "id"), "id"), (prop("n", "value"), "value"))), 10, 25), snapshot=_at(spark, d))


@query("top_k", f"{_BOTH} SELECT id, value FROM es ORDER BY value DESC, id LIMIT 15")
def top_k(spark, d):
    s, _ = activity(spark, d)
    return s.plan(ir.Limit(ir.Project(ir.Sort(ir.RelationshipScan("r"), ((prop("r", "value"), True), (prop("r", "id"), False))), items((prop("r", "id"), "id"), (prop("r", "value"), "value"))), 0, 15), snapshot=_at(spark, d))


@query("unwind_list", f"{_BOTH} SELECT id, unnest([id, 2, 3]) AS x FROM vs")
def unwind_list(spark, d):
    s, _ = activity(spark, d)
    plan = ir.Unwind(ir.NodeScan("n"), ir.ListOf((prop("n", "id"), ir.Literal(2), ir.Literal(3))), "x")
    return s.plan(ir.Project(plan, items((prop("n", "id"), "id"), (var("x"), "x"))), snapshot=_at(spark, d))


@query("merge_dedupe", "SELECT DISTINCT id, src, dst FROM (SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS id, user_id + 1 AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS dst FROM events)")
def merge_dedupe(spark, d):
    e = tables.activity(spark, d).edges.select("id", "src", "dst")
    return relational.merge([e.where("src % 2 = 0"), e, e.where("dst % 3 = 0")], "id", deduplicate=True)


@query("merge_all", "SELECT k, x FROM (SELECT n_regionkey AS k, n_name AS x FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT nullif(n_regionkey, 1), n_name FROM nation)")
def merge_all(spark, d):
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    k = lambda df, c, x: df.select(F.col(c).alias("k"), F.col(x).alias("x"))
    return relational.merge([k(n, "n_regionkey", "n_name"), k(r, "r_regionkey", "r_name"), k(n.withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(1))), "n_regionkey", "n_name")], "k")


@query("set_operations", f"{_BOTH} SELECT id FROM vs EXCEPT SELECT dst FROM es UNION ALL (SELECT src FROM es INTERSECT SELECT id FROM vs)")
def set_operations(spark, d):
    v, t = tables.probe(spark, d)
    g = tables.activity(spark, d)
    vs, es = temporal.visible(g.vertices, v, t, []).select("id"), temporal.visible(g.edges, v, t, ["src", "dst"])
    return vs.exceptAll(es.select("dst").distinct()).unionAll(es.select("src").intersect(vs))


# ---- writes

@query("conflict_check", f"""{_ALL}, m AS (SELECT id, version, valid_from, valid_to, tombstone FROM av WHERE tx_time > {_TX})
 SELECT id, version FROM m WHERE EXISTS (SELECT 1 FROM av c WHERE c.tx_time > {_TX} // 2 AND c.tx_time <= {_TX} AND c.id = m.id AND (m.tombstone OR c.tombstone OR (m.valid_from < c.valid_to AND c.valid_from < m.valid_to)))""")
def conflict_check(spark, d):
    """All versions after the probe transaction, staged against what came between half of it and it."""
    v, t = tables.activity(spark, d).vertices, tables.probe(spark, d)[1]
    m = v.where(F.col("tx_time") > t).select("id", "version", "valid_from", "valid_to", "tombstone")
    return write.conflicts(m, v.where(F.col("tx_time") <= t), t // 2).select("id", "version")


_STAGED = f"""sv AS (SELECT id, tx_time // 2 AS version, valid_from, valid_to, tombstone FROM av WHERE tx_time > {_TX}), se AS (SELECT id, tx_time // 2 AS version, valid_from, valid_to, tombstone, src, dst, edge_type FROM ae WHERE tx_time > {_TX}),
 dv AS (SELECT id, max(tx_time) AS dead FROM av WHERE tx_time <= {_TX} AND tombstone GROUP BY id), lv AS (SELECT a.* FROM av a LEFT JOIN dv USING (id) WHERE tx_time <= {_TX} AND NOT tombstone AND (dead IS NULL OR tx_time >= dead)),
 de AS (SELECT id, max(tx_time) AS dead FROM ae WHERE tx_time <= {_TX} AND tombstone GROUP BY id), le AS (SELECT a.* FROM ae a LEFT JOIN de USING (id) WHERE tx_time <= {_TX} AND NOT tombstone AND (dead IS NULL OR tx_time >= dead))"""


def _identity_faults(kind: str, staged: str, live: str) -> str:
    return f"""SELECT '{kind}' AS entity, id, 'PUT-AND-DELETE' AS fault FROM {staged} GROUP BY id HAVING bool_or(tombstone) AND bool_or(NOT tombstone)
 UNION SELECT '{kind}', id, 'DUPLICATE-VERSION' FROM {staged} GROUP BY id, version HAVING count(*) > 1 UNION SELECT '{kind}', s.id, 'DUPLICATE-VERSION' FROM {staged} s JOIN {live} l ON l.id = s.id AND l.version = s.version WHERE NOT s.tombstone
 UNION SELECT '{kind}', a.id, 'OVERLAPPING-VERSIONS' FROM {staged} a JOIN {staged} b ON a.id = b.id AND a.version < b.version AND NOT a.tombstone AND NOT b.tombstone AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to"""


#: Vertices of this graph stay valid once they are, so what is left of an end covers an edge from its first instant on.
_COVER = """gone AS (SELECT DISTINCT id FROM sv WHERE tombstone), k AS (SELECT id, min(valid_from) AS f FROM (SELECT id, valid_from FROM lv WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, valid_from FROM sv WHERE NOT tombstone) GROUP BY id),
 checked AS (SELECT id, src, dst, valid_from FROM se WHERE NOT tombstone UNION ALL SELECT id, src, dst, valid_from FROM le WHERE id NOT IN (SELECT id FROM se WHERE tombstone) AND (src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)))"""


@query("overlay_validation", f"""{_ALL}, {_STAGED}, {_COVER} {_identity_faults('vertex', 'sv', 'lv')} UNION {_identity_faults('edge', 'se', 'le')}
 UNION SELECT 'edge', id, 'ENDPOINTS' FROM (SELECT id, src, dst, edge_type FROM se WHERE NOT tombstone UNION ALL SELECT id, src, dst, edge_type FROM le WHERE id IN (SELECT id FROM se WHERE NOT tombstone)) GROUP BY id HAVING count(DISTINCT (src, dst, edge_type)) > 1
 UNION SELECT 'edge', c.id, 'COVERAGE' FROM checked c LEFT JOIN k a ON a.id = c.src LEFT JOIN k b ON b.id = c.dst WHERE NOT coalesce(a.f <= c.valid_from AND b.f <= c.valid_from, FALSE)""")
def overlay_validation(spark, d):
    """All that speaks against committing what came after the probe transaction as one batch."""
    g, t = tables.activity(spark, d), tables.probe(spark, d)[1]
    until = lambda df: df.where(F.col("tx_time") <= t)
    staged = lambda df, *more: df.where(F.col("tx_time") > t).select("id", F.expr("tx_time div 2").alias("version"), "valid_from", "valid_to", "tombstone", *more)
    base = Graph(until(g.vertices), until(g.edges), g.vertex_properties, g.edge_properties)
    return write.faults({"vertex": staged(g.vertices), "edge": staged(g.edges, "src", "dst", "edge_type")}, base).distinct()


def _writer(spark, name: str, vertex: list[PropertySpec], edge: list[PropertySpec]) -> GraphWriter:
    return GraphWriter(spark, scratch(spark, name), vertex, edge)


@query("change_feed", f"""{_ALL}, l AS (SELECT 1 AS log_index, row_number() OVER (ORDER BY id, version) - 1 AS ordinal, id, version, tombstone FROM av WHERE tx_time <= {_TX} // 2 AND NOT tombstone
 UNION ALL SELECT 2, row_number() OVER (ORDER BY id, version) - 1, id, version, tombstone FROM av WHERE tx_time > {_TX} // 2 AND tx_time <= {_TX})
 SELECT CAST(log_index AS BIGINT) AS log_index, ordinal, 'vertex' AS entity, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS change_kind, id, version FROM l""")
def change_feed(spark, d):
    """The users' log through a store: loaded in two parts with a compaction after each, then read from the feed as it came."""
    g, t = tables.activity(spark, d), tables.probe(spark, d)[1]
    w = _writer(spark, "feed-store", g.vertex_properties, [])
    feed, out, checkpoint = ChangeFeed(w), scratch(spark, "feed"), scratch(spark, "feed-checkpoint")

    def follow() -> None:
        feed.start(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/part={n}"), checkpoint).awaitTermination()

    for rows in (g.vertices.where((F.col("tx_time") <= t // 2) & ~F.col("tombstone")), g.vertices.where((F.col("tx_time") > t // 2) & (F.col("tx_time") <= t))):
        w.load("vertex", rows)
        w.compact()
        follow()
    return spark.read.parquet(out).select("log_index", "ordinal", "entity", "change_kind", "id", "version")


@query("ingest_idempotent", """WITH i AS (SELECT event_id AS item, user_id, event_type FROM events), b1 AS (SELECT item, 'a' AS x, 1 AS b FROM i WHERE item % 5 = 0), b2 AS (SELECT item, CASE WHEN item % 15 = 0 THEN 'z' ELSE 'a' END AS x, 2 AS b FROM i WHERE event_type <> 'error'),
 r AS (SELECT b.item, b.x, b.b, coalesce(o.x, b.x) = b.x AS ok FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) b LEFT JOIN b1 o ON o.item = b.item AND b.b = 2)
 SELECT item, CAST(b AS BIGINT) AS batch, CASE WHEN ok THEN 'COMMITTED' ELSE 'REJECTED' END AS status, (SELECT count(*) FROM (SELECT item FROM b1 UNION SELECT item FROM b2)) AS vertices FROM r""")
def ingest_idempotent(spark, d):
    """Two batches with keys in common, some with other content, each sent twice: receipts, and what the store holds."""
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("id"), F.col("event_id").cast("string").alias("item_key"), F.lit(0).cast("bigint").alias("valid_from"), F.lit("a").alias("name"), "event_type")
    w = _writer(spark, "ingest-store", [PropertySpec("name", "string")], [])
    ingest = Ingest(w, scratch(spark, "receipts"))
    one = e.where("event_type is not null and cast(item_key as bigint) % 5 = 0")
    two = e.where("event_type <> 'error'").withColumn("name", F.expr("case when cast(item_key as bigint) % 15 = 0 then 'z' else 'a' end"))
    for batch in (1, 1, 2, 2):
        ingest.batch((one if batch == 1 else two).drop("event_type"), batch)
    n = w.graph().vertices.count()
    return ingest.receipts().select(F.col("item_key").cast("bigint").alias("item"), F.col("batch_id").alias("batch"), "status", F.lit(n).alias("vertices"))


@query("write_statements", """SELECT CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END AS value, CAST(NULL AS VARCHAR) AS other FROM nation WHERE n_nationkey <> 4
 UNION ALL SELECT 'new', 77, NULL UNION ALL SELECT 'NATION_5', 2020, 'NATION_6'""")
def write_statements(spark, d):
    """CREATE of a vertex and an edge, SET and DELETE over a store of the nations, in and out of a transaction."""
    n = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.lit(0).alias("valid_from"), F.lit(OPEN).alias("valid_to"), F.array(F.lit("Nation")).alias("labels"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    w = _writer(spark, "nations", [PropertySpec("name", "string"), PropertySpec("value", "integer")], [PropertySpec("since", "integer")])
    w.load("vertex", n)
    s = GraphSession(spark).attach_writer(w)
    s.query("CREATE (n:Nation {name: 'new', value: 77}) VALID FROM 5")
    s.query("MATCH (n {name: 'NATION_3'}) SET n.name = 'renamed', n.value = 9 VALID FROM 6")
    s.query("BEGIN")
    s.query("MATCH (n {name: 'NATION_4'}) DELETE n VALID FROM 8")
    s.query("MATCH (a {name: 'NATION_5'}) MATCH (b {name: 'NATION_6'}) CREATE (a)-[r:NEAR {since: $y}]->(b) VALID FROM 7", {"y": 2020})
    s.query("COMMIT")
    s.query("BEGIN")
    s.query("MATCH (n {name: 'NATION_7'}) DELETE n VALID FROM 8")
    s.query("ROLLBACK")
    nodes = s.query("MATCH (n:Nation) RETURN n.name, n.value").toDF("name", "value").withColumn("other", F.lit(None).cast("string"))
    return nodes.unionByName(s.query("MATCH (a)-[r:NEAR]->(b) RETURN a.name, r.since, b.name").toDF("name", "value", "other"))


@query("store_pinned_read", f"{_ALL} SELECT id, version, tombstone, value FROM av WHERE tx_time <= {_TX} // 2")
def store_pinned_read(spark, d):
    """The users' log in two loads; a read that was begun between them, after both, a compaction and a vacuum."""
    g, t = tables.activity(spark, d), tables.probe(spark, d)[1]
    p = Provider(spark, scratch(spark, "pinned-store"), g.vertex_properties, [])
    p.writer.load("vertex", g.vertices.where(F.col("tx_time") <= t // 2))
    r = p.begin_read()
    p.writer.load("vertex", g.vertices.where((F.col("tx_time") > t // 2) & (F.col("tx_time") <= t)))
    p.writer.compact()
    p.writer.vacuum(through=p.writer.manifest()["number"], grace=0)
    return p.read(r, "vertex").select("id", "version", "tombstone", "value")


@query("snapshot_restore", f"{_BOTH} SELECT id, src, dst, edge_type, value FROM es")
def snapshot_restore(spark, d):
    """The log up to the probe transaction as a snapshot, imported into a new store, whose edges are read at the probe instant."""
    g, (v, t), at = tables.activity(spark, d), tables.probe(spark, d), scratch(spark, "snapshot")
    export_snapshot(g, at, t)
    p = Provider(spark, scratch(spark, "origin"), g.vertex_properties, g.edge_properties).import_snapshot(at, scratch(spark, "restored"))
    return p.read(p.begin_read(), "edge", v, OPEN).select("id", "src", "dst", "edge_type", "value")


# ---- graph algorithms

def contacts(spark, d) -> A.Projection:
    return A.Projection(*tables.contacts(spark, d))


_UND = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM c WHERE src <> dst)"


@query("ga_degree", f"WITH {_CONTACTS} SELECT id AS vertex, round(coalesce(k, 0) / CAST((SELECT count(*) - 1 FROM n) AS DOUBLE), 10) AS score FROM n LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT src AS x FROM c UNION ALL SELECT dst FROM c) GROUP BY x) ON id = x")
def ga_degree(spark, d):
    return A.degree_centrality(contacts(spark, d)).withColumn("score", F.round("score", 10))


@query("job_result", SQL["ga_degree"])
def job_result(spark, d):
    """The degrees as a job: submitted twice under one id, run once, its result read."""
    jobs = Jobs(spark, scratch(spark, "jobs"))
    for _ in range(2):
        jobs.submit("degrees", "degree_centrality", contacts(spark, d))
    return jobs.result("degrees", 3600).select("vertex", F.round("score", 10).alias("score"))


@query("ga_triangles", f"WITH {_CONTACTS}, {_UND} SELECT count(*) AS count FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def ga_triangles(spark, d):
    return A.triangle_count(contacts(spark, d))


@query("ga_clustering", f"""WITH {_CONTACTS}, {_UND}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
 k AS (SELECT v, count(*) AS t FROM (SELECT p AS v FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY v), g AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM u UNION ALL SELECT b FROM u) GROUP BY v)
 SELECT id AS vertex, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 9) AS score FROM n LEFT JOIN g ON g.v = id LEFT JOIN k ON k.v = id""")
def ga_clustering(spark, d):
    return A.clustering_coefficient(contacts(spark, d)).withColumn("score", F.round("score", 9))


TIMED = dict(departure="departure", arrival="arrival", start=START, end=END)


@query("ga_temporal_motif", f"WITH {_CONTACTS} SELECT count(*) AS count FROM c x JOIN c y ON y.src = x.dst AND y.dep >= x.arr AND y.arr <= {END} WHERE x.dep >= {START} AND x.arr >= x.dep AND x.arr <= {END}")
def ga_temporal_motif(spark, d):
    return A.temporal_motif(contacts(spark, d), **TIMED)


@query("ga_change_point", f"WITH {_CONTACTS} SELECT row_number() OVER (ORDER BY dep, id) - 1 AS position, id AS edge_id FROM (SELECT *, lag(w) OVER (ORDER BY dep, id) AS p FROM c) WHERE abs(w - p) >= 60 AND w <> p")
def ga_change_point(spark, d):
    return A.change_point(contacts(spark, d), "event_time", "signal", 60.0)


_BFS = "b(v, h) AS (SELECT CAST({s} AS BIGINT), 0 UNION SELECT e.dst, h + 1 FROM b JOIN (SELECT DISTINCT src, dst FROM {t}) e ON e.src = b.v WHERE h < {m})"


@query("ga_bfs_depth", f"WITH RECURSIVE {_CONTACTS}, {_BFS.format(s=3, t='c', m=6)} SELECT v AS vertex, CAST(min(h) AS BIGINT) AS depth FROM b GROUP BY v")
def ga_bfs_depth(spark, d):
    return A.bfs(contacts(spark, d), 3, 6).select("vertex", "depth")


_RELAX = """d({k}v, x) USING KEY ({k}v) AS ({start} UNION SELECT {dk}e.dst, min(d.x + e.w) FROM d JOIN (SELECT src, dst, min(w) AS w FROM c GROUP BY src, dst) e ON e.src = d.v LEFT JOIN recurring.d AS o ON {ok}o.v = e.dst WHERE o.x IS NULL OR d.x + e.w < o.x GROUP BY {dk}e.dst)"""


@query("ga_sssp", f"WITH RECURSIVE {_CONTACTS}, {_RELAX.format(k='', dk='', ok='', start='SELECT CAST(3 AS BIGINT), CAST(0 AS DOUBLE)')} SELECT v AS vertex, round(x, 6) AS distance FROM d")
def ga_sssp(spark, d):
    return A.run("bounded_sssp", contacts(spark, d), source=3, weight="weight").withColumn("distance", F.round("distance", 6))


@query("ga_apsp", f"WITH RECURSIVE {_CONTACTS}, {_RELAX.format(k='r, ', dk='d.r, ', ok='o.r = d.r AND ', start='SELECT id, id, CAST(0 AS DOUBLE) FROM n')} SELECT r AS source, v AS target, round(x, 6) AS distance FROM d")
def ga_apsp(spark, d):
    g = contacts(spark, d)
    return A.bounded_apsp(g, "weight", max_pairs=g.vertices.count() ** 2).withColumn("distance", F.round("distance", 6))


_SHOP_EDGES = """x AS (SELECT n_nationkey + 2000000001 AS a, n_regionkey + 1000000001 AS b FROM nation UNION ALL SELECT c_custkey + 3000000001, c_nationkey + 2000000001 FROM customer UNION ALL SELECT s_suppkey + 4000000001, s_nationkey + 2000000001 FROM supplier
 UNION ALL SELECT o_custkey + 3000000001, o_orderkey + 6000000001 FROM orders UNION ALL SELECT DISTINCT l_orderkey + 6000000001, l_partkey + 5000000001 FROM lineitem), e AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
 n AS (SELECT r_regionkey + 1000000001 AS id FROM region UNION ALL SELECT n_nationkey + 2000000001 FROM nation UNION ALL SELECT c_custkey + 3000000001 FROM customer UNION ALL SELECT s_suppkey + 4000000001 FROM supplier UNION ALL SELECT p_partkey + 5000000001 FROM part UNION ALL SELECT o_orderkey + 6000000001 FROM orders)"""


@query("ga_wcc", f"WITH RECURSIVE {_SHOP_EDGES}, w(v, c) USING KEY (v) AS (SELECT id, id FROM n UNION SELECT e.b, min(w.c) FROM w JOIN e ON e.a = w.v JOIN recurring.w AS o ON o.v = e.b WHERE w.c < o.c GROUP BY e.b) SELECT v AS vertex, c AS component FROM w")
def ga_wcc(spark, d):
    g = tables.commerce(spark, d)
    return A.weakly_connected_components(A.Projection(g.vertices.select("id"), g.edges.select("id", "src", "dst"))).select("vertex", "component")


@query("ga_scc", f"WITH RECURSIVE {_CONTACTS}, {_PAIRS}, r(a, b) AS (SELECT id, id FROM n UNION SELECT a, dst FROM r JOIN e ON src = b) SELECT x.a AS vertex, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def ga_scc(spark, d):
    return A.strongly_connected_components(contacts(spark, d)).select("vertex", "component")


#: Hops and numbers of shortest paths of all pairs; parallel edges multiply paths.
_HOPS = """h(r, v, k, p) USING KEY (r, v) AS (SELECT id, id, CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM n UNION SELECT h.r, e.dst, h.k + 1, sum(h.p * e.k) FROM h JOIN e ON e.src = h.v LEFT JOIN recurring.h AS o ON o.r = h.r AND o.v = e.dst WHERE o.v IS NULL GROUP BY h.r, e.dst, h.k)"""


@query("ga_closeness", f"""WITH RECURSIVE {_CONTACTS}, {_PAIRS}, {_HOPS}, z AS (SELECT r, count(*) AS n, sum(k) AS t FROM h WHERE r <> v GROUP BY r)
 SELECT id AS vertex, round(CASE WHEN t IS NULL THEN 0.0 ELSE z.n * z.n / (CAST((SELECT count(*) - 1 FROM n) AS DOUBLE) * t) END, 9) AS score FROM n LEFT JOIN z ON r = id""")
def ga_closeness(spark, d):
    return A.closeness_centrality(contacts(spark, d)).withColumn("score", F.round("score", 9))


@query("ga_betweenness", f"""WITH RECURSIVE {_CONTACTS}, {_PAIRS}, {_HOPS}, b AS (SELECT a.v, sum(a.p * b.p / t.p) AS s FROM h a JOIN h b ON b.r = a.v JOIN h t ON t.r = a.r AND t.v = b.v WHERE a.r <> a.v AND b.v <> b.r AND a.k + b.k = t.k GROUP BY a.v)
 SELECT id AS vertex, round(coalesce(s, 0.0), 4) AS score FROM n LEFT JOIN b ON v = id""")
def ga_betweenness(spark, d):
    return A.betweenness_centrality(contacts(spark, d)).withColumn("score", F.round("score", 4))


_ARRIVE = f"ok AS (SELECT * FROM c WHERE dep >= {START} AND arr >= dep AND arr <= {END}), a(v, t) AS (SELECT CAST(3 AS BIGINT), CAST({START} AS BIGINT) UNION SELECT ok.dst, ok.arr FROM a JOIN ok ON ok.src = a.v AND ok.dep >= a.t)"


@query("ga_earliest_arrival", f"WITH RECURSIVE {_CONTACTS}, {_ARRIVE} SELECT v AS vertex, min(t) AS arrival_time FROM a GROUP BY v")
def ga_earliest_arrival(spark, d):
    return A.arrival_times(contacts(spark, d), 3, **TIMED)


@query("ga_temporal_reach", f"WITH RECURSIVE {_CONTACTS}, {_ARRIVE} SELECT DISTINCT v AS vertex FROM a")
def ga_temporal_reach(spark, d):
    return A.temporal_reachability(contacts(spark, d), 3, **TIMED)


@query("ga_latest_departure", f"WITH RECURSIVE {_CONTACTS}, ok AS (SELECT * FROM c WHERE dep >= {START} AND arr >= dep AND arr <= {END}), a(v, t) AS (SELECT CAST(3 AS BIGINT), CAST({END} AS BIGINT) UNION SELECT ok.src, ok.dep FROM a JOIN ok ON ok.dst = a.v AND ok.arr <= a.t) SELECT v AS vertex, max(t) AS departure_time FROM a GROUP BY v")
def ga_latest_departure(spark, d):
    return A.departure_times(contacts(spark, d), 3, **TIMED)


def _rank_sql(rounds: int) -> str:
    parts = [f"WITH {_CONTACTS}, o AS (SELECT src, count(*) AS k FROM c GROUP BY src), q AS (SELECT count(*) AS q FROM n), p0 AS (SELECT id, 1.0 / q AS r FROM n, q)"]
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS (SELECT n.id, 0.15 / q + 0.85 * (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT src FROM o)) / q + 0.85 * coalesce(g, 0) AS r FROM n CROSS JOIN q LEFT JOIN (SELECT c.dst, sum(p.r / o.k) AS g FROM c JOIN p{i - 1} p ON p.id = c.src JOIN o ON o.src = c.src GROUP BY c.dst) x ON x.dst = n.id)")
    return ", ".join(parts) + f" SELECT id AS vertex, round(r / (SELECT sum(r) FROM p{rounds}), 9) AS score FROM p{rounds}"


@query("ga_pagerank", _rank_sql(6))
def ga_pagerank(spark, d):
    return A.page_rank(contacts(spark, d), 6).withColumn("score", F.round("score", 9))


def _core_sql(rounds: int) -> str:
    """Core numbers: h-indices of the neighbours' values, from the degrees down."""
    parts = [f"WITH {_CONTACTS}, {_UND}, w AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), k0 AS (SELECT id, count(b) AS k FROM n LEFT JOIN w ON a = id GROUP BY id)"]
    for i in range(1, rounds + 1):
        parts.append(f"k{i} AS MATERIALIZED (SELECT k.id, least(k.k, coalesce(max(least(x.k, x.i)), 0)) AS k FROM k{i - 1} k LEFT JOIN (SELECT w.a, y.k, row_number() OVER (PARTITION BY w.a ORDER BY y.k DESC) AS i FROM w JOIN k{i - 1} y ON y.id = w.b) x ON x.a = k.id GROUP BY k.id, k.k)")
    return ", ".join(parts) + f" SELECT id AS vertex, CAST(k AS INTEGER) AS core FROM k{rounds}"


@query("ga_kcore", _core_sql(24))
def ga_kcore(spark, d):
    return A.k_core(contacts(spark, d))


def _label_sql(rounds: int) -> str:
    parts = [f"WITH {_CONTACTS}, {_UND}, w AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), l0 AS (SELECT id, id AS l FROM n)"]
    for i in range(1, rounds + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT p.id, coalesce(x.l, p.l) AS l FROM l{i - 1} p LEFT JOIN (SELECT a, l FROM (SELECT w.a, q.l, row_number() OVER (PARTITION BY w.a ORDER BY count(*) DESC, q.l) AS i FROM w JOIN l{i - 1} q ON q.id = w.b GROUP BY w.a, q.l) WHERE i = 1) x ON x.a = p.id)")
    return ", ".join(parts) + f" SELECT id AS vertex, dense_rank() OVER (ORDER BY l) AS community FROM l{rounds}"


@query("ga_lpa", _label_sql(6))
def ga_lpa(spark, d):
    return A.label_propagation(contacts(spark, d), 6)


@query("ga_louvain")
def ga_louvain(spark, d):
    return A.louvain(contacts(spark, d), 6)


@query("ga_dfs")
def ga_dfs(spark, d):
    return A.dfs(contacts(spark, d), 3, 6)


def _reached(spark, d) -> int:
    """The vertex of latest arrival from vertex 3, whose path is worth seeing."""
    r = A.arrival_times(contacts(spark, d), 3, **TIMED).orderBy(F.desc("arrival_time"), "vertex").first()
    return r["vertex"]


@query("ga_earliest_path")
def ga_earliest_path(spark, d):
    return A.earliest_arrival(contacts(spark, d), 3, _reached(spark, d), **TIMED)


@query("ga_latest_path")
def ga_latest_path(spark, d):
    return A.latest_departure(contacts(spark, d), 3, _reached(spark, d), **TIMED)
