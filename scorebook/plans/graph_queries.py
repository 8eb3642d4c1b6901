"""Queries over typed relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import records as rec
from ..sources import carriers as c


def _start(spark, d, condition: str):
    """Orders that a traversal starts at."""
    return c.table(spark, d, "orders").where(condition).select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"))


def graph_outgoing(spark, d):
    return graph.outgoing(c.edges(spark, d), _start(spark, d, "o_orderstatus = 'F'"), ["uses"])


def graph_incoming(spark, d):
    nodes = c.table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.incoming(c.edges(spark, d), nodes)


def graph_bfs(spark, d):
    return graph.traverse(c.edges(spark, d, repeats=True), _start(spark, d, "o_orderpriority = '1-URGENT'"), 5)


def graph_bfs_in(spark, d):
    nodes = c.table(spark, d, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.traverse(c.edges(spark, d, repeats=True), nodes, 2, "in")


def graph_bfs_both(spark, d):
    nodes = c.table(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.traverse(c.edges(spark, d, repeats=True), nodes, 2, "both", ["in"])


def graph_follow_latest(spark, d):
    """Each version with the latest live version of its record, where there is one."""
    v = c.versions(spark, d)
    return v.select("version_id", "record_id").join(rec.latest(v).select("record_id", F.col("version_id").alias("latest_id")), "record_id", "left")


def _bfs_sql(start: str, hops: str, depth: int) -> str:
    return f"with recursive hops as ({hops}), walk(node, distance) as (select node, 0 from ({start}) union select h.next, w.distance + 1 from walk w join hops h on h.node = w.node where w.distance < {depth}) select node, min(distance) as distance from walk group by 1"


OUT = "select from_id as node, to_id as next from edges"
IN = "select to_id as node, from_id as next from edges"
SQL = {
    "graph_outgoing": "select from_id, type, to_id from edges where type = 'uses' and from_id in (select 'o:' || o_orderkey from orders where o_orderstatus = 'F')",
    "graph_incoming": "select distinct from_id, type, to_id from edges where to_id in (select 'p:' || p_partkey from part where p_brand = 'Brand#7')",
    "graph_follow_latest": "select v.version_id, v.record_id, l.version_id as latest_id from versions v left join lateral (select w.version_id from versions w where w.record_id = v.record_id and not w.tombstoned order by w.seq desc limit 1) l on true",
}
BFS = {
    "graph_bfs": _bfs_sql("select 'o:' || o_orderkey as node from orders where o_orderpriority = '1-URGENT'", OUT, 5),
    "graph_bfs_in": _bfs_sql("select 'n:' || n_nationkey as node from nation where n_regionkey = 0", IN, 2),
    "graph_bfs_both": _bfs_sql("select 'r:' || r_regionkey as node from region", f"{OUT} where type = 'in' union all {IN} where type = 'in'", 2),
}

QUERIES = {name: globals()[name] for name in [*SQL, *BFS]}
ORACLES = {name: c.sql(text) for name, text in SQL.items()} | {name: text.replace("with recursive", f"with recursive edges as ({c.SQL['edges']}),", 1) for name, text in BFS.items()}
