"""Edits of the graph as change plans (W1-W14) and their effect on the tables.

A plan has one row for each edge that a request names: (request_id, edge_key, from, predicate, to, root, data, action). Nothing is written until
``apply_edges`` or ``apply_links`` gives the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import edge_key, handle_collection, merged, same_map
from glossaria.operators.walk import LEVELS, arrows
from glossaria.plans.cut import cut
from glossaria.plans.dictionary import Dictionary

_NO_DATA = "map<string,string>"


def children(requests: DataFrame, many_to_one: bool = True) -> DataFrame:
    """Requests (request_id, root, parent, predicate, child, data) as edges (request_id, root, edge_key, from, predicate, to, data)."""
    from_, to = (F.col("child"), F.col("parent")) if many_to_one else (F.col("parent"), F.col("child"))
    named = requests.withColumn("from", from_).withColumn("to", to)
    keyed = named.withColumn("edge_key", edge_key(F.col("from"), F.col("predicate"), F.col("to")))
    return keyed.select("request_id", *(c for c in ("root",) if c in requests.columns), "edge_key", "from", "predicate", "to", F.col("data").cast(_NO_DATA).alias("data"))


def containers(requests: DataFrame, container: str = model.SECTION_OF) -> DataFrame:
    """The same requests with a container predicate."""
    return requests.withColumn("predicate", F.lit(container))


def bridges(requests: DataFrame, bridge: str = model.BRIDGE_OF) -> DataFrame:
    """Requests (request_id, root, bridged, data): the bridged root becomes a child of the root."""
    return requests.select("request_id", "root", F.col("root").alias("parent"), F.lit(bridge).alias("predicate"), F.col("bridged").alias("child"), "data")


def orphans(d: Dictionary, requests: DataFrame) -> DataFrame:
    """(request_id, handle) of all handles in requests that have no term."""
    names = [c for c in ("root", "parent", "child") if c in requests.columns]
    handles = requests.select("request_id", F.explode(F.array(*names)).alias("handle")).distinct()
    known = d.terms.select(F.concat(F.lit("terms/"), "_key").alias("handle"))
    return handles.join(known, "handle", "left_anti").select("request_id", "handle")


def not_descriptors(d: Dictionary, requests: DataFrame) -> DataFrame:
    """(request_id, handle, reason): handles that are no terms, or terms that are no descriptors."""
    handles = requests.select("request_id", F.explode(F.array("parent", "child")).alias("handle")).distinct()
    known = d.terms.select(F.concat(F.lit("terms/"), "_key").alias("handle"), F.col("_data").isNotNull().alias("descriptor"))
    out = handles.join(known, "handle", "left")
    reason = F.when((handle_collection(F.col("handle")) != "terms") | F.col("descriptor").isNull(), "not a term").when(~F.col("descriptor"), "not a descriptor")
    return out.withColumn("reason", reason).where("reason is not null").select("request_id", "handle", "reason")


def _payload(old: Column, new: Column) -> Column:
    """Null resets, an object merges."""
    return F.when(new.isNull(), F.create_map().cast(_NO_DATA)).otherwise(merged(old, new))


def plan_set_edges(d: Dictionary, requests: DataFrame) -> DataFrame:
    """Inserted, updated or existing. ``requests`` as from ``children``."""
    old = d.edges.select("edge_key", F.col("roots").alias("_roots"), F.col("data").alias("_old"))
    rows = requests.join(old, "edge_key", "left")
    data = F.when(F.col("_roots").isNull(), F.coalesce("data", F.create_map().cast(_NO_DATA))).otherwise(_payload(F.col("_old"), F.col("data")))
    fresh, added = F.col("_roots").isNull(), ~F.array_contains("_roots", F.col("root"))
    rows = rows.withColumn("new_data", data)
    action = F.when(fresh, "inserted").when(added | ~same_map(F.col("_old"), F.col("new_data")), "updated").otherwise("existing")
    return rows.select("request_id", "edge_key", "from", "predicate", "to", "root", F.col("new_data").alias("data"), action.alias("action"), F.lit(False).alias("takes"))


def plan_set_links(d: Dictionary, requests: DataFrame) -> DataFrame:
    """As for edges, without roots."""
    rows = requests.join(d.links.select("edge_key", F.col("data").alias("_old"), F.lit(True).alias("_hit")), "edge_key", "left")
    data = F.when(F.col("_hit").isNull(), F.coalesce("data", F.create_map().cast(_NO_DATA))).otherwise(_payload(F.col("_old"), F.col("data")))
    rows = rows.withColumn("new_data", data)
    action = F.when(F.col("_hit").isNull(), "inserted").when(~same_map(F.col("_old"), F.col("new_data")), "updated").otherwise("existing")
    return rows.select("request_id", "edge_key", "from", "predicate", "to", F.col("new_data").alias("data"), action.alias("action"))


def plan_delete_edges(d: Dictionary, requests: DataFrame, prune: bool = False, sections: tuple[str, ...] = (), many_to_one: bool = True, levels: int = LEVELS) -> DataFrame:
    """Deleted, updated or ignored; with ``prune``, also for all edges of the root below each child, each once."""
    rows = requests.select("request_id", "root", "edge_key", "from", "predicate", "to", "data")
    if prune:
        steps = arrows(d, many_to_one)
        end = "from" if many_to_one else "to"
        known = rows.join(d.edge_path.select("root", "edge_key"), ["root", "edge_key"], "left_semi")
        frontier = cut(known.select("request_id", "root", F.col("predicate").alias("functional"), F.col(end).alias("node")).distinct())
        seen = frontier
        below = None
        for _ in range(levels):
            ahead = cut(frontier.join(steps, ["root", "node"]))
            if ahead.isEmpty():
                break
            hits = ahead.where((F.col("predicate") == F.col("functional")) | F.col("predicate").isin(*sections)).select("request_id", "root", "edge_key")
            below = hits if below is None else below.unionByName(hits)
            frontier = cut(ahead.select("request_id", "root", "functional", F.col("next").alias("node")).distinct().join(seen, ["request_id", "root", "functional", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
        if below is not None:
            more = below.distinct().join(rows.select("request_id", "root", "edge_key"), ["request_id", "root", "edge_key"], "left_anti")
            more = more.join(d.edges.select("edge_key", "from", "predicate", "to"), "edge_key").withColumn("data", F.create_map().cast(_NO_DATA))
            rows = rows.unionByName(more)
    found = rows.join(d.edges.select("edge_key", F.col("roots").alias("_roots"), F.col("data").alias("_old")), "edge_key", "left")
    member = F.coalesce(F.array_contains("_roots", F.col("root")), F.lit(False))
    action = F.when(~member, "ignored").when(F.size("_roots") == 1, "deleted").otherwise("updated")
    data = F.when(member, _payload(F.col("_old"), F.col("data")))
    return found.select("request_id", "edge_key", "from", "predicate", "to", "root", data.alias("data"), action.alias("action"), F.lit(True).alias("takes"))


def plan_delete_links(d: Dictionary, requests: DataFrame) -> DataFrame:
    """Deleted or ignored."""
    rows = requests.join(d.links.select("edge_key", F.lit(True).alias("_hit")), "edge_key", "left")
    return rows.select("request_id", "edge_key", "from", "predicate", "to", F.when(F.col("_hit"), "deleted").otherwise("ignored").alias("action"))


def counters(plan: DataFrame) -> DataFrame:
    """Rows by request and action."""
    return plan.groupBy("request_id", "action").agg(F.count("*").alias("n"))


def apply_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """The edges after a plan of sets, of deletes or of both; rows that only exist or are ignored change nothing.

    ``takes`` says that a row takes its root away, else it adds it; a root both added and taken away is gone. An edge
    without roots is dropped.
    """
    none = F.array().cast("array<string>")
    work = plan.where(F.col("action").isin("inserted", "updated", "deleted"))
    kind = work.groupBy("edge_key", "from", "predicate", "to").agg(
        F.collect_set(F.when(~F.col("takes"), F.col("root"))).alias("added"),
        F.collect_set(F.when(F.col("takes"), F.col("root"))).alias("taken"),
        F.max_by("data", "request_id").alias("new_data"),
    )
    both = edges.withColumnRenamed("data", "_data").join(kind, ["edge_key", "from", "predicate", "to"], "full")
    roots = F.array_union(F.coalesce("roots", none), F.coalesce("added", none))
    out = both.withColumn("roots", F.array_sort(F.array_except(roots, F.coalesce("taken", none)))).where(F.size("roots") > 0)
    return out.select("edge_key", "from", "predicate", "to", "roots", F.coalesce("new_data", "_data").alias("data"))


#: Plans say themselves whether they take roots away.
apply_edge_deletes = apply_edges


def apply_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """The links after a plan; several requests for a link leave one, with the data of the greatest request."""
    kept = links.join(plan.where(F.col("action").isin("updated", "deleted")), "edge_key", "left_anti")
    if "data" not in plan.columns:
        return kept
    new = plan.where(F.col("action").isin("inserted", "updated"))
    new = new.groupBy("edge_key", "from", "predicate", "to").agg(F.max_by("data", "request_id").alias("data"))
    return kept.unionByName(new.select(*links.columns))
