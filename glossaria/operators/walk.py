"""Bounded walks of the graph.

A walk answers a whole frame of requests at once. Every round is one join of the frontier with the arrows; the driver only asks
whether the frontier is empty. Trees and closures keep a frontier of distinct nodes; paths are built only towards nodes from which a target
can be reached, found by a walk back from the targets.

Requests have ``request_id`` and ``root``. ``many_to_one`` walks against the arrows, from a parent to its children.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import handle_key
from glossaria.operators.flat import first_by, terms_by_code, with_terms
from glossaria.plans.cut import cut, dealt
from glossaria.plans.dictionary import Dictionary

LEVELS = 10


def arrows(d: Dictionary, many_to_one: bool = True) -> DataFrame:
    """(root, node, next, predicate, edge_key): the steps of each root's graph."""
    node, next_ = ("to", "from") if many_to_one else ("from", "to")
    return d.edge_path.select("root", F.col(node).alias("node"), F.col(next_).alias("next"), "predicate", "edge_key")


def _onward(steps: DataFrame, on: list[str]) -> DataFrame:
    """The steps whose ends have steps themselves. A walk that only asks for the steps at its nodes need not enter dead ends."""
    ends = steps.select(*(F.col(c).alias("next") if c == "node" else F.col(c) for c in on)).distinct()
    return cut(steps.join(ends, ["next" if c == "node" else c for c in on], "left_semi").select(*on, "next").distinct())


def _reached(steps: DataFrame, starts: DataFrame, on: list[str], levels: int) -> DataFrame:
    """(request_id, *on, depth): distinct nodes within ``levels`` steps, each at its least depth."""
    frontier = starts.select("request_id", *on).distinct().withColumn("depth", F.lit(0))
    seen = frontier = cut(frontier)
    for depth in range(1, levels + 1):
        ahead = frontier.drop("depth").join(steps, on).select("request_id", *(F.col("next").alias("node") if c == "node" else F.col(c) for c in on)).distinct()
        frontier = cut(ahead.join(seen, ["request_id", *on], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def tree_rows(d: Dictionary, requests: DataFrame, predicates: Iterable[str], many_to_one: bool = True, levels: int = LEVELS) -> DataFrame:
    """As ``tree``, one row for each child: (request_id, parent, predicate, child, depth), the depth that of the child below its parent.

    A parent of any number of children stays dealt over tasks; ordered by depth, the rows are the tree breadth first.
    """
    steps = cut(arrows(d, many_to_one))
    nodes = _reached(_onward(steps, ["root", "node"]), requests.withColumn("node", F.col("root")), ["root", "node"], levels - 1)
    found = nodes.join(steps, ["root", "node"]).where(F.col("predicate").isin(*predicates))
    return found.select("request_id", F.col("node").alias("parent"), "predicate", F.col("next").alias("child"), (F.col("depth") + 1).alias("depth"))


def tree(d: Dictionary, requests: DataFrame, predicates: Iterable[str], many_to_one: bool = True, levels: int = LEVELS) -> DataFrame:
    """(request_id, parent, predicate, children) of all edges within ``levels`` of the root that have an allowed predicate.

    ``requests``: (request_id, root). Edges of other predicates of the root are walked through. An edge that closes a circle is
    listed but not walked again. All children of a parent are one row; ``tree_rows`` gives them a row each.
    """
    found = tree_rows(d, requests, predicates, many_to_one, levels)
    return found.groupBy("request_id", "parent", "predicate").agg(F.array_sort(F.collect_set("child")).alias("children"))


def property_tree(d: Dictionary, requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """As ``tree`` for properties and bridges, over the edges of all roots."""
    steps = cut(d.edges.select(F.col("to").alias("node"), F.col("from").alias("next"), "predicate"))
    nodes = _reached(_onward(steps, ["node"]), requests.select("request_id", F.col("root").alias("node")), ["node"], levels - 1)
    found = nodes.join(steps, "node").where(F.col("predicate").isin(model.PROPERTY_OF, model.BRIDGE_OF))
    return found.groupBy("request_id", F.col("node").alias("parent"), "predicate").agg(F.array_sort(F.collect_set("next")).alias("children"))


def tree_dictionary(found: DataFrame) -> DataFrame:
    """A3: (request_id, parent, children MAP<predicate, handles>): a tree as one dictionary entry for each parent.

    The outer level stays rows, so a tree of any size is dealt over tasks.
    """
    entry = F.struct("predicate", "children")
    return found.groupBy("request_id", "parent").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("children"))


def paths(
    d: Dictionary,
    requests: DataFrame,
    emit: Column,
    expand: Column | None = None,
    many_to_one: bool = True,
    min_level: int = 1,
    max_level: int = LEVELS,
    towards: DataFrame | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """(request_id, depth, vertices, edges, node, predicate, edge_key): walks without repeated vertices.

    ``requests``: (request_id, root, start) and any columns that ``emit`` and ``expand`` use; both see ``predicate``, ``node`` (the end
    of the last edge), ``before`` (its other end) and ``edge_key``. A path is returned if ``emit`` holds for its last edge, and goes
    on if ``expand`` does; the two are separate tests. ``towards``: (request_id, node), the only nodes worth visiting. ``steps``: the
    arrows, if they are at hand as a table.
    """
    steps = cut(arrows(d, many_to_one)) if steps is None else steps
    names = requests.columns
    frontier = requests.withColumn("node", F.col("start")).withColumn("vertices", F.array("start")).withColumn("edges", F.array().cast("array<string>"))
    found = None
    for depth in range(1, max_level + 1):
        ahead = frontier.join(steps, ["root", "node"]).where(~F.array_contains("vertices", F.col("next")))
        ahead = ahead.select(
            *names,
            F.col("node").alias("before"),
            F.col("next").alias("node"),
            F.concat("vertices", F.array("next")).alias("vertices"),
            F.concat("edges", F.array("edge_key")).alias("edges"),
            "predicate",
            "edge_key",
        )
        if towards is not None:
            ahead = ahead.join(towards, ["request_id", "node"], "left_semi")
        ahead = cut(ahead)
        if depth >= min_level:
            hits = ahead.where(emit).select("request_id", F.lit(depth).alias("depth"), "vertices", "edges", "before", "node", "predicate", "edge_key")
            found = hits if found is None else found.unionByName(hits)
        frontier = (ahead if expand is None else ahead.where(expand)).drop("before", "predicate", "edge_key")
        if depth < max_level and frontier.isEmpty():
            break
    if found is None:
        raise ValueError("max_level is below min_level")
    return found


def level_paths(d: Dictionary, requests: DataFrame, predicates: Iterable[str], many_to_one: bool = True, min_level: int = 1, max_level: int = LEVELS) -> DataFrame:
    """Paths from a parent whose last edge has an allowed predicate, by depth. ``requests``: (request_id, root, parent)."""
    return paths(d, requests.withColumnRenamed("parent", "start"), F.col("predicate").isin(*predicates), None, many_to_one, min_level, max_level)


def _towards(steps: DataFrame, targets: DataFrame, levels: int) -> DataFrame:
    """Nodes from which a target can be reached by the steps, per request. ``targets``: (request_id, root, node)."""
    back = steps.select("root", F.col("next").alias("node"), F.col("node").alias("next"))
    back = _reached(back, targets, ["root", "node"], levels)
    return back.select("request_id", "node").distinct()


def _paths_to(d: Dictionary, targets: DataFrame, expand: Column | None, many_to_one: bool, levels: int, last: str | None = None) -> DataFrame:
    """(root, target, depth, vertices, ...): ``paths`` from each root to its targets (root, target); with ``last``, only those whose last edge has this predicate.

    Whoever asks, the ways from a root to a node are the same, so each is walked once, however many requests or targets share it.
    """
    steps = cut(arrows(d, many_to_one))
    near = targets.select("root", F.col("target").alias("node")).distinct()
    if last is not None:
        near = near.join(steps.where(F.col("predicate") == last).select("root", F.col("next").alias("node")), ["root", "node"], "left_semi")
    near = cut(near)
    asked = near.select(F.col("root").alias("request_id"), "root", F.col("root").alias("start")).distinct()
    towards = _towards(steps, near.select(F.col("root").alias("request_id"), "root", "node"), levels)
    emit = F.lit(True) if last is None else F.col("predicate") == last
    found = paths(d, asked, emit, expand, many_to_one, 1, levels, towards, steps).withColumnRenamed("request_id", "root")
    return found.join(near, ["root", "node"], "left_semi").withColumn("target", F.col("node"))


def _answers(requests: DataFrame, found: DataFrame) -> DataFrame:
    """The paths (root, target, ...) for each request (request_id, root, target)."""
    out = requests.select("request_id", "root", "target").join(found, ["root", "target"])
    return out.select("request_id", "depth", "vertices", "edges", "before", "node", "predicate", "edge_key")


def node_paths(d: Dictionary, requests: DataFrame, predicates: Iterable[str], many_to_one: bool = True, max_level: int = LEVELS) -> DataFrame:
    """Paths from the root to a target. ``requests``: (request_id, root, target)."""
    return _answers(requests, _paths_to(d, requests, F.col("predicate").isin(*predicates), many_to_one, max_level))


def code_targets(d: Dictionary, requests: DataFrame) -> DataFrame:
    """(request_id, root, target) for every term that has the code. ``requests``: (request_id, root, field, code)."""
    hits = terms_by_code(d, requests).select("request_id", F.concat(F.lit("terms/"), "key").alias("target"))
    return requests.select("request_id", "root").join(hits, "request_id")


def code_paths(d: Dictionary, requests: DataFrame, predicates: Iterable[str], many_to_one: bool = True, max_level: int = LEVELS) -> DataFrame:
    """Paths from the root to every target with a code in a field. ``requests``: (request_id, root, field, code)."""
    return node_paths(d, code_targets(d, requests), predicates, many_to_one, max_level)


def first_edges(d: Dictionary, starts: DataFrame, functional: str, sections: Iterable[str], many_to_one: bool, levels: int) -> DataFrame:
    """(request_id, root, target, matched, depth): the end of the first functional edge on a walk on from each target, by depth, then edge key.

    A round takes one step from the nodes reached last; a request whose round met a functional edge leaves the frontier, so later rounds carry
    only those without a match. Nodes are kept, not paths: an edge to a node that the request has not met closes no circle. A request whose match lies
    in a round with an edge to a node met before (a circle, or two ways to one node) is answered by whole paths instead.
    """
    key = ["request_id", "root", "target"]
    steps = cut(arrows(d, many_to_one).where(F.col("predicate").isin(functional, *sections)))
    frontier = seen = cut(starts.select(*key, F.col("target").alias("node")).distinct())
    found, doubtful = [], []
    for depth in range(1, levels + 1):
        ahead = frontier.join(steps, ["root", "node"]).select(*key, F.col("next").alias("node"), "predicate", "edge_key")
        ahead = cut(ahead.join(seen.withColumn("met", F.lit(True)), [*key, "node"], "left"))
        hits = ahead.where(F.col("predicate") == functional).groupBy(*key).agg(F.min_by("node", "edge_key").alias("matched"), F.bool_or(F.col("met").isNotNull()).alias("doubt"))
        hits = cut(hits)
        found.append(hits.where("NOT doubt").select(*key, "matched", F.lit(depth).alias("depth")))
        doubtful.append(hits.where("doubt").select(*key))
        frontier = cut(ahead.where("met IS NULL").join(hits, key, "left_anti").select(*key, "node").distinct())
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    rest = reduce(DataFrame.unionByName, doubtful)
    if not rest.isEmpty():
        walked = paths(d, rest.withColumn("start", F.col("target")), F.col("predicate") == functional, F.col("predicate").isin(functional, *sections), many_to_one, 1, levels)
        first = first_by(walked, ["request_id", "root", F.element_at("vertices", 1)], ["depth", "edge_key"])
        found.append(first.select("request_id", "root", F.element_at("vertices", 1).alias("target"), F.col("node").alias("matched"), "depth"))
    return reduce(DataFrame.unionByName, found)


def match_nodes(d: Dictionary, requests: DataFrame, functional: str, sections: Iterable[str] = (), many_to_one: bool = True, levels: int = LEVELS) -> DataFrame:
    """(request_id, target, matched, depth): the preferred node of a target in a root's graph.

    ``requests``: (request_id, root, target). It is the target itself, at depth 0, if its own edge towards the root is functional;
    otherwise the end of the first functional edge on a walk on from it, by depth and then edge key. Targets without one are left out.
    """
    own = d.edge_path.where(F.col("predicate") == functional).select("root", F.col("from" if many_to_one else "to").alias("target")).distinct()
    direct = requests.join(own, ["root", "target"], "left_semi")
    rest = requests.join(own, ["root", "target"], "left_anti")
    at_once = direct.select("request_id", "target", F.col("target").alias("matched"), F.lit(0).alias("depth"))
    return at_once.unionByName(first_edges(d, rest, functional, tuple(sections), many_to_one, levels).select("request_id", "target", "matched", "depth"))


def match_codes(d: Dictionary, requests: DataFrame, functional: str, sections: Iterable[str] = (), many_to_one: bool = True, levels: int = LEVELS) -> DataFrame:
    """(request_id, matched): preferred nodes of all terms with a code. ``requests``: (request_id, root, field, code)."""
    return match_nodes(d, code_targets(d, requests), functional, sections, many_to_one, levels).select("request_id", "matched").distinct()


def match_enumeration(d: Dictionary, requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The first path from a root to an enumeration edge that has the target at an end.

    ``requests``: (request_id, root, target). The result has ``vertices`` and ``edges`` (the path), ``node`` (its end) and ``depth``. Paths
    are walked once for each root and offered to both ends of their last edge; of paths with one last edge, the least vertices win.
    """
    steps = cut(arrows(d))
    enum = steps.where(F.col("predicate") == model.ENUM_OF)
    ends = enum.select("root", F.explode(F.array("node", "next")).alias("node")).distinct()
    near = cut(requests.select("root", F.col("target").alias("node")).distinct().join(ends, ["root", "node"], "left_semi")).withColumn("request_id", F.col("root"))
    children = near.join(enum, ["root", "node"]).select("request_id", F.col("next").alias("node"))
    towards = cut(_towards(steps, near, levels).unionByName(children).distinct())
    starts = near.select("request_id", "root", F.col("root").alias("start")).distinct()
    found = paths(d, starts, F.col("predicate") == model.ENUM_OF, None, True, 1, levels, towards, steps).withColumnRenamed("request_id", "root")
    met = found.withColumn("target", F.explode(F.array("node", "before"))).join(near.select("root", F.col("node").alias("target")), ["root", "target"], "left_semi")
    order = F.struct("depth", "edge_key", "vertices")
    first = met.groupBy("root", "target").agg(F.min_by(F.struct("depth", "vertices", "edges", "before", "node", "predicate", "edge_key"), order).alias("x")).select("root", "target", "x.*")
    return first_by(_answers(requests, first), ["request_id"], ["depth", "edge_key", "vertices"])


def match_enumeration_code(d: Dictionary, requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every path from a root to an enumeration element with a code in a field.

    The root itself has no enumeration edge that leads to it, so no path has depth 0 (G20).

    ``requests``: (request_id, root, field, code). Records and keys follow from ``node`` (``with_terms``, ``handle_key``). Only codes of elements
    meet the requests.
    """
    elements = d.edge_path.where(F.col("predicate") == model.ENUM_OF).select("root", F.col("from").alias("target")).distinct()
    elements = cut(elements.join(requests.select("root").distinct(), "root", "left_semi"))
    named = d.terms.join(elements.select(handle_key(F.col("target")).alias("_key")), "_key", "left_semi")
    codes = Dictionary(named, d.edges).term_codes.withColumn("target", F.concat(F.lit("terms/"), "key"))
    asked = codes.join(elements, "target").join(requests, ["root", "field", "code"])
    asked = cut(asked.select("request_id", "root", "target").distinct())
    return _answers(asked, _paths_to(d, asked, None, True, levels, model.ENUM_OF))


def _linked(d: Dictionary, requests: DataFrame, predicate: str, levels: int, pack: int = 256) -> tuple[DataFrame, DataFrame]:
    """The distinct (request_id, end) of ``linked_keys``, dealt by request, and (end, key), which numbers the keys.

    Many requests pass a node, and each takes all its ends: these travel as numbers, about ``pack`` of them in a row.
    """
    steps = cut(d.links.select(F.col("from").alias("node"), F.col("to").alias("next"), "predicate"))
    starts = requests.select("request_id", F.concat(F.lit("terms/"), "key").alias("node"))
    nodes = _reached(_onward(steps, ["node"]), starts, ["node"], levels - 1)
    last = steps.where(F.col("predicate") == predicate).select("node", handle_key(F.col("next")).alias("key"))
    keys = cut(last.select("key").distinct().withColumn("end", F.monotonically_increasing_id()))
    ends = last.join(keys, "key").select("node", "end").distinct()
    packs = ends.join(ends.groupBy("node").agg(F.ceil(F.count("*") / pack).alias("parts")), "node")
    packs = packs.groupBy("node", F.pmod(F.xxhash64("end"), "parts").alias("part")).agg(F.collect_list("end").alias("ends"))
    found = dealt(nodes.join(cut(packs), "node").select("request_id", "ends"), "request_id")
    return found.select("request_id", F.explode("ends").alias("end")).distinct(), keys


def linked_keys(d: Dictionary, requests: DataFrame, predicate: str, levels: int = LEVELS) -> DataFrame:
    """(request_id, key) linked to a request's keys by 1 to ``levels`` links, the last of which has the predicate.

    ``requests``: (request_id, key), any number of keys for a request. Links of other predicates are walked through.
    """
    pairs, keys = _linked(d, requests, predicate, levels)
    return pairs.join(keys, "end").select("request_id", "key")


def linked_terms(d: Dictionary, requests: DataFrame, predicate: str, levels: int = LEVELS) -> DataFrame:
    """The terms of ``linked_keys``. Each key meets its term once, not once for each request."""
    pairs, keys = _linked(d, requests, predicate, levels)
    known = with_terms(d, keys.withColumn("handle", F.concat(F.lit("terms/"), "key")))
    return pairs.join(cut(known), "end").select("request_id", "key", "handle", "term")


def required_metadata(d: Dictionary, requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Keys required as metadata."""
    return linked_keys(d, requests, model.REQUIRES_METADATA, levels)


def connected(d: Dictionary, requests: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The requests (request_id, root, parent) whose parent is the root or reaches it along the arrows."""
    reached = _reached(cut(arrows(d, False)), requests.select("request_id", "root", F.col("parent").alias("node")), ["root", "node"], levels)
    return requests.join(reached.where("node = root").select("request_id").distinct(), "request_id", "left_semi")
