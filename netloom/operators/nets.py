"""Electrical nets: components of all layers, joined by plated holes."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.components import Forest

NET = "board_id int, layer string, component int, net int"
STEP = "board_id int, start string, end string, step int, from_node string, drill int, to_node string"


def merge(component_stats: DataFrame, member: DataFrame) -> DataFrame:
    """(board_id, layer, component, net): every component gets a net, also
    isolated ones.  Nets count from 1 by their first (layer, component), layers
    in lexicographic order.  A group is one board."""

    def run(nodes: pd.DataFrame, joins: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["layer", "component"], ignore_index=True)
        at = {k: i for i, k in enumerate(zip(nodes["layer"], nodes["component"], strict=True))}
        forest, first = Forest(len(nodes)), {}
        for drill, layer, comp in zip(joins["drill"], joins["layer"], joins["component"], strict=True):
            i = at[layer, comp]
            forest.join(first.setdefault(drill, i), i)
        roots = pd.Series([forest.find(i) for i in range(len(nodes))], dtype="int64")
        return nodes.assign(net=roots.rank(method="dense").astype("int32"))

    nodes = component_stats.select("board_id", "layer", "component")
    return nodes.groupBy("board_id").cogroup(member.groupBy("board_id")).applyInPandas(run, NET)


def drill_edges(member: DataFrame, net: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each hole with the nets of its members (0 where none is known)."""
    m = member.join(net, ["board_id", "layer", "component"], "left").groupBy("board_id", "drill").agg(F.count("*").alias("n_members"), F.min(F.coalesce("net", F.lit(0))).alias("net"))
    return decisions.join(m, ["board_id", "drill"], "left").select("board_id", "drill", "classification", F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"), F.coalesce("net", F.lit(0)).alias("net"))


def groups(net: DataFrame) -> DataFrame:
    """Nets with more than one member, with their members in order."""
    g = net.groupBy("board_id", "net").agg(F.sort_array(F.collect_list(F.struct("layer", "component"))).alias("members"))
    return g.where(F.size("members") > 1)


def check(net: DataFrame, component_stats: DataFrame, canvas: DataFrame) -> DataFrame:
    """Sanity of a merge: how many nets, and the largest area that one net has
    on one layer as a share of all copper."""
    by = net.join(component_stats, ["board_id", "layer", "component"]).groupBy("board_id", "layer", "net").agg(F.sum("area_px").alias("px"))
    b = by.groupBy("board_id").agg(F.max("net").alias("n"), F.sum("px").alias("total"), F.max("px").alias("most"))
    rows = canvas.select("board_id").join(b, "board_id", "left")
    n = F.coalesce("n", F.lit(0))
    share = F.coalesce(F.col("most") / F.nullif("total", F.lit(0)), F.lit(0.0))
    warn = F.array_compact(F.array(F.when(n == 0, "no nets"), F.when(n == 1, "a single net"), F.when((n > 1) & (share > 0.7), "one net dominates")))
    return rows.select("board_id", n.alias("n_nets"), share.alias("largest_net_share"), warn.alias("warnings"))


def explain(member: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shortest paths, hole by hole, for ``wanted(board_id, start, end)`` with
    nodes written layer:component.  Ties go to the lower drill, then to the
    lower member, as a breadth-first search in that order finds them; no rows
    where nothing connects the two, or where they are the same."""

    def run(joins: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        joins = joins.sort_values(["drill", "layer", "component"])
        by_drill: dict[int, list[str]] = {}
        of_node: dict[str, list[int]] = {}
        for drill, layer, comp in zip(joins["drill"], joins["layer"], joins["component"], strict=True):
            node = f"{layer}:{comp}"
            by_drill.setdefault(int(drill), []).append(node)
            of_node.setdefault(node, []).append(int(drill))
        out = []
        for board, start, end in zip(pairs["board_id"], pairs["start"], pairs["end"], strict=True):
            came: dict[str, tuple[str, int] | None] = {start: None}
            todo = deque([start])
            while todo and end not in came:
                at = todo.popleft()
                for drill in of_node.get(at, []):
                    for node in by_drill[drill]:
                        if node not in came:
                            came[node] = (at, drill)
                            todo.append(node)
            steps, at = [], end
            while came.get(at):
                back, drill = came[at]
                steps.append((back, drill, at))
                at = back
            out += [(board, start, end, i + 1, a, d, b) for i, (a, d, b) in enumerate(reversed(steps))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])

    return member.groupBy("board_id").cogroup(wanted.groupBy("board_id")).applyInPandas(run, STEP)
