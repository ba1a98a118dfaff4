"""Dependency graphs: edges (src, dst, weight), ranks, levels, communities, contraction."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .merging import Merging
from .nearest import in_turn

# What an edge of each type weighs.
TYPE_WEIGHTS = {
    "Implement": 7.575, "Throw": 9.053, "Call": 0.177, "Create": 1.665, "ImplLink": 9.33, "Extend": 2.159,
    "Use": 0.509, "Parameter": 5.146, "Import": 8.300, "Cast": 0.701, "Return": 5.702, "Contain": 4.478,
}
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Pairs of nodes that one task merges on arrays; more are merged by rounds of joins.
IN_TASK = 5_000_000
#: A path part that more sets of parts have, on both sides, does not pair them one by one.
FEW = 50
#: Sets of at most so many path parts meet through their subsets; where no part is rare, larger ones too.
SMALL, MOST = 6, 12


def cut(df: DataFrame) -> DataFrame:
    """End an iteration's lineage with a written table in the shared folder.

    Unlike a checkpoint it also ends the planner's size estimates, whose products would grow with each round."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def type_weight(kind: Column) -> Column:
    plain = F.when(kind.contains("possible"), F.substring_index(kind, "(", 1)).otherwise(kind)
    out = F.lit(0.0)
    for k, w in TYPE_WEIGHTS.items():
        out = F.when(plain == k, w).otherwise(out)
    return out


def from_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a dependency document; of cells for one pair the last wins."""
    doc = spark.read.schema("variables array<string>, cells array<struct<src:int,dest:int,values:map<string,double>>>").option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("variables").alias("id", "name"))
    cells = doc.select(F.posexplode("cells").alias("pos", "c")).select("pos", F.col("c.src").alias("src"), F.col("c.dest").alias("dst"), F.col("c.values").alias("types"))
    weight = F.aggregate(F.map_entries("types"), F.lit(0.0), lambda s, e: s + type_weight(e["key"]) * e["value"])
    return nodes, last_wins(cells.withColumn("weight", weight), "pos")


def last_wins(edges: DataFrame, position: str) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst", position)]
    best = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*others), position).alias("e"))
    return best.select("src", "dst", *(F.col(f"e.{c}") for c in others))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(node, rank) by weighted power iteration; without a tolerance exactly ``rounds`` rounds are made, with one it is an
    error if they don't settle. A round is one written table: the lost mass and the distance moved are sums over it."""
    nodes = cut(nodes if nodes is not None else nodes_of(edges))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    gives = share.select(F.col("src").alias("node"), F.lit(True).alias("gives")).distinct()
    rank = cut(nodes.join(gives, "node", "left").select("node", F.lit(1.0 / n).alias("rank"), F.col("gives").isNull().alias("dangling"), F.lit(float("inf")).alias("moved")))
    for _ in range(rounds):
        lost, moved = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)), F.sum("moved")).first()
        if tolerance is not None and moved < n * tolerance:
            return rank.select("node", "rank")
        given = rank.join(share, rank.node == share.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        new = F.coalesce("given", F.lit(0.0)) * damping + (1 - damping + damping * lost) / n
        rank = cut(rank.join(given, rank.node == given.dst, "left").select("node", new.alias("rank"), "dangling", F.abs(new - F.col("rank")).alias("moved")))
    if tolerance is not None and rank.agg(F.sum("moved")).first()[0] >= n * tolerance:
        raise RuntimeError(f"ranks have not settled in {rounds} rounds")
    return rank.select("node", "rank")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(nodes_of(edges), "node", "left_anti")


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(nodes_of(edges), "node", "left_semi")


def bfs_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, level): steps from the nearest source; unreached nodes are left out."""
    seen = cut(sources.select("node", F.lit(0).alias("level")).distinct())
    front, level = seen, 0
    while True:
        level += 1
        step = edges.join(front, edges.src == front.node).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(step.withColumn("level", F.lit(level)))
        if not front.take(1):
            return seen
        seen = cut(seen.union(front))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) by peeling nodes without predecessors; nodes on or behind a cycle are left out."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(nodes_of(edges))
    out, level = None, 0
    while True:
        peeled = cut(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if not peeled.take(1):
            return out if out is not None else peeled.withColumn("level", F.lit(0))
        part = peeled.withColumn("level", F.lit(level))
        out = part if out is None else cut(out.union(part))
        nodes = cut(nodes.join(peeled, "node", "left_anti"))
        left = cut(left.join(peeled.withColumnRenamed("node", "src"), "src", "left_anti"))
        level += 1


def is_dag(edges: DataFrame) -> bool:
    return topological_levels(edges).count() == nodes_of(edges).count()


def reweight(edges: DataFrame, ranks: DataFrame, relevance: DataFrame) -> DataFrame:
    """(rank of both ends) * (relevance of src / relevance of dst) * weight; 1.0 where relevance is unknown."""
    facts = ranks.join(relevance, "node", "left").select("node", "rank", F.coalesce("relevance", F.lit(1.0)).alias("relevance"))
    a, b = (facts.select(F.col("node").alias(k), F.col("rank").alias(f"{k}_rank"), F.col("relevance").alias(f"{k}_rel")) for k in ("src", "dst"))
    weight = (F.col("src_rank") + F.col("dst_rank")) * F.try_divide("src_rel", "dst_rel") * F.col("weight")
    return edges.join(a, "src").join(b, "dst").select("src", "dst", weight.alias("weight"))


def contract(edges: DataFrame, membership: DataFrame, by: str = "sum", position: str | None = None) -> DataFrame:
    """Edges between communities, inner ones dropped; weights are summed, or the last by ``position`` wins."""
    a, b = (membership.select(F.col("node").alias(k), F.col("community").alias(f"c{k}")) for k in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst").where("csrc <> cdst")
    e = e.groupBy(F.col("csrc").alias("src"), F.col("cdst").alias("dst"))
    return e.agg(F.sum("weight").alias("weight") if by == "sum" else F.max_by("weight", position).alias("weight"))


def merge_types(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def contract_types(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src, dst, weight, types): edges between communities with their weights and, key by key, their types summed."""
    a, b = (membership.select(F.col("node").alias(k), F.col("community").alias(f"c{k}")) for k in ("src", "dst"))
    e = edges.join(a, "src").join(b, "dst").where("csrc <> cdst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst"), "weight", "types")
    weights = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    each = e.select("src", "dst", F.explode("types").alias("k", "v")).groupBy("src", "dst", "k").agg(F.sum("v").alias("v"))
    types = each.groupBy("src", "dst").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("types"))
    return weights.join(types, ["src", "dst"], "left")


def path_parts(path: Column) -> Column:
    return F.split(F.btrim(path, F.lit("/")), "/")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def mean_similarity(isolated: DataFrame, members: DataFrame, few: int = FEW, small: int = SMALL) -> DataFrame:
    """(path, community, similarity): mean Jaccard of path parts between each isolated path and each community.

    Pairs with nothing in common, which add nothing, are never made; a member listed twice counts twice."""
    parts = F.array_sort(F.array_distinct(path_parts(F.col("path"))))
    left = cut(isolated.select("path").distinct().select("path", parts.alias("f")).where("f is not null").withColumn("n", F.size("f")))
    right = members.select("community", parts.alias("f")).where("f is not null").groupBy("community", "f").agg(F.count(F.lit(1)).alias("weight"))
    total = similarity_sums(left.select("f", "n").distinct(), cut(right.select("community", "f", F.size("f").alias("n"), "weight")), few, small)
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return left.join(total, ["f", "n"]).join(sizes, "community").select("path", "community", (F.col("s") / F.col("size")).alias("similarity"))


def similarity_sums(left: DataFrame, right: DataFrame, few: int, small: int) -> DataFrame:
    """(f, n, community, s): sums of Jaccard similarities between sets of parts, f of each row (f, n) and of the rows
    (community, f, n, weight); n is the size of the whole set, of which f may be what was left of it.

    Sets of at most ``small`` parts meet through their subsets, a larger set meets others in pairs through rare parts."""
    most = [df.agg(F.max(F.size("f"))).first()[0] or 0 for df in (left, right)]
    fits = F.size("f") <= small
    out = sums_by_subsets(left.where(fits), right.where(fits))
    if most[0] > small:
        out = out.union(sums_by_pairs(left.where(~fits), right, few, small))
    if most[1] > small:
        out = out.union(sums_by_pairs(left.where(fits), right.where(~fits), few, small))
    return out if max(most) <= small else out.groupBy("f", "n", "community").agg(F.sum("s").alias("s"))


def subsets(f: str) -> Column:
    """The non-empty subsets of a sorted array of parts, joined by slashes, which no part has."""
    return F.aggregate(f, F.array().cast("array<string>"), lambda made, x: F.concat(made, F.transform(made, lambda t: F.concat_ws("/", t, x)), F.array(x)))


def sums_by_subsets(left: DataFrame, right: DataFrame) -> DataFrame:
    """similarity_sums through counts of the sets that have a subset, so it makes rows in proportion to the sets.

    The similarity k / (n + m - k) of sets that share k parts is the sum over the subsets of these, j parts each, of
    j! / ((n + m - 1) ... (n + m - j))."""
    counts = right.select("community", F.col("n").alias("m"), "weight", F.explode(subsets("f")).alias("t")).groupBy("t", "community", "m").agg(F.sum("weight").alias("weight"))
    each = left.select("f", "n", F.explode(subsets("f")).alias("t")).join(counts, "t").withColumn("j", F.size(F.split("t", "/")))
    adds = F.col("weight").cast("double")
    for i in range(1, MOST + 1):
        adds = adds * F.when(F.col("j") >= i, F.lit(float(i)) / (F.col("n") + F.col("m") - i)).otherwise(1.0)
    return each.groupBy("f", "n", "community").agg(F.sum(adds).alias("s"))


def sums_by_pairs(left: DataFrame, right: DataFrame, few: int, small: int) -> DataFrame:
    """similarity_sums through the parts that at most ``few`` sets of a side have, which makes pairs in proportion to
    the sets.

    The other parts are what is left of each set; sets with the same left are one, and are summed in turn. A pair made
    here adds what its similarity is more than by what is left. Where every part is in many sets, those of at most
    ``MOST`` parts meet through their subsets, and of larger ones all pairs that share a part are made."""
    left, right = cut(left), cut(right)
    count = lambda df, n: df.select(F.explode("f").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias(n))
    least = F.least(*(F.coalesce(c, F.lit(0)) for c in ("l", "r")))  # what only one side has makes no pair, and is not left
    parts = cut(count(left, "l").join(count(right, "r"), "part", "full").select("part", (least > few).alias("often")))
    rare, often = parts.agg(F.count_if(~F.col("often")), F.count_if("often")).first()
    if not rare and often and small < MOST:
        return similarity_sums(left, right, few, MOST)
    if not rare:  # nothing would go
        parts, often = parts.withColumn("often", F.lit(False)), 0

    def rest(df, *key):
        """With g, what is left of f."""
        each = df.select(*key, F.explode("f").alias("part")).join(parts.where("often").select("part"), "part")
        return cut(df.join(each.groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("g")), list(key), "left").withColumn("g", F.coalesce("g", F.array().cast("array<string>"))))

    left, right = rest(left, "f", "n"), rest(right, "community", "f", "n")
    a = left.select("f", "n", "g", F.explode("f").alias("part")).join(parts.where("not often").select("part"), "part")
    b = right.select("community", F.col("f").alias("of"), F.col("n").alias("m"), F.col("g").alias("og"), "weight", F.explode("f").alias("part"))
    pairs = a.join(b, "part").groupBy("f", "n", "g", "community", "of", "m", "og", "weight").agg(F.count(F.lit(1)).alias("shared"))
    alike = lambda k: F.col(k) / (F.col("n") + F.col("m") - F.col(k))
    pairs = pairs.withColumn("less", F.size(F.array_intersect("g", "og"))).withColumn("shared", F.col("shared") + F.col("less"))
    found = pairs.groupBy("f", "n", "community").agg(F.sum(F.col("weight") * (alike("shared") - alike("less"))).alias("s"))
    if not often:
        return found
    more = similarity_sums(left.where("size(g) > 0").select(F.col("g").alias("f"), "n").distinct(), right.where("size(g) > 0").groupBy("community", F.col("g").alias("f"), "n").agg(F.sum("weight").alias("weight")), few, small)
    more = left.select("f", "n", "g").join(more.withColumnRenamed("f", "g"), ["g", "n"]).select("f", "n", "community", "s")
    return found.union(more).groupBy("f", "n", "community").agg(F.sum("s").alias("s"))


def assign_isolated(similarity: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each isolated path's best community at or above the threshold, ties to the least id; made in one step."""
    best = W.partitionBy("path").orderBy(F.desc("similarity"), "community")
    return similarity.where(F.col("similarity") >= threshold).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def assign_isolated_in_turn(isolated: DataFrame, members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, community) of isolated paths taken in the order of their column ``turn``: each joins the community that
    is nearest on average, and then counts as its member; ties go to the earlier one. Below the threshold it founds a
    community, numbered on from the last. Each step needs the one before, so this runs in one task, for paths that
    fit there; assign_isolated decides all at once and has no such bound."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "path"], na_position="first")
        given = rows.community.notna()
        first = [(path, int(c)) for path, c in zip(rows.path[given], rows.community[given])]
        return pd.DataFrame(in_turn(first, rows.path[~given].tolist(), threshold), columns=["path", "community"])

    first = members.select("path", F.col("community").cast("long").alias("community"), F.lit(None).cast("long").alias("turn"))
    both = first.unionByName(isolated.select("path", F.lit(None).cast("long").alias("community"), F.col("turn").cast("long").alias("turn")))
    return both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(work, "path string, community long")


def community_table(membership: DataFrame) -> DataFrame:
    """Communities by falling size, then least member: (community_id, size, nodes)."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    place = F.row_number().over(W.orderBy(F.desc("size"), "least")) - 1  # of ids and sizes alone
    named = sizes.select("community", F.concat(F.lit("Community_"), place).alias("community_id"), "size")
    nodes = membership.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return named.join(nodes, "community").select("community_id", "size", "nodes")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): each pair of tied nodes once, with the sum of its weights."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return both.groupBy("a", "b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("w"))


def merged_in_task(pairs: DataFrame, merge) -> DataFrame:
    """(node, into) of the nodes in ``pairs``, after ``merge`` of their Merging in one task."""

    def work(batches):
        rows = pa.Table.from_batches(batches).sort_by([("a", "ascending"), ("b", "ascending")])
        k, both = len(rows), pa.chunked_array(rows["a"].chunks + rows["b"].chunks, rows["a"].type)
        nodes, number = np.unique(both.to_numpy(), return_inverse=True)
        m = Merging(number[:k], number[k:], rows["w"].to_numpy(), len(nodes))
        merge(m)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, both.type), pa.array(nodes[m.members()], both.type)], ["node", "into"])

    return pairs.coalesce(1).mapInArrow(work, pairs.select(F.col("a").alias("node"), F.col("a").alias("into")).schema)


def communities(edges: DataFrame, most: int = 20, rounds: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(node, community) by seeded size-bounded merging: each round every community asks to join the neighbour
    with the greatest tie by modularity gain; pairs that choose each other merge if together they have at most
    ``most`` nodes. An exact partition, the same for the same edges. Goes on until no two agree, or for ``rounds`` rounds.
    Up to ``in_task`` pairs are merged in one task, more by joins."""
    both = cut(undirected(edges))
    n, total = both.agg(F.count(F.lit(1)), F.sum("w")).first()
    member = cut(nodes_of(edges).select("node", F.col("node").alias("community")))
    if 0 < n <= in_task:
        return cut(into(member, merged_in_task(both, lambda m: m.communities(most, rounds)).withColumnRenamed("node", "community")))
    for _ in (range(rounds) if rounds is not None else itertools.count()) if total else ():
        size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
        tied = both.join(member.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
        degree = tied.select(F.col("ca").alias("c"), "w").union(tied.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("d"))
        pairs = tied.where("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), "w").groupBy("x", "y").agg(F.sum("w").alias("w"))
        for k in ("x", "y"):
            pairs = pairs.join(size.select(F.col("community").alias(k), F.col("n").alias(f"n{k}")), k).join(degree.select(F.col("c").alias(k), F.col("d").alias(f"d{k}")), k)
        gain = pairs.where(F.col("nx") + F.col("ny") <= most).withColumn("gain", F.col("w") / total - F.col("dx") * F.col("dy") / (2 * total * total)).where("gain > 0")
        asks = gain.select(F.col("x").alias("me"), F.col("y").alias("other"), "gain").union(gain.select(F.col("y").alias("me"), F.col("x").alias("other"), "gain"))
        best = asks.groupBy("me").agg(F.min_by("other", F.struct(-F.col("gain"), F.col("other"))).alias("other"))
        agreed = cut(best.alias("p").join(best.alias("q"), (F.col("p.other") == F.col("q.me")) & (F.col("q.other") == F.col("p.me"))).where("p.me < p.other").select(F.col("p.other").alias("community"), F.col("p.me").alias("into")))
        if not agreed.take(1):
            break
        member = cut(into(member, agreed))
    return member


def into(member: DataFrame, merged: DataFrame) -> DataFrame:
    """Membership after communities have merged ``into`` others; those that ``merged`` doesn't name stay."""
    return member.join(merged, "community", "left").select("node", F.coalesce("into", "community").alias("community"))


def recluster(edges: DataFrame, most: int = 20, below: int = 200, rounds: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(node, community): communities of communities, until fewer than ``below`` are left or a round merges none.

    ``most`` bounds the members of one round's community, which from the second round on are communities. As soon as a
    level has at most ``in_task`` pairs, it and all later ones are made in one task."""
    member, level = cut(nodes_of(edges).select("node", F.col("node").alias("community"))), edges
    count, first = member.count(), True
    while first or count >= below:
        pairs = cut(undirected(level))
        if 0 < pairs.count() <= in_task:
            tied = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().count()
            others, always = count - tied, first
            merged = merged_in_task(pairs, lambda m: m.recluster(most, below, rounds, others, always))
            return cut(into(member, merged.withColumnRenamed("node", "community")))
        member = cut(into(member, communities(level, most, rounds, 0).select(F.col("node").alias("community"), F.col("community").alias("into"))))
        left = member.select("community").distinct().count()
        if left == count and not first:
            break
        count, first = left, False
        level = cut(contract(edges, member))
    return member


def roll_up(modules: DataFrame, membership: DataFrame, names: DataFrame) -> DataFrame:
    """(module_name, reasoning, nodes): the names in each module's communities; ids of no community are skipped.

    ``modules`` has module_name, reasoning and the array communities; names come in the order of their ids."""
    listed = modules.select("module_name", "reasoning", F.posexplode("communities").alias("at", "community"))
    found = listed.join(membership, "community").join(names.select(F.col("id").alias("node"), "name"), "node")
    lists = found.groupBy("module_name").agg(F.array_sort(F.collect_list(F.struct("at", "node", "name"))).alias("n"))
    return modules.select("module_name", "reasoning").join(lists, "module_name", "left").select("module_name", "reasoning", F.coalesce(F.transform("n", lambda x: x["name"]), F.array().cast("array<string>")).alias("nodes"))


def payload(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of JSON texts (communities, edges) for a prompt over a contracted graph, whose size recluster bounds."""
    as_json = lambda df, order: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))))).toDF("j")
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])
    left, right = as_json(communities, ["id"]).withColumnRenamed("j", "communities"), as_json(links, ["source", "target"]).withColumnRenamed("j", "edges")
    return left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one").drop("one")
