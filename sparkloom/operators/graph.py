"""Property graphs as two DataFrames: edges (src, dst, kind, confidence) and whatever describes nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

# fixed values: walks never enter placeholders, and drop edges under this confidence
CLOSED = ("external:", "callee:")
LEAST_CONFIDENCE = 0.5


def in_degree(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node, in_degree over the given kinds (all if none)."""
    own = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return own.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """here, there, kind, confidence for walks along, against or both ways."""
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "kind", "confidence")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "kind", "confidence")
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def walk(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", least: float = LEAST_CONFIDENCE, hub_limit: int | None = None) -> DataFrame:
    """root, node, distance, confidence: level by level from seeds (root, node).

    A node belongs to the first level that reaches it from a root; its
    confidence is the best, over the level's edges, of the least confidence
    along the path.  Hubs (more than ``hub_limit`` edges in) are reached but not
    left.  Each level is one join on the node key and one keyed aggregation,
    and is written out, so the plan doesn't grow.
    """
    steps = directed(edges, direction).where(F.col("confidence") >= least)
    for p in CLOSED:
        steps = steps.where(~F.col("there").startswith(p))
    if hub_limit is not None:
        hubs = in_degree(edges).where(F.col("in_degree") > hub_limit).select(F.col("node").alias("here"))
        steps = steps.join(hubs, "here", "left_anti")
    seen = seeds.select("root", "node", F.lit(0).alias("distance"), F.lit(1.0).alias("confidence"))
    level = seen
    for d in range(1, depth + 1):
        to = level.select("root", F.col("node").alias("here"), F.col("confidence").alias("so_far")).join(steps, "here")
        best = to.groupBy("root", F.col("there").alias("node")).agg(F.max(F.least("so_far", "confidence")).alias("confidence"))
        level = stage(best.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("distance"), "confidence"), "walk")
        seen = seen.unionByName(level)
    return seen


def expand_ranked(edges: DataFrame, reached: DataFrame, per_root: int) -> DataFrame:
    """The best nodes of each root by (distance, confidence x fan-in, node); fan-in = 1 / (1 + log10(1 + in-degree))."""
    fan = reached.where("distance > 0").join(in_degree(edges), "node", "left")
    value = F.col("confidence") / (1 + F.log10(1 + F.coalesce(F.col("in_degree"), F.lit(0))))
    rated = fan.withColumn("value", F.round(value, 6))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("distance", F.desc("value"), "node"))
    return rated.select("root", "node", "distance", "value", rank.alias("rank")).where(F.col("rank") <= per_root)


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other, kind, way: one hop both ways from the given nodes."""
    out = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.col("dst").alias("other"), "kind", F.lit("out").alias("way"))
    back = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.col("src").alias("other"), "kind", F.lit("in").alias("way"))
    return out.unionByName(back)


def containment(paths: DataFrame) -> DataFrame:
    """src, dst of the directory hierarchy of ``path``: dir -> dir -> file."""
    parts = F.split("path", "/")
    each = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
    name = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    dst = F.when(F.col("n") == F.size("p"), F.concat(F.lit("file:"), F.col("path"))).otherwise(F.concat(F.lit("dir:"), name(F.col("n"))))
    return each.select(F.concat(F.lit("dir:"), F.when(F.col("n") > 1, name(F.col("n") - 1)).otherwise("")).alias("src"), dst.alias("dst")).distinct()


def rollup_paths(files: DataFrame, value: str) -> DataFrame:
    """dir, depth, n, total: every file counted in all its ancestor directories."""
    parts = F.split("path", "/")
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"), F.col(value).alias("v"))
    return each.groupBy("dir").agg(F.count("*").alias("n"), F.sum("v").alias("total")).withColumn("depth", F.size(F.split("dir", "/")))


def cross_group(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, weight: edges between different groups, either way; groups (node, grp)."""
    s = groups.select(F.col("node").alias("src"), F.col("grp").alias("g1"))
    d = groups.select(F.col("node").alias("dst"), F.col("grp").alias("g2"))
    both = edges.join(s, "src").join(d, "dst").where("g1 <> g2")
    return both.groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).agg(F.count("*").alias("weight"))


def strongest_links(links: DataFrame, per_node: int = 2, most: int = 14) -> DataFrame:
    """Greedy by (weight descending, a, b): at most ``per_node`` links at an end, ``most`` in all.

    A fold over the group-to-group links, whose number is that of pairs of groups (top-level folders), not of edges.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "a", "b")))
    start = F.struct(F.array().cast("array<struct<a:string,b:string,weight:bigint>>").alias("kept"), F.array().cast("array<string>").alias("ends"))

    def step(acc, x):
        uses = lambda c: F.size(F.filter(acc["ends"], lambda e: e == c))
        fits = (uses(x["a"]) < per_node) & (uses(x["b"]) < per_node) & (F.size(acc["kept"]) < most)
        new = F.struct(x["a"].cast("string").alias("a"), x["b"].cast("string").alias("b"), (-x["w"]).alias("weight"))
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(new))).otherwise(acc["kept"]).alias("kept"), F.when(fits, F.concat(acc["ends"], F.array(x["a"].cast("string"), x["b"].cast("string")))).otherwise(acc["ends"]).alias("ends"))

    return links.agg(F.aggregate(ordered, start, step)["kept"].alias("kept")).select(F.inline("kept"))


def propagate(depends: DataFrame, changed: DataFrame, hops: int = 5) -> DataFrame:
    """node, hop: items made stale by changed keys and then by each other, each once; depends (item, key)."""
    seen = changed.select(F.col("key").alias("node")).distinct().withColumn("hop", F.lit(0))
    level = seen
    for h in range(1, hops + 1):
        level = stage(level.select(F.col("node").alias("key")).join(depends, "key").select(F.col("item").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h)), "stale")
        seen = seen.unionByName(level)
    return seen.where("hop > 0")


def unresolved_callers(edges: DataFrame, names: DataFrame, least: float = 0.2) -> DataFrame:
    """name, src, confidence: who calls a name (column name) that no symbol was found for."""
    own = names.select("name", F.concat(F.lit("callee:"), F.col("name")).alias("dst"))
    return edges.where(F.col("confidence") >= least).join(own, "dst").groupBy("name", "src").agg(F.max("confidence").alias("confidence"))


def nearest_of(reached: DataFrame, wanted: DataFrame, limit: int = 8) -> DataFrame:
    """The nodes of a walk that are in ``wanted`` (node), the nearest and surest ``limit`` of each root: tests of what changed, say."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy("distance", F.desc("confidence"), "node"))
    return reached.where("distance > 0").join(wanted.select("node").distinct(), "node", "left_semi").withColumn("rank", rank).where(F.col("rank") <= limit)


def siblings(contains: DataFrame, reached: DataFrame, confidence: float = 0.5) -> DataFrame:
    """root, node, distance, confidence: the other members of the folders that hold reached nodes, one step further."""
    folders = reached.join(contains.select(F.col("dst").alias("node"), F.col("src").alias("folder")), "node").groupBy("root", "folder").agg(F.min("distance").alias("distance"))
    near = folders.join(contains.select(F.col("src").alias("folder"), F.col("dst").alias("node")), "folder").groupBy("root", "node").agg((F.min("distance") + 1).alias("distance"))
    return near.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("confidence", F.lit(confidence))


def supersession(steps: DataFrame, hops: int = 30) -> DataFrame:
    """id, last, hops, cycle: where each item's chain of successors (id, superseded_by) ends.

    Chains are followed by doubling, so a chain of n links takes log2(n) joins; one of over ``2 ** hops`` links or without
    an end is a cycle, which has no last item.  The joins are sorted ones: chains of numbers are small as files, by which Spark would
    broadcast them, but not in the driver.
    """
    links = stage(steps.where("superseded_by IS NOT NULL").select("id", "superseded_by"), "successors")
    at = links.select("id", F.col("superseded_by").alias("last"), F.lit(1).cast("long").alias("hops"))
    n, most = links.count(), 1
    for _ in range(hops):
        to = at.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("hops").alias("more"))
        at = stage(at.join(to.hint("merge"), "last", "left").select("id", F.coalesce("further", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chains")
        most *= 2
        if most > n or at.join(links.select(F.col("id").alias("last")).hint("merge"), "last", "left_semi").isEmpty():
            break
    open_ = at.join(links.select(F.col("id").alias("last"), F.lit(True).alias("goes_on")).hint("merge"), "last", "left")
    cycle = F.coalesce("goes_on", F.lit(False))
    return open_.select("id", F.when(~cycle, F.col("last")).alias("last"), F.when(~cycle, F.col("hops")).alias("hops"), cycle.alias("cycle"))


def relations(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, other, kind, way, label: edges of the given nodes without those to themselves, each once; a node without a label is
    named by its key after the colon."""
    met = neighbourhood(edges.where("src <> dst"), nodes).distinct()
    name = F.coalesce("label", F.regexp_extract("other", "^[^:]*:(.*)$", 1))
    return met.join(labels.select(F.col("node").alias("other"), "label"), "other", "left").select("node", "other", "kind", "way", name.alias("label"))


def overview(files: DataFrame, overlay: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """path, scope, n_symbols, n_imports: visible files, an overlay's (path, status) before the committed ones, with their symbols
    and the different other visible files they import."""
    own = files.join(overlay, "path", "left_anti").select("path", F.lit("committed").alias("scope"))
    shown = own.unionByName(overlay.where("status <> 'deleted'").select("path", F.lit("overlay").alias("scope")))
    pairs = imports.where("src <> dst").select("src", "dst").distinct().join(shown.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_imports"))
    counts = symbols.groupBy("path").agg(F.count("*").alias("n_symbols"))
    return shown.join(counts, "path", "left").join(pairs, "path", "left").fillna(0, ["n_symbols", "n_imports"])


def capped_families(files: DataFrame, group: str, family: str, size: str, name: str, cap: int) -> DataFrame:
    """group, family, n_files, total: of each group the ``cap`` largest files, gathered by family."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(size), name))
    return files.withColumn("rank", rank).where(F.col("rank") <= cap).groupBy(group, family).agg(F.count("*").alias("n_files"), F.sum(size).alias("total"))


def outline(children: DataFrame, parent: str, name: str, size: str, most: int = 60) -> DataFrame:
    """parent, name, place, n_more: the largest ``most`` children of each folder, and a row without a name for how many more there are."""
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(size), name))
    ranked = children.withColumn("place", rank)
    shown = ranked.where(F.col("place") <= most).select(parent, name, "place", F.lit(0).cast("long").alias("n_more"))
    more = children.groupBy(parent).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return shown.unionByName(more.select(parent, F.lit(None).cast(children.schema[name].dataType).alias(name), F.lit(most + 1).alias("place"), (F.col("n") - most).alias("n_more")))
