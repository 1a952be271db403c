"""Impact of changes: who calls, imports and depends on the targets, which of that are tests, and the risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import graph, measures

CALLS, IMPORTS = ["calls", "references"], ["imports"]


def reached(edges: DataFrame, targets: DataFrame, depth: int = 3, least: float = graph.LEAST_CONFIDENCE) -> DataFrame:
    """root, relation, node, distance, confidence: callers of symbols, dependents of files, and importers of the symbols' files.

    targets (root, node, path, is_file, file): the symbols and files of each change, and the node of the file that holds a symbol.
    Each relation is one walk for all changes.
    """
    symbols, files = targets.where("NOT is_file"), targets.where("is_file")
    behind = symbols.select("root", F.col("file").alias("node")).distinct().join(files.select("root", "node"), ["root", "node"], "left_anti")
    of_kind = lambda kinds: edges.where(F.col("kind").isin(kinds))
    walks = {
        "callers": (CALLS, symbols.select("root", "node")), "dependents": (IMPORTS, files.select("root", "node")), "importers": (IMPORTS, behind)
    }
    out = None
    for name, (kinds, start) in walks.items():
        own = graph.walk(of_kind(kinds), start.distinct(), depth, "in", least).where("distance > 0").select("root", F.lit(name).alias("relation"), "node", "distance", "confidence")
        out = own if out is None else out.unionByName(own)
    return out


def analyze(edges: DataFrame, targets: DataFrame, nodes: DataFrame, paths: DataFrame, depth: int = 3, weak: float = 0.6) -> DataFrame:
    """root, n_callers, n_dependents, n_importers, blast, n_tests, tests_missing, points, risk: one row for each change.

    nodes (node, path); paths (path, is_code, is_test, is_schema, is_security).  Consumers are the paths of callers and dependents
    that are not targets themselves; importing the file of a symbol isn't using the symbol, so importers give tests only.  Edges
    under ``weak`` count as weak.  A change none of whose targets is a node is of MEDIUM risk without points: unknown is not safe.
    """
    known = stage(targets.join(nodes.select("node").distinct(), "node", "left_semi"), "targets")
    entries = stage(reached(edges, known, depth).join(nodes, "node"), "entries")
    own = known.select("root", "path").distinct()
    met = entries.groupBy("root", "path").agg(F.bool_or(F.col("relation") != "importers").alias("consumes"))
    others = met.join(own, ["root", "path"], "left_anti").join(paths, "path", "left")
    mine = own.join(paths, "path", "left").groupBy("root").agg(
        F.bool_or(F.coalesce("is_security", F.lit(False))).alias("security"), F.bool_or(F.coalesce("is_schema", F.lit(False))).alias("schema"), F.bool_or(F.coalesce("is_code", F.lit(False)) & ~F.coalesce("is_test", F.lit(False))).alias("code")
    )
    counts = entries.groupBy("root").agg(*(F.count_if(F.col("relation") == r).alias(f"n_{r}") for r in ("callers", "dependents", "importers")), F.count_distinct(F.when((F.col("relation") != "importers") & (F.col("confidence") < weak), F.col("path"))).alias("weak_files"))
    around = others.groupBy("root").agg(
        F.count_if("consumes").alias("blast"), F.count_if("is_test").alias("n_tests"), F.bool_or(F.col("consumes") & F.col("is_security")).alias("exposed"), F.bool_or(F.col("consumes") & F.col("is_schema")).alias("scripts")
    )
    lost = targets.join(nodes.select("node").distinct(), "node", "left_anti").groupBy("root").agg(F.count("*").alias("unresolved"))
    rows = targets.select("root").distinct().join(mine, "root", "left").join(counts, "root", "left").join(around, "root", "left").join(lost, "root", "left")
    resolved = F.col("code").isNotNull()
    rows = rows.withColumn("resolved", resolved).fillna(False, ["security", "schema", "code", "exposed", "scripts"]).fillna(0)
    none, no = F.lit(0), F.lit(False)
    rows = rows.withColumn("tests_missing", F.col("code") & (F.col("n_tests") == 0)).withColumn("untested", F.col("tests_missing"))
    rated = measures.risk_points(rows.withColumns({"contract": no, "routes": no, "fixes": none, "rules": none}))
    points, risk = F.when(F.col("resolved"), F.col("points")), F.when(F.col("resolved"), F.col("risk")).otherwise("MEDIUM")
    return rated.select("root", "n_callers", "n_dependents", "n_importers", "blast", "n_tests", "tests_missing", points.alias("points"), risk.alias("risk"))
