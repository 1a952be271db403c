"""Descriptions of web interfaces as tables of operations, and what a new version breaks; structures of XML documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outline import tags

# fixed values: methods of an interface, in the order they are told
METHODS = "get put post delete patch head options".split()
SPEC = "openapi string, swagger string, info struct<title:string,version:string>, paths map<string,string>, components struct<schemas:map<string,string>,securitySchemes:map<string,string>>, definitions map<string,string>, securityDefinitions map<string,string>"
PARAMETERS = "array<struct<name:string,required:boolean>>"
OPERATION = f"deprecated boolean, parameters {PARAMETERS}, responses map<string,string>"


def read_specs(specs: DataFrame) -> DataFrame:
    """name and spec of JSON texts (name, text) that describe an interface; other texts and nulls are left out."""
    read = specs.select("name", F.from_json("text", SPEC).alias("spec"))
    return read.where(F.coalesce("spec.openapi", "spec.swagger").isNotNull() | F.col("spec.paths").isNotNull())


def operations(specs: DataFrame) -> DataFrame:
    """name, operation, parameters (a map of name to required), responses (sorted), deprecated: a row for each method of each path.

    A method's own parameters come over the path's of the same name.  Items that aren't objects are no paths.
    """
    items = read_specs(specs).select("name", F.explode("spec.paths").alias("path", "item")).withColumn("item", F.from_json("item", "map<string,string>"))
    each = items.where(F.col("item").isNotNull()).select("name", "path", F.from_json(F.col("item")["parameters"], PARAMETERS).alias("shared"), F.explode("item").alias("method", "body"))
    own = each.where(F.col("method").isin(*METHODS) & F.col("body").startswith("{")).withColumn("op", F.from_json("body", OPERATION))
    none = F.array().cast(PARAMETERS)
    entries = F.transform(F.filter(F.concat(F.coalesce("shared", none), F.coalesce("op.parameters", none)), lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"].alias("key"), F.coalesce(p["required"], F.lit(False)).alias("value")))
    # of equal names the last counts
    last = F.filter(entries, lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == p["key"]))
    responses = F.array_sort(F.map_keys(F.coalesce("op.responses", F.create_map().cast("map<string,string>"))))
    return own.select("name", F.concat(F.upper("method"), F.lit(" "), "path").alias("operation"), F.map_from_entries(last).alias("parameters"), responses.alias("responses"), F.coalesce("op.deprecated", F.lit(False)).alias("deprecated"))


def summaries(specs: DataFrame) -> DataFrame:
    """name, title, version, operations, paths, schemas, auth_schemes (sorted)."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    read = read_specs(specs)
    n = operations(specs).groupBy("name").agg(F.count("*").alias("operations"))
    schemas, auth = F.coalesce("spec.components.schemas", "spec.definitions"), F.coalesce("spec.components.securitySchemes", "spec.securityDefinitions")
    told = read.select("name", "spec.info.title", "spec.info.version", F.when(F.col("spec.paths").isNotNull(), count("spec.paths")).otherwise(0).alias("paths"), F.when(schemas.isNotNull(), count(schemas)).otherwise(0).alias("schemas"), F.array_join(F.array_sort(F.map_keys(auth)), ",").alias("auth_schemes"))
    return told.join(n, "name", "left").withColumn("operations", F.coalesce("operations", F.lit(0)))


def breaking(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change, operation, detail of interfaces in both tables: operations added and removed, and what breaks callers besides:
    parameters that are now required, responses that are gone."""
    both = read_specs(old).select("name").join(read_specs(new).select("name"), "name", "left_semi")
    a, b = (operations(x.join(both, "name", "left_semi")) for x in (old, new))
    met = a.select("name", "operation", F.col("parameters").alias("p0"), F.col("responses").alias("r0")).join(b.select("name", "operation", F.col("parameters").alias("p1"), F.col("responses").alias("r1")), ["name", "operation"], "full")
    gone = F.when(F.col("p1").isNull(), F.array(F.struct(F.lit("removed").alias("change"), F.lit("").alias("detail"))))
    made = F.when(F.col("p0").isNull(), F.array(F.struct(F.lit("added").alias("change"), F.lit("").alias("detail"))))
    needed = F.filter(F.map_keys("p1"), lambda k: F.element_at("p1", k) & ~F.coalesce(F.try_element_at("p0", k), F.lit(False)))
    told = lambda rows, change: F.transform(rows, lambda x: F.struct(F.lit(change).alias("change"), x.alias("detail")))
    changed = F.concat(told(needed, "required"), told(F.array_except("r0", "r1"), "response"))
    return met.select("name", "operation", F.explode(F.coalesce(gone, made, changed)).alias("x")).select("name", "x.change", "operation", "x.detail")


STRUCTURE = "path string, status string, root string, elements bigint, max_depth int, top_level array<string>, counts map<string,bigint>"


def _structure(text: str) -> tuple:
    """A stack of open tags; what isn't closed in order is no XML.  Memory grows with the depth and the different names."""
    if "<!entity" in text.lower():
        return "refused", None, 0, 0, [], []
    counts: Counter[str] = Counter()
    stack: list[str] = []
    root, depth, top = None, 0, []
    for _, closing, name, attributes in tags(text, bare=True):
        if closing:
            if not stack or stack.pop() != name:
                return "malformed", None, 0, 0, [], []
            continue
        if not stack and root is not None:
            return "malformed", None, 0, 0, [], []
        counts[name] += 1
        depth = max(depth, len(stack) + 1)
        if not stack:
            root = name
        elif len(stack) == 1:
            top.append(name)
        if not attributes.endswith("/"):
            stack.append(name)
    if stack or root is None:
        return "malformed", None, 0, 0, [], []
    return "read", root, sum(counts.values()), depth, top, sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))


def xml_structures(files: DataFrame) -> DataFrame:
    """path, status, root, elements, max_depth, top_level, counts of XML texts (path, text).

    status: ``read``; ``refused`` with entity declarations, which are never expanded; ``malformed`` where tags don't close in order or
    there isn't one root.  A null text is malformed.  One Arrow pass, a text at a time.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.int64())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_structure(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], [f.split()[0] for f in ("path s", "status s", "root s", "elements s", "max_depth s", "top_level s", "counts s")])

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(step, STRUCTURE)
