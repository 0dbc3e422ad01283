"""Import graphs: edges, resolution, in-degree and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.text import directory, lines_of
from lodeglass.operators.parse import imports
from lodeglass.session import cut_lineage

# Endings under which an import is looked for, in this order.
CANDIDATES = [".ts", ".tsx", ".js", ".jsx", ".py"]


def import_edges(files: DataFrame, keys: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """(keys, position, target): the imports of each file, repeats kept."""
    found = files.where(F.col(content).isNotNull()).select(*keys, F.posexplode(imports(lines_of(content), F.col(language))).alias("_p", "target"))
    return found.select(*keys, (F.col("_p") + 1).alias("position"), "target")


def in_degree(edges: DataFrame, target: str = "target") -> DataFrame:
    """(target, degree), repeats counted."""
    return edges.groupBy(target).agg(F.count(F.lit(1)).alias("degree"))


def most_imported(edges: DataFrame, target: str = "target", limit: int = 20) -> DataFrame:
    return in_degree(edges, target).orderBy(F.col("degree").desc(), target).limit(limit)


def sources_of(edges: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    """(target, source), each once: a target that everybody imports fills many rows, not one."""
    return edges.select(target, F.col(source).alias("source")).distinct()


def imported_by(edges: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    """(target, sources): who imports it, each once, in order; one row per target, so for targets of few sources only."""
    return edges.groupBy(target).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def nodes(edges: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    return edges.select(F.col(source).alias("node")).union(edges.select(F.col(target).alias("node"))).distinct()


def file_links(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): imports that lead from file to file, each as ``root/path``, once."""
    to = resolved(edges, files)
    return to.select(F.concat_ws("/", "root", "path").alias("src"), F.concat_ws("/", "root", "file").alias("dst")).distinct()


def file_graph(edges: DataFrame, files: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, level, imports, imported_by): the files within `depth` imports of the `start` files (node).

    `imports` counts a node's import lines, `imported_by` the nodes of the
    graph that lead to it.
    """
    links = cut_lineage(file_links(edges, files))
    found = reachable(links, start, depth)
    out = edges.groupBy(F.concat_ws("/", "root", "path").alias("node")).agg(F.count(F.lit(1)).alias("imports"))
    # the deepest nodes' own imports aren't followed
    inner = links.join(found.where(F.col("level") < depth).select(F.col("node").alias("src")), "src", "left_semi")
    into = inner.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("imported_by"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return found.join(out, "node", "left").join(into, "node", "left").select("node", "level", zero("imports"), zero("imported_by"))


def project_nodes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node, imports, imported_by) of all files, as ``root/path``, and of all modules as they are written; repeats counted."""
    named = edges.select(F.concat_ws("/", "root", "path").alias("src"), "target")
    each = files.select(F.concat_ws("/", "root", "path").alias("node"), F.lit(0).alias("o"), F.lit(0).alias("i"))
    each = each.unionAll(named.select("src", F.lit(1), F.lit(0))).unionAll(named.select("target", F.lit(0), F.lit(1)))
    return each.groupBy("node").agg(F.sum("o").alias("imports"), F.sum("i").alias("imported_by"))


def _normal(path):
    """A path without ``.`` and ``..`` steps."""
    empty = F.array().cast("array<string>")

    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0)
        return F.when((part == "") | (part == "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolved(edges: DataFrame, files: DataFrame, script_suffix: bool = True) -> DataFrame:
    """(root, path, target, file): relative imports with the file of the same root that they mean.

    The endings are tried in order, then the same as an index of a folder.
    With `script_suffix`, an import that names a ``.js`` file may also mean
    the TypeScript source of that name.
    """
    relative = edges.where(F.col("target").startswith(".")).select("root", "path", "target").distinct()
    base = _normal(F.concat_ws("/", directory("path"), "target"))
    options = [F.concat(base, F.lit(e)) for e in CANDIDATES] + [F.concat(base, F.lit(f"/index{e}")) for e in CANDIDATES]
    if script_suffix:
        bare = F.regexp_replace(base, r"\.(?:js|jsx|mjs)$", "")
        options += [F.when(base != bare, F.concat(bare, F.lit(e))) for e in (".ts", ".tsx")] + [F.when(base != bare, base)]
    tried = relative.select("root", "path", "target", F.posexplode(F.array(*options)).alias("_p", "file")).where("file IS NOT NULL")
    there = files.select("root", F.col("path").alias("file")).distinct()
    hits = tried.join(there, ["root", "file"])
    return hits.groupBy("root", "path", "target").agg(F.min_by("file", "_p").alias("file"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 2, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, level): nodes within `depth` steps of the `start` nodes (node), each at its least level.

    A level is one join of the newly found nodes with the edges; nodes seen
    before are taken out by an anti-join. Each level is cut from the one
    before, so that the plan doesn't grow.
    """
    seen = cut_lineage(start.select("node").distinct().withColumn("level", F.lit(0)))
    front = seen
    links = edges.select(F.col(source).alias("_s"), F.col(target).alias("_d"))
    for level in range(1, depth + 1):
        step = front.join(links, front["node"] == links["_s"]).select(F.col("_d").alias("node")).distinct()
        front = cut_lineage(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return seen
