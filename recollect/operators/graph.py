"""Graphs of files: centrality, neighbours, components, import resolution, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import content_hash
from recollect.plans.checkpoints import cut, dropped, stored

DAMPING, ITERATIONS, CUT_EVERY = 0.85, 20, 5


def centrality(edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, project: str = "project_id") -> DataFrame:
    """project, path, centrality: PageRank of each project's graph, a fixed number of rounds.

    Parallel edges count as often as they occur; what files without imports hold isn't passed on.
    """
    links = edges.select(project, F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    nodes = links.select(project, F.col("src").alias("path")).union(links.select(project, F.col("dst").alias("path"))).distinct()
    size = nodes.groupBy(project).agg(F.count(F.lit(1)).alias("n"))
    degree = links.groupBy(project, "src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = cut(links.groupBy(project, "src", "dst").agg(F.count(F.lit(1)).alias("times")).join(degree, [project, "src"]))
    base = cut(nodes.join(size, project).withColumn("start", 1.0 / F.col("n")))
    rank = base.select(project, "path", "n", F.col("start").alias("r"))
    for k in range(iterations):
        flow = weighted.join(rank.select(project, F.col("path").alias("src"), "r"), [project, "src"])
        gained = flow.groupBy(project, F.col("dst").alias("path")).agg(F.sum(F.col("r") * F.col("times") / F.col("degree")).alias("g"))
        rank = base.join(gained, [project, "path"], "left").select(project, "path", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if (k + 1) % CUT_EVERY == 0 and k + 1 < iterations:
            rank = cut(rank)
    return rank.select(project, "path", F.col("r").alias("centrality"))


def neighbours(edges: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, path: local files one import away, in either direction, from files (project_id, path)."""
    local = edges.where(~F.col("is_external"))
    out = local.join(files.withColumnRenamed("path", "from_path"), ["project_id", "from_path"], "left_semi").select("project_id", F.col("to_path").alias("path"))
    into = local.join(files.withColumnRenamed("path", "to_path"), ["project_id", "to_path"], "left_semi").select("project_id", F.col("from_path").alias("path"))
    return out.union(into).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: connected nodes with the smallest of them.

    Every node hangs on its smallest neighbour, if that is smaller, and is followed to the root
    of its tree; then links of roots take the place of links, so each round reads what the one
    before left.  What a round's nodes hang on is kept, and read backwards at the end.
    """
    spark = links.sparkSession
    edges = links.select(F.coalesce(a, b).alias("x"), F.coalesce(b, a).alias("y")).where("x is not null").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges, place = stored(edges)
    rounds: list[DataFrame] = []
    while not rounds or edges.limit(1).count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, at = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:  # twice as far each time
            own = hung.select(F.col("node").alias("root"), F.col("root").alias("further"))
            lower = hung.where("node <> root").join(own.where("root <> further"), "root")
            if not lower.limit(1).count():
                break
            further, beyond = stored(hung.join(own, "root").select("node", F.col("further").alias("root")))
            dropped(spark, at)
            hung, at = further, beyond
        rounds.append(hung)
        ends = edges.join(hung.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(hung.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v").where("ru <> rv")
        after, beyond = stored(ends.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())
        dropped(spark, place)
        edges, place = after, beyond
    label = rounds.pop().withColumnRenamed("root", "label")
    while rounds:
        of_root = label.withColumnRenamed("node", "root")
        label = rounds.pop().join(of_root, "root", "left").select("node", F.coalesce("label", "root").alias("label"))
    return label


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of imports (project_id, from_path, module) to the project's files (project_id, path).

    A module is looked for as a file, then below `src/`, then by its last name anywhere; of
    several, the first in order.  What isn't found is external and keeps its name.
    """
    as_path = F.replace("module", F.lit("."), F.lit("/"))
    places = F.array(F.concat(as_path, F.lit(".py")), F.concat(F.lit("src/"), as_path, F.lit(".py")))
    known = paths.select("project_id", "path", F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("stem")).distinct()
    asked = imports.distinct().withColumn("stem", F.element_at(F.split("module", r"\."), -1))
    exact = asked.select("*", F.posexplode(places).alias("rank", "path")).join(known.select("project_id", "path"), ["project_id", "path"])
    # of the files of one name, the first is enough: they are found before imports meet them
    named = known.where("stem <> ''").groupBy("project_id", "stem").agg(F.min("path").alias("path"))
    loose = asked.join(named, ["project_id", "stem"]).withColumn("rank", F.lit(9))
    cols = ["project_id", "from_path", "module"]
    best = exact.select(*cols, "rank", "path").unionByName(loose.select(*cols, "rank", "path")).groupBy(*cols).agg(F.min(F.struct("rank", "path")).alias("m"))
    found = F.col("m.path")
    out = asked.join(best, cols, "left")
    return out.select("project_id", "from_path", F.coalesce(found, "module").alias("to_path"), F.lit("imports").alias("edge_type"), found.isNull().alias("is_external")).distinct()


def cascade(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """Review events for the direct dependents of blocked or abandoned files; what came of a cascade starts none.

    statuses: id, project_id, session_id, path, status, cascaded_from, evidence_id; events: the
    project's active components with path and dependencies.
    """
    cause = statuses.where(F.col("status").isin("blocked", "abandoned") & F.col("cascaded_from").isNull() & (F.col("path") != ""))
    cause = cause.select("project_id", F.col("id").alias("cascaded_from"), "session_id", "evidence_id", F.col("path").alias("target"), F.col("status").alias("cause"))
    needs = events.where("event_type = 'COMPONENT_STATUS'").select("project_id", "path", F.explode(F.array_distinct("dependencies")).alias("target"))
    hit = needs.join(cause, ["project_id", "target"]).where("path <> '' and path <> target")
    said = F.format_string("%s needs_review cascade from %s", "path", "target")
    return hit.select(
        "project_id",
        "session_id",
        F.lit("COMPONENT_STATUS").alias("event_type"),
        "path",
        F.lit("needs_review").alias("status"),
        F.format_string("depends on %s which is %s", "target", "cause").alias("reason"),
        "cascaded_from",
        "evidence_id",
        content_hash(F.lit("COMPONENT_STATUS"), said).alias("content_hash"),
        F.lit(0.6).alias("weight"),
    )
