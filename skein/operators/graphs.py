"""Bounded operators on typed edges (src, dst, kind, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import Workspace, union

from .ranking import top_per_key


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a loop counts once. Ends are counted before the shuffle."""
    ends = edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return top_per_key(edges, "src", [F.desc("confidence"), F.col("dst"), F.col("kind")], k)


#: Which edges a policy follows, and which way.
POLICIES = {
    "outgoing": (("calls", "imports", "route_handled_by"), "outgoing"),
    "incoming": (("calls", "references", "tests", "implements"), "incoming"),
    "opportunistic": (("calls", "references", "imports", "changed_with"), "both"),
    "dataflow": (("calls", "references", "imports"), "both"),
}
class Edges:
    """Edges (src, dst, kind, confidence) to be asked for by either end; here without any order."""

    def __init__(self, edges: DataFrame):
        self.spark, self.by_src, self.by_dst = edges.sparkSession, edges, edges

    def leaving(self, nodes: list[str], direction: str, *columns: str) -> DataFrame:
        """(at, to, kind, confidence, forward) of the edges at a few nodes, whose names reach the scan as a filter."""
        names, parts = list(columns) or ["kind", "confidence"], []
        if direction != "incoming":
            parts.append(self.by_src.where(F.col("src").isin(nodes)).select(F.col("src").alias("at"), F.col("dst").alias("to"), *names, F.lit(True).alias("forward")))
        if direction != "outgoing":
            parts.append(self.by_dst.where(F.col("dst").isin(nodes)).select(F.col("dst").alias("at"), F.col("src").alias("to"), *names, F.lit(False).alias("forward")))
        return union(*parts)

    def degrees(self, nodes: list[str]) -> DataFrame:
        """(at, degree) of a few nodes; a loop counts once."""
        return self.leaving(nodes, "both", "kind").where("forward OR at <> to").groupBy("at").agg(F.count("*").alias("degree"))

    def incoming(self, nodes: DataFrame, few: int = 10_000) -> DataFrame:
        """The edges that end at nodes (column ``node``): by a broadcast if these are few, else by a shuffle of the edges."""
        wanted = nodes.select(F.col("node").alias("dst")).distinct()
        return self.by_dst.join(F.broadcast(wanted) if wanted.count() <= few else wanted, "dst", "left_semi")


class SortedEdges(Edges):
    """The same from tables that are sorted by source, by target and, for degrees, by node: a few nodes read a few pages.

    A table may be given as a function, which is called when the table is first read.
    """

    def __init__(self, by_src, by_dst, degree, spark=None):
        self.spark, self._tables = spark or by_src.sparkSession, {"src": by_src, "dst": by_dst, "degree": degree}

    def _table(self, name: str) -> DataFrame:
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    by_src, by_dst, degree = (property(lambda self, name=name: self._table(name)) for name in ("src", "dst", "degree"))

    def degrees(self, nodes: list[str]) -> DataFrame:
        return self.degree.where(F.col("node").isin(nodes)).select(F.col("node").alias("at"), "degree")


def _edges(edges: DataFrame | Edges) -> Edges:
    return edges if isinstance(edges, Edges) else Edges(edges)


def neighbours(edges: DataFrame | Edges, nodes: list[str], direction: str = "both", k: int = 24) -> DataFrame:
    """The ``k`` strongest edges of each of a few nodes (``at``), whichever way they go; equal ones count once."""
    rows = _edges(edges).leaving(nodes, direction).drop("forward")
    rows = rows.distinct() if direction == "both" else rows
    return top_per_key(rows, "at", [F.desc("confidence"), F.col("to"), F.col("kind")], k).drop("place")


def expand(edges: DataFrame | Edges, seeds: DataFrame, kinds: list[str], hops: int = 2, per_seed: int = 24, frontier: int = 4, direction: str = "both", starts: int = 5) -> DataFrame:
    """(node, hop, score): damped expansion from the ``starts`` best seeds (node, score).

    A step takes the ``per_seed`` strongest edges of each node it starts from, of these the given kinds, and divides what
    it passes on by the degree of the node it reaches, so that hubs don't flood the next step. That starts from the
    ``frontier`` best arrivals above 0.001; a node that arrives twice takes two places, and none is started from
    twice. Only names of nodes to start from are on the driver, ``starts`` or ``frontier`` of them.
    """
    graph = _edges(edges)
    space = Workspace(graph.spark, "walk")
    front = [(r.node, r.score) for r in seeds.orderBy(F.desc("score"), "node").limit(starts).collect()]
    visited, found = set(), []
    for hop in range(hops):
        places = {}
        for node, score in front:
            if node not in visited and node not in places:
                places[node] = (len(places), score)
        if not places:
            break
        visited |= set(places)
        passed = F.create_map(*[F.lit(x) for node, (_, score) in places.items() for x in (node, float(score))])
        place = F.create_map(*[F.lit(x) for node, (n, _) in places.items() for x in (node, n)])
        reached = neighbours(graph, list(places), direction, per_seed).where(F.col("kind").isin(*kinds))
        reached = space.table(reached.withColumn("passed", passed[F.col("at")]).withColumn("place", place[F.col("at")]), f"reached-{hop}")
        # at most ``per_seed`` nodes for each node of the frontier
        degree = graph.degrees([r.to for r in reached.select("to").distinct().collect()]).withColumnRenamed("at", "to")
        spread = F.col("passed") * F.col("confidence") * 0.5**hop / (1 + F.log(F.greatest("degree", F.lit(1))))
        arrived = space.table(reached.join(F.broadcast(degree), "to").select("to", "place", "confidence", "kind", F.round(spread, 9).alias("score")), f"arrived-{hop}")
        found.append(arrived.groupBy(F.col("to").alias("node")).agg(F.max("score").alias("score")).select("node", F.lit(hop + 1).cast("long").alias("hop"), "score"))
        best = arrived.orderBy(F.desc("score"), "place", F.desc("confidence"), "to", "kind").limit(frontier)
        front = [(r.to, r.score) for r in best.collect() if r.score > 0.001]
    if not found:
        return graph.spark.createDataFrame([], "node string, hop long, score double")
    return union(*found)


def expand_by(policy: str, edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    kinds, direction = POLICIES[policy]
    return expand(edges, seeds, list(kinds), direction=direction, **options)


#: How much mass an edge of a kind carries forwards and backwards.
CONDUCTANCE = {
    "route_handled_by": (0.9, 0.3), "calls": (0.8, 0.5), "imports": (0.7, 0.35), "tests": (0.6, 0.6),
    "references": (0.5, 0.4), "contains": (0.3, 0.9), "changed_with": (0.4, 0.4), "build_depends_on": (0.25, 0.15),
}


def _universe(edges: Edges, nodes: list[str], k: int) -> DataFrame:
    """(src, dst, kind, confidence): the ``k`` strongest edges of each node in each direction, each once."""
    parts = []
    for direction in ("outgoing", "incoming"):
        rows = neighbours(edges, nodes, direction, k)
        at, to = ("src", "dst") if direction == "outgoing" else ("dst", "src")
        parts.append(rows.select(F.col("at").alias(at), F.col("to").alias(to), "kind", "confidence"))
    return union(*parts).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def mass_flow(edges: DataFrame | Edges, seeds: DataFrame, per_node: int = 64, receivers: int = 16, most: int = 32) -> DataFrame:
    """(node, mass, senders): what seeds (node, mass) deliver in two hops, without turning back on an edge.

    The edges are those of at most ``most`` seeds and, for the second hop, of the ``receivers`` that got most
    in the first; ``per_node`` each way. So few rows flow however large the graph is, and only the search for
    these edges reads it. ``senders`` counts the seeds a node got mass from.
    """
    pairs = [(f"{kind}{way}", w) for kind, both in CONDUCTANCE.items() for way, w in zip("><", both)]
    weight = F.create_map(*[F.lit(x) for pair in pairs for x in pair])

    def shares(universe):
        keyed = universe.withColumn("edge", F.concat_ws("\x1f", "src", "dst", "kind"))
        ways = union(
            keyed.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.concat("kind", F.lit(">")).alias("way"), "confidence", "edge"),
            keyed.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.concat("kind", F.lit("<")).alias("way"), "confidence", "edge"),
        )
        total = ways.groupBy("at", "way").agg(F.sum("confidence").alias("total"))
        return ways.join(total, ["at", "way"]).select("at", "to", "edge", (weight[F.col("way")] * F.col("confidence") / F.col("total")).alias("share")).where("share > 0")

    # small written tables, so that no step is computed twice; the few nodes that edges are asked for are on the driver
    graph = _edges(edges)
    space = Workspace(graph.spark, "flow")
    start = [(r.node, float(r.mass)) for r in seeds.orderBy(F.desc("mass"), "node").limit(most).collect()]
    if not start:
        return graph.spark.createDataFrame([], "node string, mass double, senders long")
    names = [n for n, _ in start]
    mass = F.create_map(*[F.lit(x) for pair in start for x in pair])
    first = space.table(_universe(graph, names, per_node), "first")
    one = shares(first).where(F.col("at").isin(names)).select(F.col("at").alias("seed"), F.col("to").alias("at"), "edge", (mass[F.col("at")] * F.col("share")).alias("mass"))
    one = space.table(one, "one")
    got = one.where(~F.col("at").isin(names)).groupBy("at").agg(F.sum("mass").alias("m"))
    best = [r.at for r in got.orderBy(F.desc(F.round("m", 9)), "at").limit(receivers).collect()]
    both = union(first, _universe(graph, best, per_node)).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence")) if best else first
    two = one.withColumnRenamed("edge", "last").join(shares(both), "at").where("last <> edge").select("seed", F.col("to").alias("at"), (F.col("mass") * F.col("share")).alias("mass"))
    out = union(one.select("seed", "at", (F.col("mass") * 0.5).alias("mass")), two.withColumn("mass", F.col("mass") * 0.25))
    return out.groupBy(F.col("at").alias("node")).agg(F.round(F.sum("mass"), 9).alias("mass"), F.countDistinct("seed").alias("senders"))


def impact(edges: DataFrame | Edges, start: DataFrame, kinds: list[str], hops: int = 2, per_node: int = 256) -> DataFrame:
    """(node, hops, confidence): who depends on the start nodes, by least hops and then by the strongest edge.

    Of each node the ``per_node`` strongest incoming edges count. A step looks at the edges of its nodes only.
    """
    graph = _edges(edges)
    space = Workspace(graph.spark, "impact")
    front, found = start.select("node"), [start.select("node", F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("confidence"))]
    for hop in range(1, hops + 1):
        reached = graph.incoming(front).where(F.col("kind").isin(*kinds)).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
        reached = top_per_key(reached, "dst", [F.desc("confidence"), F.col("src")], per_node)
        step = space.table(reached.groupBy(F.col("src").alias("node")).agg(F.max("confidence").alias("confidence")), f"hop-{hop}")
        found.append(step.select("node", F.lit(hop).cast("long").alias("hops"), "confidence"))
        front = step.select("node")
    best = union(*found).groupBy("node").agg(F.min(F.struct("hops", (-F.col("confidence")).alias("c"))).alias("b"))
    return best.select("node", "b.hops", (-F.col("b.c")).alias("confidence")).where("hops > 0")


def references(edges: DataFrame | Edges, node: str, kinds: list[str], cap: int = 256) -> DataFrame:
    """(src, kind, confidence, truncated): what refers to a node, the strongest first; ``truncated`` says that there is more."""
    rows = _edges(edges).by_dst.where((F.col("dst") == node) & F.col("kind").isin(*kinds))
    top = rows.orderBy(F.desc("confidence"), "src", "kind").limit(cap + 1)
    place = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("confidence"), "src", "kind"))  # at most ``cap`` rows and one
    placed = top.withColumn("place", place).withColumn("truncated", F.count("*").over(Window.partitionBy("dst")) > cap)
    return placed.where(F.col("place") <= cap).select("src", "kind", "confidence", "truncated")


def components_explained(edges: DataFrame) -> DataFrame:
    """(component, members, dependencies, dependents, tests), each sorted and distinct, of all that contain something."""
    out = edges.select(F.col("src").alias("component"), F.col("dst").alias("other"), F.when(F.col("kind") == "contains", "members").when(F.col("kind").isin("build_depends_on", "imports"), "dependencies").alias("role"))
    back = edges.select(F.col("dst").alias("component"), F.col("src").alias("other"), F.when(F.col("kind").isin("build_depends_on", "imports", "calls"), "dependents").when(F.col("kind") == "tests", "tests").alias("role"))
    # pairs are made distinct before they are collected
    rows = union(out, back).where("role IS NOT NULL").distinct()
    roles = ("members", "dependencies", "dependents", "tests")
    got = rows.groupBy("component").agg(*[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("other")))).alias(r) for r in roles])
    return got.where(F.size("members") > 0)


def package_map(packages: DataFrame, depends: DataFrame, members: DataFrame) -> DataFrame:
    """(package, dependencies, dependents, member_files) from (package), (package, other) and (package, path)."""
    names = packages.select("package")
    known = depends.distinct().join(names, "package", "left_semi").join(names.withColumnRenamed("package", "other"), "other", "left_semi")
    out = known.groupBy("package").agg(F.array_sort(F.collect_list("other")).alias("dependencies"))
    back = known.groupBy(F.col("other").alias("package")).agg(F.array_sort(F.collect_list("package")).alias("dependents"))
    files = members.groupBy("package").agg(F.count("*").alias("member_files"))
    none = F.array().cast("array<string>")
    rows = names.join(out, "package", "left").join(back, "package", "left").join(files, "package", "left")
    return rows.select("package", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"), F.coalesce("member_files", F.lit(0)).alias("member_files"))


#: Which edge counts as the better pointer at equal confidence.
POINTERS = {"tests": 2, "calls": 1, "references": 0}


def backlinks(hits: DataFrame, entities: DataFrame, edges: DataFrame, sources: int = 8, per_source: int = 16, emit: int = 4) -> DataFrame:
    """(query_id, source, target, kind, confidence, place): what the first callable hits point at beyond the hits.

    Of each source the ``per_source`` strongest outgoing edges count; the best edge to a target stands for it;
    a source gives one target, a target goes to its first source, and ``emit`` are given per query.
    """
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    top = hits.where("path IS NOT NULL").withColumn("n", first).where(F.col("n") <= sources)
    top = top.join(entities.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    asked = top.select(F.col("entity_id").alias("src")).distinct()
    out = top_per_key(edges.join(asked, "src", "left_semi"), "src", [F.desc("confidence"), F.col("id")], per_source)
    order = F.lit(-1)
    for kind, rank in POINTERS.items():
        order = F.when(F.col("kind") == kind, rank).otherwise(order)
    out = out.withColumn("pointer", order).where("pointer >= 0")
    best = out.groupBy("src", "dst").agg(F.max(F.struct("confidence", "pointer", "kind")).alias("b"))
    rows = top.select("query_id", "n", F.col("entity_id").alias("src")).join(best, "src").select("query_id", "n", "src", F.col("dst").alias("entity_id"), "b.*")
    rows = rows.join(hits.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
    rows = top_per_key(rows.withColumn("key", F.concat_ws("/", "query_id", "src")), "key", [F.desc("confidence"), F.desc("pointer"), F.col("entity_id"), F.col("n")], 1).drop("place", "key")
    once = rows.groupBy("query_id", "entity_id").agg(F.min(F.struct("n", "src", "kind", "confidence")).alias("r")).select("query_id", "entity_id", "r.*")
    placed = top_per_key(once, "query_id", [F.col("n")], emit)
    return placed.select("query_id", F.col("src").alias("source"), F.col("entity_id").alias("target"), "kind", "confidence", "place")


def evidence_paths(edges: DataFrame | Edges, seeds: DataFrame, k: int = 24, starts: int = 64, middles: int = 64) -> DataFrame:
    """(node, path): the strongest way of at most two edges from a seed to each node, as text; ties go by the text.

    The first ``starts`` seeds by name and the ``middles`` nodes of the strongest first edges are walked from: both bounds are what a
    caller shows at most, and their names are on the driver.
    """
    graph = _edges(edges)
    names = [r.node for r in seeds.select("node").distinct().orderBy("node").limit(starts).collect()]
    hop = F.concat(F.col("at"), F.lit(" -"), F.col("kind"), F.lit("-> "), F.col("to"))
    space = Workspace(graph.spark, "paths")
    first = space.table(neighbours(graph, names, "outgoing", k).select(F.col("to").alias("node"), F.col("confidence").alias("s"), hop.alias("path")), "first")
    mid = first.groupBy("node").agg(F.min(F.struct((-F.col("s")).alias("s"), "path")).alias("b")).orderBy("b", "node").limit(middles)
    mid = space.table(mid.select(F.col("node").alias("at"), "b.path", (-F.col("b.s")).alias("s")), "mid")
    two = neighbours(graph, [r.at for r in mid.select("at").collect()], "outgoing", k).join(F.broadcast(mid), "at")  # at most ``middles`` rows
    second = two.select(F.col("to").alias("node"), (F.col("s") * F.col("confidence")).alias("s"), F.concat("path", F.lit(" -"), "kind", F.lit("-> "), "to").alias("path"))
    rows = union(first, second).where(~F.col("node").isin(names))
    return rows.groupBy("node").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "path")).alias("b")).select("node", "b.path", (-F.col("b.s")).alias("strength"))


def co_change(changes: DataFrame, partners: int = 8, most_paths: int = 512) -> DataFrame:
    """(a, b, support, confidence) from (commit, path): pairs that either end ranks among its best partners.

    A commit of more than ``most_paths`` paths, a rename or reformat of everything, says nothing about any two of
    them and counts nowhere; so a commit gives a bounded number of pairs.
    """
    once = changes.distinct()
    small = once.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= most_paths).select("commit")
    once = once.join(small, "commit", "left_semi")
    apps = once.groupBy("path").agg(F.count("*").alias("n"))
    x, y = once.select("commit", F.col("path").alias("a")), once.select("commit", F.col("path").alias("b"))
    pairs = x.join(y, "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support"))
    pairs = pairs.join(apps.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(apps.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    conf = F.least(F.lit(0.7), F.col("support") / F.greatest("na", "nb"))
    pairs = pairs.select("a", "b", "support", F.round(conf, 9).alias("confidence"))
    ra = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("support"), F.desc("confidence"), "b"))
    rb = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("support"), F.desc("confidence"), "a"))
    return pairs.withColumn("ra", ra).withColumn("rb", rb).where((F.col("ra") <= partners) | (F.col("rb") <= partners)).drop("ra", "rb")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, package): the longest root that is the path or a folder above it. Joined on exploded prefixes, not on a range."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = paths.select("path", F.explode(prefixes).alias("root"))
    return above.join(roots, "root").groupBy("path").agg(F.max_by("package", F.length("root")).alias("package"))


def _crossing(edges: DataFrame, owned: DataFrame, declared: DataFrame) -> DataFrame:
    a = owned.select(F.col("path").alias("src"), F.col("package").alias("package"))
    b = owned.select(F.col("path").alias("dst"), F.col("package").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("package <> other").join(declared, ["package", "other"], "left_anti")


def boundary_violations(edges: DataFrame, owned: DataFrame, declared: DataFrame) -> DataFrame:
    """(package, other, edges): edges across packages that no declared dependency covers; every edge counts."""
    return _crossing(edges, owned, declared).groupBy("package", "other").agg(F.count("*").alias("edges"))


def violation_list(edges: DataFrame, owned: DataFrame, declared: DataFrame, cap: int = 256) -> DataFrame:
    """(package, other, src, dst): the violating pairs, each once, the first ``cap`` in order."""
    rows = _crossing(edges, owned, declared).select("package", "other", "src", "dst").distinct()
    return rows.orderBy("package", "other", "src", "dst").limit(cap)


def containment(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst): repository to top folder, folder to folder, folder to file, file to unit; each edge once."""
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("src"), F.element_at("p", i + 1).alias("dst")))
    folders = files.select(places.alias("p")).select(F.explode(steps).alias("e")).select("e.src", "e.dst").distinct()
    return folders.unionByName(units.select(F.concat(F.lit("/"), "path").alias("src"), F.col("unit").alias("dst")).distinct())


def build_edges(packages: DataFrame, needs: DataFrame) -> DataFrame:
    """(package, other): declared dependencies on packages of the workspace itself, from (package, name)."""
    return needs.join(packages.select(F.col("package").alias("name")), "name", "left_semi").where("package <> name").select("package", F.col("name").alias("other")).distinct()


def lineage_roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent): follows parents by doubling until nothing moves.

    A parent that is no node is a root itself. Each round is a written table, and only nodes
    that haven't met their root are joined again. A cycle raises an error.
    """
    spark = parents.sparkSession
    space = Workspace(spark, "lineage")
    known = parents.select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNull().alias("done"))
    known = space.table(known, "round-0")
    most = known.count().bit_length() + 1
    for i in range(1, most + 1):
        if known.where("NOT done").isEmpty():
            return known.select("node", "root")
        up = known.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("done").alias("last"))
        moved = known.where("NOT done").join(up, "root", "left")
        moved = moved.select("node", F.coalesce("next", "root").alias("root"), F.coalesce("last", F.lit(True)).alias("done"))
        known = space.table(known.where("done").unionByName(moved), f"round-{i}")
        space.drop(f"round-{i - 1}")
    raise ValueError("parents form a cycle")
