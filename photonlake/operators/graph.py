"""Connected groups of files and their masters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.plans.storage import kept


def valid_edges(edges: DataFrame, masters: DataFrame) -> DataFrame:
    """Edges (file_name, target) that are checked, not to oneself, and between two masters (file_name)."""
    names = masters.select("file_name")
    good = edges.filter("checked AND target IS NOT NULL AND target <> file_name").select("file_name", "target")
    return good.join(names, "file_name", "left_semi").join(names.withColumnRenamed("file_name", "target"), "target", "left_semi").select("file_name", "target")


def components(edges: DataFrame, a: str = "file_name", b: str = "target") -> DataFrame:
    """Rows (node, root) of every node with an edge to another; root is the smallest node that it is connected to.

    Every round ties the larger neighbours of a node to its smallest, then the smaller ones; rounds grow with the logarithm of the nodes.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, before = kept(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = kept(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or state.n == 0:
            break
        before = state
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def members(rooted: DataFrame) -> DataFrame:
    """Rows (root, members): the sorted names of each group."""
    return rooted.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("members"))


def group_of(edges: DataFrame, seed: str) -> DataFrame:
    """The nodes connected to one; the node itself alone if it has no edge. Only the group itself is walked, from the seed outwards: the other nodes are scanned for links, not labelled.
    After some rounds the group must be deep, and is found by labelling all nodes, whose rounds grow with a logarithm only."""
    ways = kept(edges.select(F.col("file_name").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("file_name").alias("b"))).filter("a <> b"), "ways")
    reached = edges.sparkSession.createDataFrame([(seed,)], "node string")
    border = reached
    for _ in range(4):
        border = kept(ways.join(border.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti"), "border")
        if border.isEmpty():
            return reached
        reached = kept(reached.unionByName(border), "reached")
    rooted = components(edges)
    root = rooted.filter(F.col("node") == seed).select("root")
    return rooted.join(F.broadcast(root.limit(1)), "root", "left_semi").select("node")


def elected(edges: DataFrame, ranks: DataFrame, order: list[Column]) -> DataFrame:
    """A master for each connected group: the first file by `order` (over the columns of ranks, which has file_name). Rows file_name, master,
    direct (the file's own edge goes to the master, so its figures still hold); the master's own link is null."""
    rooted = components(edges).withColumnRenamed("node", "file_name")
    ranked = rooted.join(ranks, "file_name").withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    head = ranked.filter("n = 1").select("root", F.col("file_name").alias("master"))
    own = edges.groupBy("file_name").agg(F.min("target").alias("target"))
    out = rooted.join(head, "root").join(own, "file_name", "left")
    return out.select("file_name", F.when(F.col("file_name") != F.col("master"), F.col("master")).alias("master"), F.coalesce((F.col("target") == F.col("master")) & (F.col("file_name") != F.col("master")), F.lit(False)).alias("direct"))


#: Columns of the index that hold the figures of a verified link.
FIGURES = {"sift_match_score": "score", "sift_match_inliers": "inliers", "sift_match_good_matches": "good", "sift_match_inlier_ratio": "ratio"}


def with_election(index: DataFrame, jobs: DataFrame, masters: DataFrame) -> DataFrame:
    """The index (file_name, sift_match_file, the FIGURES, sift_match_checked, ...) after an election, with `changed`.

    jobs: the files that were looked at (file_name, candidate and its score, inliers, good and ratio; all null where none was accepted). masters: see elected. A looked-at file's link is its
    group's master; its figures are those of its candidate if that is the master, and else null, as they would belong to another link. A master, or a file without a group, has no link, and a
    link that it had goes with its figures. All looked-at files are checked; others stay as they are.
    """
    found = jobs.select("file_name", F.lit(True).alias("__job"), F.struct("candidate", *FIGURES.values()).alias("__own")).join(masters.select("file_name", F.col("master").alias("__master")), "file_name", "left")
    both = index.join(found, "file_name", "left")
    job, linked = F.coalesce("__job", F.lit(False)), F.col("__master").isNotNull()
    own = F.coalesce(F.col("__own.candidate") == F.col("__master"), F.lit(False))
    new = {"sift_match_file": F.when(~job, F.col("sift_match_file")).otherwise(F.col("__master")), "sift_match_checked": F.when(~job, F.col("sift_match_checked")).otherwise(True)}
    for name, figure in FIGURES.items():
        value = F.col(f"__own.{figure}")
        value = (F.round(value, 6) if figure in ("score", "ratio") else value).cast(index.schema[name].dataType)
        cleared = F.when(F.col("sift_match_file").isNull(), F.col(name))
        new[name] = F.when(~job, F.col(name)).when(~linked, cleared).when(own, value)
    made = both.select(*index.columns, F.struct(*[c.alias(n) for n, c in new.items()]).alias("__new"))
    changed = F.lit(False)
    for name in new:
        changed = changed | ~F.col(name).eqNullSafe(F.col("__new")[name])
    return made.withColumn("changed", changed).select(*[F.col("__new")[c].alias(c) if c in new else F.col(c) for c in index.columns], "changed")


def spanning(edges: DataFrame) -> DataFrame:
    """The best spanning edges (a, b) of each connected group. edges: a, b, key (an order in which no two edges are equal, the least is best).

    In each round every part takes its best edge to another part, and the parts so tied become one; so the number of parts at least halves."""
    left = kept(edges.filter("a <> b").groupBy("a", "b").agg(F.min("key").alias("key")), "edges")
    labels = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("part"))
    tree = left.select("a", "b").limit(0)
    while True:
        one, two = labels.select(F.col("node").alias("a"), F.col("part").alias("pa")), labels.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        left = kept(left.join(one, "a").join(two, "b").filter("pa <> pb"), "edges")
        if left.isEmpty():
            return tree
        ends = left.select(F.col("pa").alias("part"), F.struct("key", "a", "b", F.col("pb").alias("to")).alias("e")).unionByName(left.select(F.col("pb").alias("part"), F.struct("key", "a", "b", F.col("pa").alias("to")).alias("e")))
        best = kept(ends.groupBy("part").agg(F.min("e").alias("e")).select("part", "e.a", "e.b", "e.to"), "best")
        tree = kept(tree.unionByName(best.select("a", "b").distinct()), "tree")
        # Parts that took each other are the only circles; the smaller of the two is where all that lead to them end.
        back = best.select(F.col("part").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("top"))
        labels = kept(labels.join(jumped(up, "part", "top"), "part").select("node", F.col("top").alias("part")), "labels")
        left = left.select("a", "b", "key")


def jumped(up: DataFrame, node: str, top: str) -> DataFrame:
    """Pointers followed to their ends (which point to themselves), twice as far in each round."""
    now = kept(up, "up")
    while True:
        over = now.select(F.col(node).alias(top), F.col(top).alias("__over"))
        new = kept(now.join(over, top).select(node, F.col("__over").alias(top), (F.col("__over") != F.col(top)).alias("__moved")), "up")
        if new.filter("__moved").isEmpty():
            return new.select(node, top)
        now = new.select(node, top)


def hung(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (node, parent) of trees (edges a, b) hung up at their roots (node, root).

    The tree is walked around: from each way into a node the walk leaves by the next of its edges. How far each step is from the walk's end is found by following the steps twice as
    far in each round; of an edge's two directions the one walked first leads down."""
    both = tree.select("a", "b").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ring = Window.partitionBy("a").orderBy("b")
    around = both.withColumn("next", F.lead("b").over(ring)).withColumn("first", F.min("b").over(Window.partitionBy("a")))
    # The step b -> a goes on with a -> next; at a root the walk ends where it would begin again.
    is_root = roots.filter(F.col("node") == F.col("root")).select(F.col("node").alias("a"), F.lit(True).alias("top"))
    steps = around.join(is_root, "a", "left")
    on = F.when(F.col("next").isNotNull(), F.struct("a", F.col("next").alias("b"))).when(F.col("top").isNull(), F.struct("a", F.col("first").alias("b")))
    now = kept(steps.select(F.struct(F.col("b").alias("a"), F.col("a").alias("b")).alias("step"), on.alias("on"), F.lit(1).cast("long").alias("far")), "walk")
    while not now.filter("on IS NOT NULL").isEmpty():
        ahead = now.select(F.col("step").alias("on"), F.col("on").alias("__on"), F.col("far").alias("__far"))
        now = kept(now.join(ahead, "on", "left").select("step", F.col("__on").alias("on"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far")), "walk")
    way = now.select(F.col("step.a").alias("a"), F.col("step.b").alias("b"), "far")
    back = way.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("far").alias("back"))
    return way.join(back, ["a", "b"]).filter("far > back").select(F.col("b").alias("node"), F.col("a").alias("parent"))


def bridges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Links that join a group to its root: from the root outwards, always the best edge (inliers, ratio, score, then names) to a file not yet reached. Those are the group's best
    spanning edges, so all groups are worked on at once and none must fit a task. edges: file_name, target, inliers, ratio, score; roots: node, root. Rows root, file_name, target."""
    key = F.struct(*[(-F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(c) for c in ("inliers", "ratio", "score")], "file_name", "target")
    tree = spanning(edges.select(F.col("file_name").alias("a"), F.col("target").alias("b"), key.alias("key")))
    down = hung(tree, roots)
    return down.join(roots, "node").select("root", F.col("node").alias("file_name"), F.col("parent").alias("target"))
