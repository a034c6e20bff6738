"""A graph as a state machine: edges, limits, bounded paths, gaps and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import as_number
from tracewright.storage import stash

#: Steps of a path, and paths of a graph, at most.
MAX_DEPTH, MAX_PATHS = 12, 500


def journey_edges(offers: DataFrame, outcomes: DataFrame, leads: DataFrame, steps: DataFrame) -> DataFrame:
    """``state, decision, outcome, next_state``: decisions joined to their outcomes and where these lead, and direct steps.

    ``offers``: ``state, decision``; ``outcomes``: ``decision, outcome``; ``leads``: ``outcome, next_state``; ``steps``: ``state, next_state``.
    """
    decided = offers.join(outcomes, "decision").join(leads, "outcome").select("state", "decision", "outcome", "next_state")
    direct = steps.select("state", F.lit("").alias("decision"), F.lit("").alias("outcome"), "next_state")
    return decided.unionByName(direct).distinct()


def entries(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """``state``: declared starts, else states that nothing leads to, else all states."""
    states = edges.select("state").union(edges.select("next_state")).distinct()
    unreached = states.join(edges.select(F.col("next_state").alias("state")).distinct(), "state", "left_anti")
    options = declared.select("state", F.lit(1).alias("rank")).unionByName(unreached.withColumn("rank", F.lit(2))).unionByName(states.withColumn("rank", F.lit(3)))
    best = options.agg(F.min("rank").alias("best"))
    return options.join(F.broadcast(best), F.col("rank") == F.col("best")).select("state").distinct()


def revisit_limits(thresholds: DataFrame, values: DataFrame, edges: DataFrame) -> DataFrame:
    """``state, n``: how often a state may recur, where a threshold says so.

    ``thresholds``: ``head, value`` (a state or a decision); ``values``: ``value, literal``. A literal that is no positive number or cardinal word
    limits nothing; of a value's literals the first by name counts, of a head's values the last. A threshold on a
    decision bounds the states that offer it, and the smallest of a state's bounds holds.
    """
    read = values.groupBy("value").agg(F.min("literal").alias("literal")).select("value", as_number(F.col("literal")).alias("number"))
    declared = thresholds.join(read, "value").filter("number > 0").groupBy("head").agg(F.max_by("number", "value").alias("n"))
    own = edges.select("state").distinct().join(declared.withColumnRenamed("head", "state"), "state")
    offered = edges.filter("decision <> ''").select("state", "decision").distinct().join(declared.withColumnRenamed("head", "decision"), "decision").select("state", "n")
    return own.select("state", "n").unionByName(offered).groupBy("state").agg(F.min("n").alias("n"))


def _steps(edges: DataFrame) -> DataFrame:
    """Distinct edges as ``last`` (where one is) and ``step``; steps are ordered by decision, outcome and next state."""
    step = F.struct("decision", "outcome", "next_state")
    return edges.select(F.col("state").alias("last"), step.alias("step")).distinct()


def enumerate_paths(edges: DataFrame, starts: DataFrame, terminals: DataFrame, limits: DataFrame, default_limit: int = 3, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> DataFrame:
    """``entry, steps, path, depth, complete, truncated``: paths from every start until a terminal, a state without successors, or ``max_depth`` steps.

    ``edges``: ``state, decision, outcome, next_state``; ``steps`` has the decision, outcome and next state of each step. A state may be visited as often as ``limits`` (``state, n``) says, else ``default_limit`` times; a start is a first
    visit. Of all paths the first ``max_paths`` are the result, in the order of their starts and steps: a budget, as their number
    visit. Of all paths the first ``max_paths`` are the result, in the order of their starts and steps: a budget, as their number
    grows with the power of the depth. ``complete`` says whether a path ended at a terminal, ``truncated`` (the same in all rows)
    whether the budget was used up or one of the paths was cut off by the depth; ``edge_gaps`` finds a path to each edge that is then missing. A path that all its
    successors' limits stop is no scenario and uses no budget.

    Each round takes the first open paths in that order a step further, as many as the budget has, and writes what is open and what has ended; paths behind
    the last one of a full budget go. So no more is held than a few steps of as many paths, however many there are.
    """
    goes_on = edges.select(F.col("state").alias("last")).distinct().withColumn("more", F.lit(True))
    ends = terminals.select(F.col("state").alias("last")).distinct().withColumn("terminal", F.lit(True))
    hops = _steps(edges).join(limits.select(F.col("state").alias("to"), "n"), F.col("step.next_state") == F.col("to"), "left").select("last", "step", F.coalesce("n", F.lit(default_limit)).alias("n"))
    none = F.array().cast(T.ArrayType(edges.select(F.struct("decision", "outcome", "next_state").alias("s")).schema["s"].dataType))
    key, columns = F.struct("entry", "steps"), ["entry", "steps", "last", "ended", "complete", "cut"]
    way = F.concat(F.array("entry"), F.transform("steps", lambda x: x["next_state"]))

    def marked(paths: DataFrame) -> DataFrame:
        rows = paths.join(goes_on, "last", "left").join(ends, "last", "left")
        complete, deep = F.col("terminal").isNotNull(), F.size("steps") >= max_depth
        return rows.select("entry", "steps", "last", (complete | F.col("more").isNull() | deep).alias("ended"), complete.alias("complete"), (deep & ~complete & F.col("more").isNotNull()).alias("cut"))

    def up_to(rows: DataFrame, n: int) -> DataFrame:
        """One row: the last of the first n paths."""
        return F.broadcast(rows.orderBy("entry", "steps").limit(n).agg(F.max(key).alias("bound")))

    rows = stash(marked(starts.select(F.col("state").alias("entry"), none.alias("steps"), F.col("state").alias("last")).distinct()), "paths")
    while True:
        n = rows.agg(F.count_if("ended").alias("ended"), F.count_if(~F.col("ended")).alias("open")).first()
        waiting, done = rows.filter("NOT ended"), rows.filter("ended")
        if n["ended"] >= max_paths:
            waiting = waiting.join(up_to(done, max_paths), key < F.col("bound")).select(columns)
            done = done.orderBy("entry", "steps").limit(max_paths)
        if not n["open"] or n["ended"] >= max_paths and waiting.isEmpty():
            break
        later = None
        if n["open"] > max_paths:
            turn = up_to(waiting, max_paths)
            waiting, later = waiting.join(turn, key <= F.col("bound")).select(columns), waiting.join(turn, key > F.col("bound")).select(columns)
        visits = F.size(way) - F.size(F.array_remove(way, F.col("step.next_state")))
        onward = waiting.select("entry", "steps", "last").join(hops, "last").filter(visits < F.col("n"))
        onward = marked(onward.select("entry", F.concat("steps", F.array("step")).alias("steps"), F.col("step.next_state").alias("last")))
        rows = stash(done.unionByName(onward) if later is None else done.unionByName(onward).unionByName(later), "paths")
    found = stash(done.orderBy("entry", "steps").limit(max_paths), "paths")
    cut = n["ended"] >= max_paths or not found.filter("cut").isEmpty()
    return found.select("entry", "steps", way.alias("path"), F.size("steps").alias("depth"), "complete", F.lit(cut).alias("truncated"))


def covered_edges(paths: DataFrame) -> DataFrame:
    """``state, decision, outcome, next_state`` that some path goes along."""
    along = F.arrays_zip(F.slice("path", 1, F.size("steps")).alias("state"), F.col("steps").alias("step"))
    return paths.select(F.explode(along).alias("e")).select("e.state", "e.step.decision", "e.step.outcome", "e.step.next_state").distinct()


def unreachable_states(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``state``: states of the graph that no path visits."""
    states = edges.select("state").union(edges.select("next_state")).distinct()
    return states.join(paths.select(F.explode("path").alias("state")).distinct(), "state", "left_anti")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``state, entry, steps``: of each state that a start reaches in at most ``max_depth`` steps the shortest path, the first in order among those.

    A level at a time, until no new state is met; starts and successors are taken in order, as a breadth-first search would.
    """
    hops = stash(_steps(edges), "hops")
    none = F.array().cast(T.ArrayType(hops.schema["step"].dataType))
    seen = stash(starts.select("state", F.col("state").alias("entry"), none.alias("steps")).distinct(), "shortest")
    for depth in range(max_depth):
        onward = seen.filter(F.size("steps") == depth).withColumnRenamed("state", "last").join(hops, "last")
        new = onward.select(F.col("step.next_state").alias("state"), F.struct("entry", F.concat("steps", F.array("step")).alias("steps")).alias("p")).groupBy("state").agg(F.min("p").alias("p"))
        new = stash(new.join(seen, "state", "left_anti").select("state", "p.*"), "shortest")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def edge_gaps(edges: DataFrame, paths: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``state, decision, outcome, next_state, entry, steps``: for each edge that no path goes along, the shortest path that ends with it.

    ``entry`` and ``steps`` are null for edges that no start reaches: they stay uncovered.
    """
    missed = edges.select("state", "decision", "outcome", "next_state").distinct().join(covered_edges(paths), ["state", "decision", "outcome", "next_state"], "left_anti")
    found = missed.join(shortest_paths(edges, starts, max_depth), "state", "left")
    return found.select("state", "decision", "outcome", "next_state", "entry", F.concat("steps", F.array(F.struct("decision", "outcome", "next_state"))).alias("steps"))


def layers(edges: DataFrame, starts: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``state, depth``: the longest way forward to each state that a start reaches.

    An edge leads forward if a breadth-first search meets its end after its beginning; so no edge joins two states of one layer.
    """
    met = stash(shortest_paths(edges, starts, max_depth).select("state", F.struct(F.size("steps").alias("n"), "entry", "steps").alias("place")), "met")
    ends = edges.select("state", "next_state").distinct().join(met, "state").join(met.select(F.col("state").alias("next_state"), F.col("place").alias("next_place")), "next_state")
    forward = stash(ends.filter("next_place > place").select("state", "next_state"), "forward")
    depths = front = stash(met.select("state", F.lit(0).alias("depth")), "depths")
    for depth in range(1, max_depth + 1):
        front = stash(front.join(forward, "state").select(F.col("next_state").alias("state")).distinct().withColumn("depth", F.lit(depth)), "depths")
        if front.isEmpty():
            break
        depths = depths.unionByName(front)
    return depths.groupBy("state").agg(F.max("depth").alias("depth"))
