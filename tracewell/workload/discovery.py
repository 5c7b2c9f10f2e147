"""Process discovery over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import relations as ops
from tracewell.operators.lookup import settled
from tracewell.plans import discovery as plans
from tracewell.workload.registry import busy_log, click_log, line_log, query, rounded, stage_log, talk_log


def _graph(log, order):
    return f"""(SELECT src, dst, count(*) AS freq FROM
        (SELECT activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY {order}) AS dst FROM {log})
        WHERE dst IS NOT NULL GROUP BY 1, 2)"""


def _loops(log, order):
    return f"""(SELECT src, dst, count(*) AS freq FROM
        (SELECT activity AS src, lead(activity) OVER w AS dst, lead(activity, 2) OVER w AS again FROM {log}
         WINDOW w AS (PARTITION BY case_id ORDER BY {order})) WHERE src = again AND src <> dst GROUP BY 1, 2)"""


def _ends(log, order):
    return f"""(SELECT boundary, activity, count(*) AS cases FROM
        (SELECT 'start' AS boundary, first(activity ORDER BY {order}) AS activity FROM {log} GROUP BY case_id
         UNION ALL SELECT 'end', last(activity ORDER BY {order}) FROM {log} GROUP BY case_id) GROUP BY 1, 2)"""


@query("directly_follows", f"SELECT * FROM {_graph('$L', '$LORD')}")
def directly_follows(spark, folder):
    return ops.directly_follows(line_log(spark, folder))


@query("directly_follows_clicks", f"SELECT * FROM {_graph('$E', '$EORD')}")
def directly_follows_clicks(spark, folder):
    return ops.directly_follows(click_log(spark, folder))


@query("directly_follows_turns", f"SELECT * FROM {_graph('$C', 'turn')}")
def directly_follows_turns(spark, folder):
    return ops.directly_follows(talk_log(spark, folder))


@query("loops_of_two", f"SELECT * FROM {_loops('$E', '$EORD')}")
def loops_of_two(spark, folder):
    return ops.loops_of_two(click_log(spark, folder))


@query("boundary_activities", f"SELECT * FROM {_ends('$L', '$LORD')}")
def boundary_activities(spark, folder):
    return ops.boundary_activities(line_log(spark, folder))


def _footprint(log, order):
    return f"""(WITH follows AS MATERIALIZED (SELECT * FROM {_graph(log, order)})
    SELECT a.activity AS src, b.activity AS dst,
    CASE WHEN f.src IS NOT NULL AND r.src IS NOT NULL THEN 'parallel' WHEN f.src IS NOT NULL THEN 'causal'
         WHEN r.src IS NOT NULL THEN 'reverse' ELSE 'unrelated' END AS relation
    FROM (SELECT DISTINCT activity FROM {log}) a CROSS JOIN (SELECT DISTINCT activity FROM {log}) b
    LEFT JOIN follows f ON f.src = a.activity AND f.dst = b.activity
    LEFT JOIN follows r ON r.dst = a.activity AND r.src = b.activity)"""


@query("footprint", f"SELECT * FROM {_footprint('$F', '$LORD')}")
def footprint(spark, folder):
    log = stage_log(spark, folder)
    counts = settled(ops.relation_counts(log))
    graph = ops.graph_of(counts)
    return ops.footprint(graph, plans.activities_of(graph, ops.boundaries_of(counts)))


@query("footprint_busy", f"SELECT * FROM {_footprint('$B', '$EORD')}")
def footprint_busy(spark, folder):
    """More than 64 activities, many of which follow themselves or go round in loops."""
    counts = settled(ops.relation_counts(busy_log(spark, folder)))
    graph = ops.graph_of(counts)
    return ops.footprint(graph, plans.activities_of(graph, ops.boundaries_of(counts)))


# Pairs grow by any fitting activity here; equal sets collapse in the recursive UNION.
def _alpha(log, order):
    return f"""
WITH RECURSIVE rel AS MATERIALIZED (SELECT * FROM {_footprint(log, order)}),
lonely AS (SELECT src AS activity FROM rel WHERE src = dst AND relation = 'unrelated'),
near AS MATERIALIZED (
    SELECT src AS x, coalesce(list(dst) FILTER (WHERE relation = 'unrelated' AND src <> dst), []) AS apart,
           coalesce(list(dst) FILTER (WHERE relation = 'causal'), []) AS after,
           coalesce(list(dst) FILTER (WHERE relation = 'reverse'), []) AS before
    FROM rel WHERE src IN (SELECT activity FROM lonely) AND dst IN (SELECT activity FROM lonely) GROUP BY 1),
grown AS (
    SELECT [src] AS a, [dst] AS b FROM rel WHERE relation = 'causal'
        AND src IN (SELECT activity FROM lonely) AND dst IN (SELECT activity FROM lonely)
    UNION
    SELECT CASE WHEN list_has_all(apart, a) AND list_has_all(after, b) THEN list_sort(list_append(a, x)) ELSE a END,
           CASE WHEN list_has_all(apart, a) AND list_has_all(after, b) THEN b ELSE list_sort(list_append(b, x)) END
    FROM grown, near
    WHERE (list_has_all(apart, a) AND list_has_all(after, b)) OR (list_has_all(apart, b) AND list_has_all(before, a))),
pairs AS MATERIALIZED (SELECT a, b FROM grown WHERE NOT EXISTS (SELECT 1 FROM near
    WHERE (list_has_all(apart, a) AND list_has_all(after, b)) OR (list_has_all(apart, b) AND list_has_all(before, a)))),
places AS (SELECT '{{' || array_to_string(a, ',') || '}}->{{' || array_to_string(b, ',') || '}}' AS place, a, b FROM pairs)
"""


def _alpha_places(log, order):
    return _alpha(log, order) + "SELECT place, '' AS marking FROM places UNION ALL SELECT 'start', 'initial' UNION ALL SELECT 'end', 'final'"


def _alpha_arcs(log, order):
    ends = _ends(log, order)
    return (
        _alpha(log, order)
        + f"""SELECT unnest(a) AS source, place AS target, 'transition' AS source_kind FROM places
          UNION ALL SELECT place, unnest(b), 'place' FROM places
          UNION ALL SELECT 'start', activity, 'place' FROM {ends} WHERE boundary = 'start'
          UNION ALL SELECT activity, 'end', 'transition' FROM {ends} WHERE boundary = 'end'"""
    )


@query("alpha_places", _alpha_places("$F", "$LORD"))
def alpha_places(spark, folder):
    return plans.alpha_net(stage_log(spark, folder)).places.fillna("", ["marking"])


@query("alpha_transitions", "SELECT DISTINCT activity AS transition, activity AS label FROM $F")
def alpha_transitions(spark, folder):
    return plans.alpha_net(stage_log(spark, folder)).transitions


@query("alpha_arcs", _alpha_arcs("$F", "$LORD"))
def alpha_arcs(spark, folder):
    return plans.alpha_net(stage_log(spark, folder)).arcs


@query("alpha_places_busy", _alpha_places("$B", "$EORD"))
def alpha_places_busy(spark, folder):
    """More than 64 activities with loops."""
    return plans.alpha_net(busy_log(spark, folder)).places.fillna("", ["marking"])


@query("alpha_arcs_busy", _alpha_arcs("$B", "$EORD"))
def alpha_arcs_busy(spark, folder):
    return plans.alpha_net(busy_log(spark, folder)).arcs


def _dependencies(log, order):
    graph, loops = _graph(log, order), _loops(log, order)
    return f"""(SELECT *, dependency >= 0.5 OR loop_dependency >= 0.5 AS kept FROM
        (SELECT g.src, g.dst, g.freq,
            CASE WHEN g.src = g.dst THEN g.freq / (g.freq + 1)
                 ELSE (g.freq - coalesce(r.freq, 0)) / (g.freq + coalesce(r.freq, 0) + 1) END AS dependency,
            CASE WHEN g.src = g.dst THEN 0.0 ELSE (coalesce(t.freq, 0) + coalesce(u.freq, 0))
                 / (coalesce(t.freq, 0) + coalesce(u.freq, 0) + 1) END AS loop_dependency
        FROM {graph} g LEFT JOIN {graph} r ON r.src = g.dst AND r.dst = g.src
        LEFT JOIN {loops} t ON t.src = g.src AND t.dst = g.dst LEFT JOIN {loops} u ON u.src = g.dst AND u.dst = g.src))"""


@query(
    "dependency_graph",
    f"""SELECT src, dst, freq, round(dependency, 6) AS dependency, round(loop_dependency, 6) AS loop_dependency, kept
        FROM {_dependencies('$E', '$EORD')}""",
)
def dependency_graph(spark, folder):
    log = click_log(spark, folder)
    counts = settled(ops.relation_counts(log))
    found = ops.dependencies(ops.graph_of(counts), ops.loops_of(counts))
    return rounded(found, "dependency", "loop_dependency")


_BRANCHES = """branches AS MATERIALIZED (
    SELECT side, l.activity, l.branch AS "left", r.branch AS "right",
           (coalesce(x.freq, 0) + coalesce(y.freq, 0)) / (l.freq + r.freq + 1) AS and_measure
    FROM (SELECT 'split' AS side, src AS activity, dst AS branch, freq FROM edges WHERE kept AND src <> dst
          UNION ALL SELECT 'join', dst, src, freq FROM edges WHERE kept AND src <> dst) l
    JOIN (SELECT 'split' AS side, src AS activity, dst AS branch, freq FROM edges WHERE kept AND src <> dst
          UNION ALL SELECT 'join', dst, src, freq FROM edges WHERE kept AND src <> dst) r USING (side, activity)
    LEFT JOIN edges x ON x.src = l.branch AND x.dst = r.branch LEFT JOIN edges y ON y.src = r.branch AND y.dst = l.branch
    WHERE l.branch < r.branch)"""
AND_LIMIT = 0.3


@query(
    "branch_relations",
    f"""WITH edges AS MATERIALIZED (SELECT * FROM {_dependencies('$F', '$LORD')}), {_BRANCHES}
        SELECT side, activity, "left", "right", round(and_measure, 6) AS and_measure,
               CASE WHEN and_measure >= {AND_LIMIT} THEN 'AND' ELSE 'XOR' END AS relation FROM branches""",
)
def branch_relations(spark, folder):
    log = stage_log(spark, folder)
    counts = settled(ops.relation_counts(log))
    graph = ops.graph_of(counts)
    edges = settled(ops.dependencies(graph, ops.loops_of(counts)))
    return rounded(ops.branch_relations(edges, graph, AND_LIMIT), "and_measure")


def _wired(log, order):
    return f"""
WITH RECURSIVE edges AS MATERIALIZED (SELECT * FROM {_dependencies(log, order)}), {_BRANCHES},
joint AS MATERIALIZED (SELECT side, activity, "left" AS x, "right" AS y FROM branches WHERE and_measure >= {AND_LIMIT}
    UNION SELECT side, activity, "right", "left" FROM branches WHERE and_measure >= {AND_LIMIT}),
ends AS MATERIALIZED (SELECT * FROM {_ends(log, order)}),
every AS MATERIALIZED (SELECT src, dst FROM edges WHERE kept
    UNION ALL SELECT 'START', activity FROM ends WHERE boundary = 'start'
    UNION ALL SELECT activity, 'END' FROM ends WHERE boundary = 'end'),
sides AS MATERIALIZED (SELECT 'split' AS side, src AS activity, dst AS branch FROM every
    UNION ALL SELECT 'join', dst, src FROM every),
reach AS (SELECT side, activity, branch, branch AS other FROM sides
    UNION SELECT r.side, r.activity, r.branch, j.y FROM reach r
    JOIN joint j ON j.side = r.side AND j.activity = r.activity AND j.x = r.other),
bound AS (SELECT side, activity, branch, min(other) AS binding FROM reach GROUP BY 1, 2, 3),
sized AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY side, activity, binding) AS size FROM bound),
wires AS (SELECT s.side, s.activity, s.branch, s.binding,
    CASE WHEN n = 1 THEN 'direct' WHEN size = 1 THEN 'one' ELSE 'many' END AS wiring FROM sized s
    JOIN (SELECT side, activity, count(DISTINCT binding) AS n FROM bound GROUP BY 1, 2) USING (side, activity)),
wired AS MATERIALIZED (SELECT e.src, e.dst, CASE WHEN src = 'START' THEN 'one' ELSE o.wiring END AS o,
    CASE WHEN dst = 'END' THEN 'one' ELSE i.wiring END AS i,
    CASE WHEN src = 'START' THEN 'source' ELSE 'out:' || src END AS po,
    CASE WHEN dst = 'END' THEN 'sink' ELSE 'in:' || dst END AS pi,
    CASE src WHEN 'START' THEN '{{start}}' ELSE src END || '->' || CASE dst WHEN 'END' THEN '{{end}}' ELSE dst END AS between,
    'fork:' || src || ':' || o.binding AS fork, 'merge:' || dst || ':' || i.binding AS merge
    FROM every e JOIN wires o ON o.side = 'split' AND o.activity = src AND o.branch = dst
    JOIN wires i ON i.side = 'join' AND i.activity = dst AND i.branch = src),
arcs AS MATERIALIZED (
    SELECT src AS source, po AS target FROM wired WHERE o <> 'direct' AND src <> 'START'
    UNION SELECT pi, dst FROM wired WHERE i <> 'direct' AND dst <> 'END'
    UNION SELECT po, fork FROM wired WHERE o = 'many'
    UNION SELECT merge, pi FROM wired WHERE i = 'many'
    UNION SELECT po, 'step:' || between FROM wired WHERE o = 'one' AND i = 'one'
    UNION SELECT 'step:' || between, pi FROM wired WHERE o = 'one' AND i = 'one'
    UNION SELECT po, CASE i WHEN 'direct' THEN dst ELSE merge END FROM wired WHERE o = 'one' AND i <> 'one'
    UNION SELECT CASE o WHEN 'direct' THEN src ELSE fork END, pi FROM wired WHERE o <> 'one' AND i = 'one'
    UNION SELECT CASE o WHEN 'direct' THEN src ELSE fork END, 'edge:' || between FROM wired WHERE o <> 'one' AND i <> 'one'
    UNION SELECT 'edge:' || between, CASE i WHEN 'direct' THEN dst ELSE merge END FROM wired
        WHERE o <> 'one' AND i <> 'one')
"""
_NODES = "(SELECT source AS node FROM arcs UNION SELECT target FROM arcs)"
_IS_PLACE = "(node IN ('source', 'sink') OR regexp_matches(node, '^(out|in|edge):'))"


_HIDDEN = "regexp_matches(node, '^(fork|merge|step):')"


def _arcs_sql(log, order):
    return _wired(log, order) + f"SELECT source, target, CASE WHEN {_IS_PLACE.replace('node', 'source')} THEN 'place' ELSE 'transition' END AS source_kind FROM arcs"


def _places_sql(log, order):
    marking = "CASE node WHEN 'source' THEN 'initial' WHEN 'sink' THEN 'final' ELSE '' END"
    return _wired(log, order) + f"SELECT node AS place, {marking} AS marking FROM {_NODES} WHERE {_IS_PLACE}"


def _transitions_sql(log, order):
    return _wired(log, order) + f"SELECT node AS transition, CASE WHEN {_HIDDEN} THEN '' ELSE node END AS label FROM {_NODES} WHERE NOT {_IS_PLACE}"


def _heuristics(log):
    return plans.heuristics_net(log, and_threshold=AND_LIMIT)


@query("heuristics_arcs", _arcs_sql("$F", "$LORD"))
def heuristics_arcs(spark, folder):
    return _heuristics(stage_log(spark, folder)).arcs


@query("heuristics_places", _places_sql("$F", "$LORD"))
def heuristics_places(spark, folder):
    return _heuristics(stage_log(spark, folder)).places.fillna("", ["marking"])


@query("heuristics_transitions", _transitions_sql("$F", "$LORD"))
def heuristics_transitions(spark, folder):
    return _heuristics(stage_log(spark, folder)).transitions.withColumn("label", F.coalesce("label", F.lit("")))


@query("heuristics_arcs_busy", _arcs_sql("$B", "$EORD"))
def heuristics_arcs_busy(spark, folder):
    """A log with self loops and loops of two, and more than 64 activities."""
    return _heuristics(busy_log(spark, folder)).arcs


@query("heuristics_transitions_busy", _transitions_sql("$B", "$EORD"))
def heuristics_transitions_busy(spark, folder):
    return _heuristics(busy_log(spark, folder)).transitions.withColumn("label", F.coalesce("label", F.lit("")))
