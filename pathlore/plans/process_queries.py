from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import petri as N
from pathlore.operators import process as P
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, with_

_NEXT = """nx AS (SELECT week, case_id, user_id, activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log)"""
_DFG = "g AS (SELECT src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"
_AB = """ga AS (SELECT src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL AND user_id % 2 = 0 GROUP BY ALL),
      gb AS (SELECT src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL AND user_id % 2 = 1 GROUP BY ALL)"""
# a sparse cohort: purchases and errors of the first week only, so that pairs are missing
_RARE = "r AS (SELECT src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL AND src IN ('purchase', 'error') AND dst <> 'view' GROUP BY ALL)"
_MODEL = "m AS (SELECT src, dst FROM g WHERE n >= (SELECT median(n) FROM g))"


def _cohorts(spark, sf):
    log = event_log(spark, sf)
    return log.where("user_id % 2 = 0"), log.where("user_id % 2 = 1")


def _rare(spark, sf):
    return P.dfg(event_log(spark, sf)).where("src in ('purchase', 'error') and dst <> 'view'")


def _model(spark, sf):
    g = P.dfg(event_log(spark, sf))
    return g.where(F.col("n") >= g.agg(F.median("n")).scalar())


@query("dfg", with_("log", _NEXT, _DFG) + "SELECT src, dst, n FROM g")
def dfg(spark, sf):
    return P.dfg(event_log(spark, sf))


_FULL = "f AS (SELECT a.activity AS src, b.activity AS dst, coalesce(n, 0) AS n FROM (SELECT DISTINCT activity FROM log) a CROSS JOIN (SELECT DISTINCT activity FROM log) b LEFT JOIN r ON r.src = a.activity AND r.dst = b.activity)"


@query("dfg_complete", with_("log", _NEXT, _RARE, _FULL) + "SELECT src, dst, n FROM f")
def dfg_complete(spark, sf):
    return P.dfg_complete(_rare(spark, sf), event_log(spark, sf))


@query(
    "dfg_percentage",
    with_("log", _NEXT, _RARE, _FULL)
    + f"SELECT src, dst, n, {rnd('CASE WHEN sum(n) OVER (PARTITION BY src) > 0 THEN n / sum(n) OVER (PARTITION BY src) END')} AS share FROM f",
)
def dfg_percentage(spark, sf):
    return out(P.dfg_percentage(P.dfg_complete(_rare(spark, sf), event_log(spark, sf))))


@query("dfg_per_person", with_("log", _NEXT, _DFG) + f"SELECT src, dst, n, {rnd('n / (SELECT count(DISTINCT user_id) FROM log)')} AS per_person FROM g")
def dfg_per_person(spark, sf):
    log = event_log(spark, sf)
    return out(P.dfg_per_person(P.dfg(log), log))


@query(
    "dfg_diff",
    with_("log", _NEXT, _AB) + "SELECT coalesce(ga.src, gb.src) AS src, coalesce(ga.dst, gb.dst) AS dst, coalesce(ga.n, 0) - coalesce(gb.n, 0) AS diff FROM ga FULL JOIN gb ON ga.src = gb.src AND ga.dst = gb.dst",
)
def dfg_diff(spark, sf):
    a, b = _cohorts(spark, sf)
    return P.dfg_diff(P.dfg(a), P.dfg(b))


_DEP = """dep AS (SELECT g.src AS src, g.dst AS dst, g.n AS n, CASE WHEN g.src = g.dst THEN g.n / (g.n + 1.0)
      ELSE (g.n - coalesce(b.n, 0)) / (g.n + coalesce(b.n, 0) + 1.0) END AS dependency FROM g LEFT JOIN g b ON b.src = g.dst AND b.dst = g.src)"""

for _t in (0.0, 0.1, 0.5, 0.9):

    @query(
        f"dependency_graph_{int(_t * 100)}",
        with_("log", _NEXT, _DFG, _DEP) + f"SELECT src, dst, n, {rnd('dependency')} AS dependency FROM dep WHERE dependency >= {_t}",
    )
    def dependency_graph(spark, sf, t=_t):
        return out(P.dependency_graph(P.dfg(event_log(spark, sf)), t))


_CASES = """pc AS (SELECT user_id, case_id, count(nx.dst) AS steps, count(m.dst) AS ok FROM nx LEFT JOIN m ON m.src = nx.src AND m.dst = nx.dst GROUP BY ALL)"""


@query(
    "dfg_fitness",
    with_("log", _NEXT, _DFG, _MODEL, _CASES) + f"SELECT {rnd('sum(ok) / sum(steps)')} AS fit_steps, {rnd('avg(CASE WHEN ok = steps THEN 1.0 ELSE 0 END)')} AS fit_cases FROM pc",
)
def dfg_fitness(spark, sf):
    return out(P.dfg_fitness(event_log(spark, sf), _model(spark, sf)))


@query(
    "dfg_precision",
    with_("log", _NEXT, _DFG, _MODEL, _RARE)
    + f"""SELECT count(*) FILTER (EXISTS (SELECT 1 FROM nx WHERE nx.src = m.src AND nx.dst = m.dst)) AS seen_edges, count(*) AS open_edges,
      {rnd('count(*) FILTER (EXISTS (SELECT 1 FROM nx WHERE nx.src = m.src AND nx.dst = m.dst)) / count(*)')} AS precision
      FROM m WHERE src IN (SELECT activity FROM log)""",
)
def dfg_precision(spark, sf):
    return out(P.dfg_precision(event_log(spark, sf), _model(spark, sf)))


@query(
    "model_size",
    with_("log", _NEXT, _DFG, _MODEL, "nd AS (SELECT count(*) AS nodes FROM (SELECT src FROM m UNION SELECT dst FROM m))")
    + f"SELECT nodes, (SELECT count(*) FROM m) AS edges, {rnd('(SELECT count(*) FROM m) / (nodes * nodes)')} AS density FROM nd",
)
def model_size(spark, sf):
    return out(P.model_size(_model(spark, sf)))


@query(
    "student_vs_models",
    with_("log", _NEXT, _DFG, _MODEL, _RARE)
    + f"""SELECT user_id, {rnd('count(m.src) / count(*)')} AS fit1, {rnd('count(r.src) / count(*)')} AS fit2 FROM nx LEFT JOIN m ON m.src = nx.src AND m.dst = nx.dst
      LEFT JOIN r ON r.src = nx.src AND r.dst = nx.dst WHERE nx.dst IS NOT NULL GROUP BY user_id""",
)
def student_vs_models(spark, sf):
    return out(P.student_vs_models(event_log(spark, sf), _model(spark, sf), _rare(spark, sf)))


_CAUSAL = "ca AS (SELECT src, dst FROM m WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM m b WHERE b.src = m.dst AND b.dst = m.src))"
# sets of activities as bits
_ALPHA = """ac AS (SELECT activity, CAST(pow(2, row_number() OVER (ORDER BY activity) - 1) AS BIGINT) AS bit FROM (SELECT DISTINCT activity FROM log)),
  st AS (SELECT s FROM range(1, (SELECT CAST(pow(2, count(*)) AS BIGINT) FROM ac)) r(s)
    WHERE NOT EXISTS (SELECT 1 FROM m JOIN ac a ON a.activity = m.src JOIN ac b ON b.activity = m.dst WHERE s & a.bit > 0 AND s & b.bit > 0)),
  pr AS (SELECT i.s AS i, o.s AS o FROM st i, st o WHERE NOT EXISTS (SELECT 1 FROM ac a, ac b WHERE i.s & a.bit > 0 AND o.s & b.bit > 0
    AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.src = a.activity AND ca.dst = b.activity))),
  mx AS (SELECT i, o FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.i & pr.i = pr.i AND q.o & pr.o = pr.o AND (q.i <> pr.i OR q.o <> pr.o))),
  nm AS (SELECT (SELECT string_agg(activity, '+' ORDER BY activity) FROM ac WHERE mx.i & bit > 0) AS inputs,
    (SELECT string_agg(activity, '+' ORDER BY activity) FROM ac WHERE mx.o & bit > 0) AS outputs FROM mx),
  fl AS (SELECT case_id, first(activity ORDER BY ts, event_id) AS f, last(activity ORDER BY ts, event_id) AS l FROM log GROUP BY case_id),
  net AS (SELECT inputs || '>' || outputs AS place, inputs, outputs FROM nm
    UNION ALL SELECT 'start', '', (SELECT string_agg(DISTINCT f, '+' ORDER BY f) FROM fl) UNION ALL SELECT 'end', (SELECT string_agg(DISTINCT l, '+' ORDER BY l) FROM fl), '')"""
_REPLAY = """ar AS (SELECT place, 1 AS side, 1 AS t, unnest(string_split(inputs, '+')) AS activity FROM net WHERE inputs <> ''
    UNION ALL SELECT place, 0, -1, unnest(string_split(outputs, '+')) FROM net WHERE outputs <> ''),
  mv AS (SELECT case_id, place, ts, event_id, side, t FROM log JOIN ar USING (activity)
    UNION ALL SELECT case_id, 'start', TIMESTAMP '1900-01-01', 0, 0, 1 FROM (SELECT DISTINCT case_id FROM log)
    UNION ALL SELECT case_id, 'end', TIMESTAMP '2900-01-01', 0, 0, -1 FROM (SELECT DISTINCT case_id FROM log)),
  hd AS (SELECT *, sum(t) OVER (PARTITION BY case_id, place ORDER BY ts, event_id, side) AS held FROM mv),
  pl AS (SELECT case_id, place, sum(t) FILTER (t > 0) AS p, -sum(t) FILTER (t < 0) AS c, -least(min(held), 0) AS mi, sum(t) AS net FROM hd GROUP BY ALL),
  cs AS (SELECT case_id, CAST(sum(p) AS BIGINT) AS produced, CAST(sum(c) AS BIGINT) AS consumed, CAST(sum(mi) AS BIGINT) AS missing, CAST(sum(net + mi) AS BIGINT) AS remaining FROM pl GROUP BY case_id)"""


def _net(spark, sf):
    log = event_log(spark, sf)
    return N.alpha_net(_model(spark, sf), N.case_ends(log))


@query("alpha_net", with_("log", _NEXT, _DFG, _MODEL, _CAUSAL, _ALPHA) + "SELECT place, inputs, outputs FROM net")
def alpha_net(spark, sf):
    return _net(spark, sf).select("place", F.array_join("inputs", "+").alias("inputs"), F.array_join("outputs", "+").alias("outputs"))


@query(
    "token_replay",
    with_("log", _NEXT, _DFG, _MODEL, _CAUSAL, _ALPHA, _REPLAY)
    + f"SELECT case_id, produced, consumed, missing, remaining, {rnd('1 - missing / consumed / 2 - remaining / produced / 2')} AS fitness FROM cs",
)
def token_replay(spark, sf):
    return out(N.token_replay(event_log(spark, sf), _net(spark, sf)))


@query(
    "replay_fitness",
    with_("log", _NEXT, _DFG, _MODEL, _CAUSAL, _ALPHA, _REPLAY)
    + f"""SELECT CAST(sum(produced) AS BIGINT) AS produced, CAST(sum(consumed) AS BIGINT) AS consumed, CAST(sum(missing) AS BIGINT) AS missing,
      CAST(sum(remaining) AS BIGINT) AS remaining, {rnd('avg(CASE WHEN missing = 0 AND remaining = 0 THEN 1.0 ELSE 0 END)')} AS fit_cases,
      {rnd('1 - sum(missing) / sum(consumed) / 2 - sum(remaining) / sum(produced) / 2')} AS fitness FROM cs""",
)
def replay_fitness(spark, sf):
    return out(N.replay_fitness(event_log(spark, sf), _net(spark, sf)))
