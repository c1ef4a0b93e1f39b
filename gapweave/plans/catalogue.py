"""The catalogue: a query for each operator and, where SQL can express it, its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import connectivity as cn
from ..operators import graphs as gr
from ..operators import grouped as gp
from ..operators import inference as nf
from ..operators import segments as sg
from ..operators import states as st
from ..operators import templates as tm
from ..sources.panel import PRIORITIES, RUN, order_cells, order_panel, outlier_mask, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the driver tables' panel and its segments, for every oracle
PANEL_SQL = """
WITH cell AS (SELECT (l_suppkey % 10)::VARCHAR AS subject, l_linestatus AS session, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::BIGINT AS frame,
  o_orderpriority AS roi, sum(l_quantity) AS x, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
fr AS (SELECT subject, session, frame, count(*) AS k, sum(n) AS n FROM cell GROUP BY ALL),
mask AS (SELECT subject, session, frame, NOT (k = 5 AND n >= 0.8::DOUBLE * avg(n) OVER (PARTITION BY subject, session)) AS outlier FROM fr),
keep AS (SELECT subject, session, frame FROM mask WHERE NOT outlier),
panel AS (SELECT subject, session, frame, (roi[1]::INT - 1)::INT AS roi_idx, roi, x FROM cell JOIN keep USING (subject, session, frame)),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY subject, session ORDER BY frame) AS g FROM keep),
seg AS (SELECT subject, session, frame, (dense_rank() OVER (PARTITION BY subject, session ORDER BY g) - 1)::BIGINT AS segment_id,
  (row_number() OVER (PARTITION BY subject, session, g ORDER BY frame) - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY subject, session, g)::BIGINT AS len FROM isl),
sp AS (SELECT p.*, segment_id, pos, len FROM panel p JOIN seg USING (subject, session, frame)),
segtab AS (SELECT subject, session, segment_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames FROM seg GROUP BY ALL)
"""
L, S = 12, 3


def r6(c):
    """Six digits, no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def query(name: str, sql: str | None = None, panel: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (PANEL_SQL + sql) if panel else sql
        return f

    return add


RUNSQL = "subject, session"
SEGSQL = "subject, session, segment_id"
ZSQL = """, st AS (SELECT subject, session, segment_id, frame, roi_idx, (x - avg(x) OVER w) / (CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 1 ELSE stddev_pop(x) OVER w END) AS z
  FROM sp WHERE len >= 2 WINDOW w AS (PARTITION BY subject, session, segment_id, roi_idx))"""
RSSSQL = ZSQL + ", rs AS (SELECT subject, session, segment_id, frame, sqrt(greatest(0, (sum(z*z) * sum(z*z) - sum(z*z*z*z)) / 2)) AS rss FROM st GROUP BY ALL)"
MTDSQL = """, df AS (SELECT subject, session, segment_id, frame, roi_idx, lead(x) OVER w - x AS d, lead(frame) OVER w AS end_frame FROM sp WHERE len >= 2 WINDOW w AS (PARTITION BY subject, session, segment_id, roi_idx ORDER BY frame)),
dz AS (SELECT *, (d - avg(d) OVER w) / stddev_pop(d) OVER w AS z FROM df WHERE d IS NOT NULL WINDOW w AS (PARTITION BY subject, session, roi_idx))"""


def fc_sql(weight: str, length: int = L, step: int = S) -> str:
    return f""", wr AS (SELECT subject, session, segment_id, frame, roi_idx, x, frame - (pos - s) AS start_frame, {weight.format(at='(pos - s)', length=length)} AS w
  FROM (SELECT *, unnest(range(0, len - {length} + 1, {step})) AS s FROM sp WHERE len >= {length}) WHERE pos >= s AND pos < s + {length}),
wc AS (SELECT *, x - sum(w * x) OVER q / sum(w) OVER q AS c FROM wr WINDOW q AS (PARTITION BY subject, session, segment_id, start_frame, roi_idx)),
fc AS (SELECT a.subject, a.session, a.segment_id, a.start_frame, a.roi_idx AS i, b.roi_idx AS j, atanh(least(greatest(sum(a.w * a.c * b.c) / sqrt(sum(a.w * a.c * a.c) * sum(a.w * b.c * b.c)), -0.999999::DOUBLE), 0.999999::DOUBLE)) AS z
  FROM wc a JOIN wc b USING (subject, session, segment_id, start_frame, frame) WHERE a.roi_idx < b.roi_idx GROUP BY ALL)"""


HAMMING = "(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * {at} / {length}::DOUBLE))"
PHASESQL = """, hc AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, session, segment_id, roi_idx) AS c FROM sp WHERE len >= 20),
hk AS (SELECT a.subject, a.session, a.segment_id, a.roi_idx, a.frame, any_value(a.c) AS c, sum(b.c * CASE WHEN (a.pos - b.pos + a.len) % a.len = 0 THEN 0
  WHEN a.len % 2 = 0 THEN CASE WHEN (a.pos - b.pos + a.len) % 2 = 1 THEN 2::DOUBLE / a.len / tan(pi() * ((a.pos - b.pos + a.len) % a.len) / a.len) ELSE 0 END
  ELSE 1::DOUBLE / a.len * (1 / tan(pi() * ((a.pos - b.pos + a.len) % a.len) / a.len) - cos(pi() * ((a.pos - b.pos + a.len) % a.len)) / sin(pi() * ((a.pos - b.pos + a.len) % a.len) / a.len)) END) AS h
  FROM hc a JOIN hc b USING (subject, session, segment_id, roi_idx) GROUP BY ALL),
ph AS (SELECT subject, session, segment_id, frame, roi_idx, atan2(h, c) AS phase FROM hk)"""
AXISSQL = PHASESQL + """, t1 AS (SELECT *, cos(phase) AS c, sin(phase) AS s FROM ph),
t2 AS (SELECT *, sum(c*c) OVER q AS cc, sum(s*s) OVER q AS ss, sum(c*s) OVER q AS cs FROM t1 WINDOW q AS (PARTITION BY subject, session, segment_id, frame)),
t3 AS (SELECT *, c * cos(atan2(2*cs, cc-ss) / 2) + s * sin(atan2(2*cs, cc-ss) / 2) AS u FROM t2),
ax AS (SELECT subject, session, segment_id, frame, roi_idx, u / sqrt(sum(u*u) OVER q) * CASE WHEN sum(u) OVER q < 0 THEN -1 ELSE 1 END AS v, (cc + ss + sqrt((cc-ss)*(cc-ss) + 4*cs*cs)) / 2 AS eigenvalue FROM t3 WINDOW q AS (PARTITION BY subject, session, segment_id, frame))"""


@query("panel", f"SELECT {RUNSQL}, frame, roi_idx, roi, x FROM panel")
def _(spark, d):
    return order_panel(spark, d).select(*RUN, "frame", "roi_idx", "roi", "x")


@query("outlier_mask", f"SELECT {RUNSQL}, frame, outlier FROM mask")
def _(spark, d):
    return outlier_mask(order_cells(spark, d), len(PRIORITIES))


@query("retained_frames", f"SELECT {RUNSQL}, count(*)::BIGINT AS retained, min(frame) AS first_frame, max(frame) AS last_frame FROM keep GROUP BY ALL")
def _(spark, d):
    kept = outlier_mask(order_cells(spark, d), len(PRIORITIES)).filter("not outlier")
    return kept.groupBy(*RUN).agg(F.count("*").alias("retained"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("segments", f"SELECT {SEGSQL}, frame, pos, len FROM seg")
def _(spark, d):
    return sg.segments(order_panel(spark, d))


@query("segments_min_length", f"SELECT {SEGSQL}, start_frame, end_frame, n_frames FROM segtab WHERE n_frames >= 6")
def _(spark, d):
    return sg.segment_table(order_panel(spark, d), 6)


@query("window_positions", f"SELECT {SEGSQL}, (o // {S})::BIGINT AS window_idx, (start_frame + o)::BIGINT AS start_frame, (start_frame + o + {L - 1})::BIGINT AS end_frame FROM (SELECT *, unnest(range(0, n_frames - {L} + 1, {S})) AS o FROM segtab WHERE n_frames >= {L})")
def _(spark, d):
    return sg.window_table(order_panel(spark, d), L, S)


@query("eligible_window_count", f"SELECT {RUNSQL}, sum(greatest(0, n_frames - {L} + 1))::BIGINT AS eligible FROM segtab GROUP BY ALL")
def _(spark, d):
    return sg.eligible_windows(order_panel(spark, d), L)


@query("static_correlation", """, k AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, session, roi_idx) AS c FROM panel)
SELECT a.subject, a.session, a.roi_idx AS i, b.roi_idx AS j, round(sum(a.c*b.c) / sqrt(sum(a.c*a.c) * sum(b.c*b.c)), 6) + 0.0 AS r FROM k a JOIN k b USING (subject, session, frame) WHERE a.roi_idx < b.roi_idx GROUP BY ALL""")
def _(spark, d):
    return cn.static_correlation(order_panel(spark, d)).withColumn("r", r6("r"))


@query("window_fc_hamming", fc_sql(HAMMING) + f"SELECT {SEGSQL}, start_frame, start_frame + {L - 1} AS end_frame, i, j, round(z, 6) + 0.0 AS z FROM fc")
def _(spark, d):
    return cn.window_fc(order_panel(spark, d), L, S, "hamming").withColumn("z", r6("z"))


@query("window_fc_uniform", fc_sql("1.0::DOUBLE") + f"SELECT {SEGSQL}, start_frame, start_frame + {L - 1} AS end_frame, i, j, round(z, 6) + 0.0 AS z FROM fc")
def _(spark, d):
    return cn.window_fc(order_panel(spark, d), L, S, "uniform").withColumn("z", r6("z"))


@query("cap_rows", ZSQL + f"SELECT {SEGSQL}, frame, roi_idx, round(z, 6) + 0.0 AS z FROM st")
def _(spark, d):
    return cn.segment_standardized(order_panel(spark, d)).select(*sg.SEGMENT, "frame", "roi_idx", r6("z").alias("z"))


@query("ets_edges", ZSQL + f"SELECT a.subject, a.session, a.segment_id, frame, a.roi_idx AS i, b.roi_idx AS j, round(a.z * b.z, 6) + 0.0 AS product FROM st a JOIN st b USING ({SEGSQL}, frame) WHERE a.roi_idx < b.roi_idx")
def _(spark, d):
    return cn.ets_edges(order_panel(spark, d)).withColumn("product", r6("product"))


@query("ets_rss", RSSSQL + f"SELECT {SEGSQL}, frame, round(rss, 6) + 0.0 AS rss FROM rs")
def _(spark, d):
    return cn.ets_rss(order_panel(spark, d)).withColumn("rss", r6("rss"))


@query("ets_event_threshold", RSSSQL + "SELECT round(quantile_cont(rss, 0.95), 6) + 0.0 AS threshold, count(*)::BIGINT AS n_frames, count(DISTINCT subject)::BIGINT AS n_subjects FROM rs")
def _(spark, d):
    return cn.ets_threshold(cn.ets_rss(order_panel(spark, d))).withColumn("threshold", r6("threshold"))


@query("ets_event_mask", RSSSQL + f"SELECT {SEGSQL}, frame, rss >= (SELECT quantile_cont(rss, 0.95) FROM rs) AS event FROM rs")
def _(spark, d):
    rss = cn.ets_rss(order_panel(spark, d))
    limit = cn.ets_threshold(rss).first()["threshold"]
    return rss.select(*sg.SEGMENT, "frame", (F.col("rss") >= limit).alias("event"))


@query("mtd_derivatives", MTDSQL + f"SELECT {SEGSQL}, frame, end_frame, roi_idx, round(z, 6) + 0.0 AS z FROM dz")
def _(spark, d):
    return cn.mtd_derivatives(order_panel(spark, d)).select(*sg.SEGMENT, "frame", "end_frame", "roi_idx", r6("z").alias("z"))


@query("mtd_edges", MTDSQL + f"SELECT a.subject, a.session, a.segment_id, frame, a.end_frame, a.roi_idx AS i, b.roi_idx AS j, round(a.z * b.z, 6) + 0.0 AS product FROM dz a JOIN dz b USING ({SEGSQL}, frame) WHERE a.roi_idx < b.roi_idx")
def _(spark, d):
    return cn.mtd_edges(order_panel(spark, d)).withColumn("product", r6("product"))


@query("mtd_cross_block", MTDSQL + f"SELECT a.subject, a.session, a.segment_id, frame, round(avg(a.z * b.z), 6) + 0.0 AS mean_product FROM dz a JOIN dz b USING ({SEGSQL}, frame) WHERE a.roi_idx IN (0, 1) AND b.roi_idx IN (2, 3, 4) GROUP BY ALL")
def _(spark, d):
    return cn.cross_block(cn.mtd_derivatives(order_panel(spark, d)), [0, 1], [2, 3, 4]).withColumn("mean_product", r6("mean_product"))


@query("mtd_within_block", MTDSQL + f"SELECT a.subject, a.session, a.segment_id, frame, round(avg(a.z * b.z), 6) + 0.0 AS mean_product FROM dz a JOIN dz b USING ({SEGSQL}, frame) WHERE a.roi_idx < b.roi_idx AND a.roi_idx >= 2 GROUP BY ALL")
def _(spark, d):
    return cn.within_block(cn.mtd_derivatives(order_panel(spark, d)), [2, 3, 4]).withColumn("mean_product", r6("mean_product"))


@query("analytic_phase", PHASESQL + f"SELECT {SEGSQL}, frame, roi_idx, round(cos(phase), 6) + 0.0 AS c, round(sin(phase), 6) + 0.0 AS s FROM ph")
def _(spark, d):
    return cn.analytic_phase(order_panel(spark, d)).select(*sg.SEGMENT, "frame", "roi_idx", r6(F.cos("phase")).alias("c"), r6(F.sin("phase")).alias("s"))


@query("leida_vectors", AXISSQL + f"SELECT {SEGSQL}, frame, roi_idx, round(v, 6) + 0.0 AS v FROM ax")
def _(spark, d):
    return cn.phase_axis(cn.analytic_phase(order_panel(spark, d))).select(*sg.SEGMENT, "frame", "roi_idx", r6("v").alias("v"))


@query("leida_eigenvalue", AXISSQL + f"SELECT DISTINCT {SEGSQL}, frame, round(eigenvalue, 6) + 0.0 AS eigenvalue FROM ax")
def _(spark, d):
    found = cn.phase_axis(cn.analytic_phase(order_panel(spark, d)))
    return found.groupBy(*sg.SEGMENT, "frame").agg(r6(F.max("eigenvalue")).alias("eigenvalue"))


@query("phase_cross_block", PHASESQL + f"SELECT a.subject, a.session, a.segment_id, frame, round(avg(cos(a.phase - b.phase)), 6) + 0.0 AS coherence FROM ph a JOIN ph b USING ({SEGSQL}, frame) WHERE a.roi_idx IN (0, 1) AND b.roi_idx IN (2, 3, 4) GROUP BY ALL")
def _(spark, d):
    return cn.phase_cross_block(cn.analytic_phase(order_panel(spark, d)), [0, 1], [2, 3, 4]).withColumn("coherence", r6("coherence"))


@query("phase_within_block", PHASESQL + f"SELECT a.subject, a.session, a.segment_id, frame, round(avg(cos(a.phase - b.phase)), 6) + 0.0 AS coherence FROM ph a JOIN ph b USING ({SEGSQL}, frame) WHERE a.roi_idx < b.roi_idx AND a.roi_idx >= 2 GROUP BY ALL")
def _(spark, d):
    return cn.phase_within_block(cn.analytic_phase(order_panel(spark, d)), [2, 3, 4]).withColumn("coherence", r6("coherence"))


# states

CENTRES = [[0.0] * 10, [0.4] * 10, [-0.4 if (i + j) % 2 == 0 else 0.4 for i in range(5) for j in range(i + 1, 5)]]
LABSQL = fc_sql(HAMMING) + """, ds AS (SELECT subject, session, segment_id, start_frame, k, sum((z - CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 0.4::DOUBLE WHEN (i + j) % 2 = 0 THEN -0.4::DOUBLE ELSE 0.4::DOUBLE END) ** 2) AS d2 FROM fc, (SELECT unnest(range(3)) AS k) GROUP BY ALL),
lab AS (SELECT subject, session, segment_id, start_frame, arg_min(k, (d2, k))::INT AS state, min(d2) AS d2 FROM ds GROUP BY ALL),
nx AS (SELECT *, lead(state) OVER (PARTITION BY subject, session, segment_id ORDER BY start_frame) AS to_state FROM lab)"""
PART = ["A", "A", "B", "B", "B"]


def _features(spark, d):
    return st.features(cn.window_fc(order_panel(spark, d), L, S), [*sg.SEGMENT, "start_frame", "end_frame"])


def _labels(spark, d):
    return st.assigned(_features(spark, d), CENTRES)


@query("kmeans_assign_fixed", LABSQL + f"SELECT {SEGSQL}, start_frame, state, round(d2, 6) + 0.0 AS d2 FROM lab")
def _(spark, d):
    return _labels(spark, d).select(*sg.SEGMENT, "start_frame", "state", r6("d2").alias("d2"))


@query("kmeans_score_fixed", LABSQL + f"SELECT {RUNSQL}, count(*)::BIGINT AS n_samples, count(DISTINCT segment_id)::BIGINT AS n_sequences, round(sum(d2), 6) + 0.0 AS total_d2, round(avg(d2), 6) + 0.0 AS mean_d2 FROM lab GROUP BY ALL")
def _(spark, d):
    return st.kmeans_score(_labels(spark, d)).withColumns({"total_d2": r6("total_d2"), "mean_d2": r6("mean_d2")})


OCCSQL = LABSQL + ", oc AS (SELECT g.subject, g.session, g.state, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / total AS occupancy FROM (SELECT subject, session, total, unnest(range(3))::INT AS state FROM (SELECT subject, session, count(*) AS total FROM lab GROUP BY ALL)) g LEFT JOIN (SELECT subject, session, state, count(*) AS n FROM lab GROUP BY ALL) c USING (subject, session, state))"


@query("state_occupancy", OCCSQL + f"SELECT {RUNSQL}, state, n, round(occupancy, 6) + 0.0 AS occupancy FROM oc")
def _(spark, d):
    return st.occupancy(_labels(spark, d), 3).withColumn("occupancy", r6("occupancy"))


@query("state_dwell", LABSQL + """, ch AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS c FROM lab WINDOW w AS (PARTITION BY subject, session, segment_id ORDER BY start_frame)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY subject, session, segment_id ORDER BY start_frame) AS r FROM ch), ln AS (SELECT subject, session, segment_id, state, r, count(*) AS n FROM rn GROUP BY ALL)
SELECT subject, session, state, count(*)::BIGINT AS visits, round(avg(n), 6) + 0.0 AS mean_dwell, round(avg(n) * 0.8::DOUBLE, 6) + 0.0 AS mean_dwell_seconds FROM ln GROUP BY ALL""")
def _(spark, d):
    return st.dwell(_labels(spark, d), seconds=0.8).withColumns({"mean_dwell": r6("mean_dwell"), "mean_dwell_seconds": r6("mean_dwell_seconds")})


@query("state_transitions", LABSQL + """, mv AS (SELECT subject, session, state AS from_state, to_state, count(*) AS n FROM nx WHERE to_state IS NOT NULL GROUP BY ALL),
gr AS (SELECT subject, session, a::INT AS from_state, b::INT AS to_state FROM (SELECT DISTINCT subject, session FROM lab), (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b)),
fu AS (SELECT g.*, coalesce(n, 0)::BIGINT AS n FROM gr g LEFT JOIN mv USING (subject, session, from_state, to_state))
SELECT *, round(n / nullif(sum(n) OVER (PARTITION BY subject, session, from_state), 0), 6) + 0.0 AS probability FROM fu""")
def _(spark, d):
    return st.transitions(_labels(spark, d), 3).withColumn("probability", r6("probability"))


@query("state_switch_rate", LABSQL + f"SELECT {RUNSQL}, count(to_state)::BIGINT AS possible, coalesce(sum((to_state <> state)::INT), 0)::BIGINT AS switches, round(coalesce(sum((to_state <> state)::INT), 0) / nullif(count(to_state), 0), 6) + 0.0 AS switch_rate FROM nx GROUP BY ALL")
def _(spark, d):
    return st.switch_rate(_labels(spark, d)).withColumn("switch_rate", r6("switch_rate"))


@query("aligned_labels", LABSQL + f"SELECT {SEGSQL}, start_frame, CASE state WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INT AS state FROM lab")
def _(spark, d):
    ramp = [[(-1.0) ** k * i + 3.0 * (i % (k + 2)) for i in range(10)] for k in range(3)]
    found = st.alignment([ramp[2], ramp[0], ramp[1]], ramp)
    return st.relabelled(_labels(spark, d), found["candidate_to_reference"]).select(*sg.SEGMENT, "start_frame", "state")


@query("state_stability", LABSQL + f""", oc AS (SELECT subject, session, 0 AS fit, avg((state = 0)::INT) AS v FROM lab GROUP BY ALL UNION ALL SELECT subject, session, 1, avg((state = 1)::INT) FROM lab GROUP BY ALL)
SELECT {RUNSQL}, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd, count(v)::BIGINT AS n_valid FROM oc GROUP BY ALL""")
def _(spark, d):
    rows = st.occupancy(_labels(spark, d), 3).filter("state < 2").withColumnRenamed("state", "fit_index")
    return st.stability(rows, RUN, "occupancy").withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query("describe_states_topk", fc_sql(HAMMING) + """, pl AS (SELECT i, j, avg(z) AS m, stddev_pop(z) AS sd FROM fc GROUP BY ALL), ix AS (SELECT *, (row_number() OVER (ORDER BY i, j) - 1)::INT AS feature_idx FROM pl),
dv AS (SELECT k::INT AS state, feature_idx, (CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 0.4::DOUBLE WHEN (i + j) % 2 = 0 THEN -0.4::DOUBLE ELSE 0.4::DOUBLE END - m) / sd AS deviation FROM ix, (SELECT unnest(range(3)) AS k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY abs(deviation) DESC, feature_idx)::INT AS rank FROM dv) SELECT state, feature_idx, round(deviation, 6) + 0.0 AS deviation, rank FROM rk WHERE rank <= 4""")
def _(spark, d):
    return st.describe_topk(CENTRES, _features(spark, d), 4).withColumn("deviation", r6("deviation"))


@query("subject_folds", """, s AS (SELECT DISTINCT subject FROM keep), r AS (SELECT subject, row_number() OVER (ORDER BY sha256('{"seed":17,"subject":"' || subject || '"}'), subject) - 1 AS rank, count(*) OVER () AS n FROM s)
SELECT subject, (CASE WHEN rank < (n % 4) * (n // 4 + 1) THEN rank // (n // 4 + 1) ELSE n % 4 + (rank - (n % 4) * (n // 4 + 1)) // (n // 4) END)::INT AS fold FROM r""")
def _(spark, d):
    return st.subject_folds(order_panel(spark, d), 4, 17)


@query("select_state_count", LABSQL + """, sc AS (SELECT k + 1 AS n_states, subject AS fold, avg(d2) AS score FROM ds GROUP BY ALL), a AS (SELECT n_states::INT AS n_states, avg(score) AS mean, stddev_samp(score) AS sd, stddev_samp(score) / sqrt(count(*)) AS se FROM sc GROUP BY ALL),
b AS (SELECT *, row_number() OVER (ORDER BY mean, n_states)::INT AS rank FROM a), c AS (SELECT *, mean <= (SELECT mean + se FROM b WHERE rank = 1) AS within_one_se FROM b)
SELECT n_states, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(se, 6) + 0.0 AS se, rank, within_one_se, rank = 1 AS best, n_states = (SELECT min(n_states) FROM c WHERE within_one_se) AS one_se_choice FROM c""")
def _(spark, d):
    rows = _features(spark, d).select("subject", F.posexplode(st.distances(CENTRES)).alias("k", "d2"))
    scores = rows.groupBy((F.col("k") + 1).alias("n_states"), F.col("subject").alias("fold")).agg(F.avg("d2").alias("score"))
    return st.select_state_count(scores).withColumns({c: r6(c) for c in ("mean", "sd", "se")})


# graphs

GRSQL = """, kc AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, session, roi_idx) AS c FROM panel),
ge AS (SELECT a.subject, a.session, a.roi_idx AS i, b.roi_idx AS j, sum(a.c*b.c) / sqrt(sum(a.c*a.c) * sum(b.c*b.c)) AS w FROM kc a JOIN kc b USING (subject, session, frame) WHERE a.roi_idx < b.roi_idx GROUP BY ALL),
gk AS (SELECT *, row_number() OVER (PARTITION BY subject, session ORDER BY w DESC, i DESC, j DESC) AS r FROM ge WHERE w > 0),
gt AS (SELECT * FROM gk WHERE r <= {target}),
gs AS (SELECT subject, session, i AS node, j AS other, w, (i >= 2)::INT AS own, (j >= 2)::INT AS far FROM gt UNION ALL SELECT subject, session, j, i, w, (j >= 2)::INT, (i >= 2)::INT FROM gt)"""
G3, G5 = GRSQL.format(target=3), GRSQL.format(target=5)


def _graph(spark, d):
    return cn.static_correlation(order_panel(spark, d)).withColumnRenamed("r", "w")


@query("graph_threshold", G3 + f"SELECT {RUNSQL}, i, j, round(w, 6) + 0.0 AS w FROM gt")
def _(spark, d):
    return gr.thresholded(_graph(spark, d), RUN, 0.3, 5).withColumn("w", r6("w"))


@query("graph_density", G3 + f"SELECT {RUNSQL}, round(count(*) / 10, 6) + 0.0 AS density FROM gt GROUP BY ALL")
def _(spark, d):
    return gr.achieved_density(gr.thresholded(_graph(spark, d), RUN, 0.3, 5), RUN, 5).withColumn("density", r6("density"))


MODSQL = """, m{t} AS (SELECT subject, session, sum(inside / t - strength * strength / (t * t)) AS q FROM (SELECT *, sum(strength) OVER (PARTITION BY subject, session) AS t FROM
 (SELECT subject, session, own, sum(CASE WHEN own = far THEN w ELSE 0 END) AS inside, sum(w) AS strength FROM gs GROUP BY ALL)) GROUP BY ALL)"""


@query("graph_modularity", G5 + MODSQL.format(t=5) + f"SELECT {RUNSQL}, round(q, 6) + 0.0 AS modularity FROM m5")
def _(spark, d):
    return gr.modularity(gr.thresholded(_graph(spark, d), RUN, 0.5, 5), RUN, PART).withColumn("modularity", r6("modularity"))


@query("graph_participation", G3 + """, n1 AS (SELECT subject, session, node, far, sum(w) AS s FROM gs GROUP BY ALL), n2 AS (SELECT subject, session, node, sum(s) AS strength, sum(s*s) AS s2 FROM n1 GROUP BY ALL),
g0 AS (SELECT subject, session, unnest(range(5))::INT AS node FROM (SELECT DISTINCT subject, session FROM ge))
SELECT subject, session, node, round(coalesce(strength, 0), 6) + 0.0 AS strength, round(CASE WHEN coalesce(strength, 0) > 0 THEN least(greatest(1 - s2 / (strength * strength), 0), 1) ELSE 0 END, 6) + 0.0 AS participation FROM g0 LEFT JOIN n2 USING (subject, session, node)""")
def _(spark, d):
    edges = _graph(spark, d)
    found = gr.participation(gr.thresholded(edges, RUN, 0.3, 5), edges.select(*RUN).distinct(), RUN, PART)
    return found.withColumns({"strength": r6("strength"), "participation": r6("participation")})


@query("graph_auc", G3 + f""", dn AS (SELECT subject, session, t, least(t, count(*)) / 10 AS y FROM gk, (SELECT unnest([1, 3, 5]) AS t) GROUP BY subject, session, t)
SELECT {RUNSQL}, round(sum(a) / 0.4::DOUBLE, 6) + 0.0 AS auc FROM (SELECT subject, session, (lead(y) OVER w + y) / 2 * (lead(t) OVER w - t) / 10 AS a FROM dn WINDOW w AS (PARTITION BY subject, session ORDER BY t)) GROUP BY ALL""")
def _(spark, d):
    edges, out = _graph(spark, d), None
    for density in (0.1, 0.3, 0.5):
        one = gr.achieved_density(gr.thresholded(edges, RUN, density, 5), RUN, 5).select(*RUN, F.lit(density).alias("x"), F.col("density").alias("y"))
        out = one if out is None else out.unionByName(one)
    return gr.normalized_auc(out, RUN, "x", "y").withColumn("auc", r6("auc"))


@query("partition_edge_summary", G3 + f", s AS (SELECT {RUNSQL}, avg(CASE WHEN (i >= 2) = (j >= 2) THEN w END) AS a, avg(CASE WHEN (i >= 2) <> (j >= 2) THEN w END) AS b FROM ge GROUP BY ALL) SELECT {RUNSQL}, round(a, 6) + 0.0 AS within, round(b, 6) + 0.0 AS between, round(a - b, 6) + 0.0 AS difference, round((a - b) / a, 6) + 0.0 AS segregation FROM s")
def _(spark, d):
    return gr.edge_summary(_graph(spark, d), RUN, PART).withColumns({c: r6(c) for c in ("within", "between", "difference", "segregation")})


# inference

DIFFSQL = OCCSQL + ", pr AS (SELECT subject, 'state_' || state AS endpoint, max(CASE WHEN session = 'F' THEN occupancy END) - max(CASE WHEN session = 'O' THEN occupancy END) AS diff FROM oc GROUP BY ALL HAVING count(DISTINCT session) = 2)"
FLIPSQL = DIFFSQL + """, fl AS (SELECT endpoint, c, sum(diff * CASE WHEN (c >> i) & 1 = 1 THEN -1 ELSE 1 END) AS t, sum(diff) AS o, count(*) AS n FROM
 (SELECT endpoint, diff, (row_number() OVER (PARTITION BY endpoint ORDER BY subject) - 1)::INT AS i, unnest(range(1 << (count(*) OVER (PARTITION BY endpoint))::INT)) AS c FROM pr) GROUP BY ALL),
sf AS (SELECT endpoint, n::INT AS n, max(o) / any_value(n) AS estimate, avg((abs(t) >= abs(o) - 1e-9)::INT) AS p FROM fl GROUP BY endpoint, n),
bh AS (SELECT *, min(a) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM (SELECT *, least(1, p * count(*) OVER () / row_number() OVER (ORDER BY p, endpoint)) AS a, row_number() OVER (ORDER BY p, endpoint) AS r FROM sf))"""


def _endpoints(spark, d):
    return st.occupancy(_labels(spark, d), 3).select(*RUN, F.concat(F.lit("state_"), F.col("state")).alias("endpoint"), F.col("occupancy").alias("value"))


@query("paired_endpoints", DIFFSQL + "SELECT endpoint, subject, round(diff, 6) + 0.0 AS diff FROM pr")
def _(spark, d):
    return nf.paired(_endpoints(spark, d), "F", "O").withColumn("diff", r6("diff"))


@query("sign_flip_exact", FLIPSQL + "SELECT endpoint, n, round(estimate, 6) + 0.0 AS estimate, round(p, 6) + 0.0 AS p FROM sf")
def _(spark, d):
    return nf.sign_flip_exact(nf.paired(_endpoints(spark, d), "F", "O")).withColumns({"estimate": r6("estimate"), "p": r6("p")})


@query("bh_fdr", FLIPSQL + "SELECT endpoint, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM bh")
def _(spark, d):
    rows = nf.sign_flip_exact(nf.paired(_endpoints(spark, d), "F", "O")).withColumn("family", F.lit("states"))
    return nf.bh(rows, ["family"]).select("endpoint", r6("p").alias("p"), r6("q").alias("q"))


@query("result_families", FLIPSQL + "SELECT endpoint AS result_id, 'occupancy' AS fdr_family, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, CASE WHEN q < 0.05 THEN 'positive' ELSE 'negative' END AS result_status FROM bh")
def _(spark, d):
    rows = nf.sign_flip_exact(nf.paired(_endpoints(spark, d), "F", "O")).select(F.col("endpoint").alias("result_id"), F.lit("occupancy").alias("fdr_family"), "p")
    return nf.result_families(rows).withColumns({"p": r6("p"), "q": r6("q")})


@query("intercept_t", DIFFSQL + "SELECT endpoint, count(*)::BIGINT AS n, round(avg(diff), 6) + 0.0 AS mean, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) + 0.0 AS t FROM pr GROUP BY ALL")
def _(spark, d):
    return nf.intercept_t(nf.paired(_endpoints(spark, d), "F", "O")).withColumns({"mean": r6("mean"), "t": r6("t")})


@query("hc3_simple", """WITH b AS (SELECT *, count(*) OVER q AS n, x - avg(x) OVER q AS cx, y - avg(y) OVER q AS cy, avg(x) OVER q AS mx, avg(y) OVER q AS my FROM (SELECT s_nationkey % 3 AS g, s_suppkey::DOUBLE AS x, s_acctbal AS y FROM supplier) WINDOW q AS (PARTITION BY g)),
c AS (SELECT *, sum(cx*cx) OVER q AS sxx, sum(cx*cy) OVER q / sum(cx*cx) OVER q AS slope FROM b WINDOW q AS (PARTITION BY g))
SELECT g::BIGINT AS g, max(n)::BIGINT AS n, round(max(slope), 6) + 0.0 AS slope, round(max(my) - max(slope) * max(mx), 6) + 0.0 AS intercept, round(sqrt(sum(((cy - slope*cx) / (1 - 1 / n - cx*cx/sxx)) ** 2 * cx * cx)) / max(sxx), 6) + 0.0 AS slope_se FROM c GROUP BY g""", panel=False)
def _(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("long").alias("g"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return nf.hc3_simple(rows, ["g"], "x", "y").withColumns({c: r6(c) for c in ("slope", "intercept", "slope_se")})


# templates and quality control

@query("feature_template", fc_sql(HAMMING) + ", sm AS (SELECT subject, i, j, avg(z) AS m FROM fc GROUP BY ALL) SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS feature_idx, round(avg(m), 6) + 0.0 AS template, count(*)::BIGINT AS n_subjects FROM sm GROUP BY i, j")
def _(spark, d):
    return tm.feature_template(_features(spark, d)).withColumn("template", r6("template"))


SIMSQL = "SELECT subject, session, segment_id, start_frame, round(corr(z, t), 6) + 0.0 AS similarity FROM fc JOIN {t} GROUP BY ALL"


@query("pattern_similarity", fc_sql(HAMMING) + ", sm AS (SELECT subject, i, j, avg(z) AS m FROM fc GROUP BY ALL), tp AS (SELECT i, j, avg(m) AS t FROM sm GROUP BY ALL) " + SIMSQL.format(t="tp USING (i, j)"))
def _(spark, d):
    rows = _features(spark, d)
    return tm.pattern_similarity(rows, tm.feature_template(rows), [*sg.SEGMENT, "start_frame"]).withColumn("similarity", r6("similarity"))


@query("loo_similarity", fc_sql(HAMMING) + ", sm AS (SELECT subject, i, j, avg(z) AS m FROM fc GROUP BY ALL), tp AS (SELECT subject, i, j, (sum(m) OVER q - m) / (count(*) OVER q - 1) AS t FROM sm WINDOW q AS (PARTITION BY i, j)) " + SIMSQL.format(t="tp USING (subject, i, j)"))
def _(spark, d):
    return tm.loo_similarity(_features(spark, d), [*sg.SEGMENT, "start_frame"]).withColumn("similarity", r6("similarity"))


@query("balanced_quantiles", """, v AS (SELECT subject, x AS value, 1 / count(*) OVER (PARTITION BY subject) AS w, row_number() OVER (ORDER BY x, subject, session, frame) AS o FROM panel WHERE roi_idx = 0),
c AS (SELECT o, value, (sum(w) OVER (ORDER BY o) - w / 2) / sum(w) OVER () AS pos FROM v), l AS (SELECT *, lead(pos) OVER (ORDER BY o) AS npos, lead(value) OVER (ORDER BY o) AS nval FROM c)
SELECT p::DOUBLE AS probability, round(max(CASE WHEN npos IS NULL OR pos > p THEN value ELSE value + (p - pos) / (npos - pos) * (nval - value) END), 3) + 0.0 AS quantile
FROM l, (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS p) WHERE (p >= pos AND p < coalesce(npos, 2)) OR (o = 1 AND p < pos) GROUP BY p""")
def _(spark, d):
    rows = order_panel(spark, d).filter("roi_idx = 0").select("subject", F.col("x").alias("value"))
    return tm.balanced_quantiles(rows, [0.0, 0.25, 0.5, 0.9, 1.0]).select("probability", (F.round("quantile", 3) + 0.0).alias("quantile"))


@query("window_motion", f""", fd AS (SELECT subject, session, frame, sum(n)::DOUBLE AS fd FROM cell GROUP BY ALL), w AS (SELECT subject, session, start_frame + o AS start_frame, start_frame + o + {L - 1} AS end_frame FROM (SELECT *, unnest(range(0, n_frames - {L} + 1, {S})) AS o FROM segtab WHERE n_frames >= {L}))
SELECT w.subject, w.session, start_frame, end_frame, round(avg(fd), 6) + 0.0 AS mean_fd, round(quantile_cont(fd, 0.95), 6) + 0.0 AS p95_fd, max(fd) AS max_fd, count(fd)::BIGINT AS n_finite FROM w JOIN fd ON fd.subject = w.subject AND fd.session = w.session AND frame BETWEEN start_frame AND end_frame GROUP BY ALL""")
def _(spark, d):
    motion = order_cells(spark, d).groupBy(*RUN, "frame").agg(F.sum("n").cast("double").alias("fd"))
    windows = sg.window_table(order_panel(spark, d), L, S).select(*RUN, "start_frame", "end_frame")
    return tm.window_motion(motion, windows, RUN).withColumns({"mean_fd": r6("mean_fd"), "p95_fd": r6("p95_fd")})


@query("match_candidates", "WITH l AS (SELECT (c_nationkey % 5)::VARCHAR AS subject, c_custkey AS idx, c_acctbal AS cov FROM customer WHERE c_mktsegment = 'BUILDING'), r AS (SELECT (c_nationkey % 5)::VARCHAR AS subject, c_custkey AS idx, c_acctbal AS cov FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT subject, l.idx AS left_idx, r.idx AS right_idx, round(abs(l.cov - r.cov) / 50, 6) + 0.0 AS cost FROM l JOIN r USING (subject) WHERE abs(l.cov - r.cov) <= 50", panel=False)
def _(spark, d):
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("subject"), F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("cov"), "c_mktsegment")
    return tm.match_candidates(c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_mktsegment = 'MACHINERY'"), 50.0).withColumn("cost", r6("cost"))


@query("store_means", fc_sql(HAMMING) + f"SELECT {RUNSQL}, i, j, round(avg(z), 6) + 0.0 AS mean, count(*)::BIGINT AS n FROM fc GROUP BY ALL")
def _(spark, d):
    return cn.window_fc(order_panel(spark, d), L, S).groupBy(*RUN, "i", "j").agg(r6(F.avg("z")).alias("mean"), F.count("*").alias("n"))


@query("contract_check", "SELECT count(DISTINCT (subject, session))::BIGINT AS runs, count(DISTINCT roi_idx)::BIGINT AS channels, bool_and(isfinite(x)) AS finite FROM panel")
def _(spark, d):
    ok = F.bool_and(~F.isnan("x") & F.col("x").isNotNull())
    return order_panel(spark, d).agg(F.countDistinct("subject", "session").alias("runs"), F.countDistinct("roi_idx").alias("channels"), ok.alias("finite"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of fixed states over six-frame windows, on the small panel."""
    panel = order_panel(spark, sf_dir, subjects=3)
    rows = st.features(cn.window_fc(panel, 6, 1), [*sg.SEGMENT, "start_frame", "end_frame"])
    return st.occupancy(st.assigned(rows, CENTRES), 3)


# numeric kernels: checked by rows here, by values in tests


@query("lowrank_windows")
def _(spark, d):
    return gp.lowrank_windows(order_panel(spark, d), L, S, (1, 2)).drop("basis")


@query("subspace_similarity_adjacent")
def _(spark, d):
    return gp.adjacent_similarity(gp.lowrank_windows(order_panel(spark, d), L, S, (1, 2)))


@query("mean_projector_basis")
def _(spark, d):
    return gp.run_bases(gp.lowrank_windows(order_panel(spark, d), L, S, (1, 2)))


@query("block_information")
def _(spark, d):
    return gp.window_information(order_panel(spark, d), L, S, [0, 1], [2, 3], [4])


@query("fixed_window_samples")
def _(spark, d):
    return gp.fixed_window_samples(order_panel(spark, d), L, 5, 17)


@query("fixed_window_replay")
def _(spark, d):
    panel = order_panel(spark, d)
    return gp.replayed(panel, gp.fixed_window_samples(panel, L, 5, 17))


@query("match_within_subject")
def _(spark, d):
    c = table(spark, d, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("subject"), F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("cov"), "c_mktsegment")
    return gp.matched_within_subject(c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_mktsegment = 'MACHINERY'"), 50.0)


@query("sign_flip_mc_bootstrap")
def _(spark, d):
    return gp.resampled(nf.paired(_endpoints(spark, d), "F", "O"), 2000, 7)


@query("kmeans_fit")
def _(spark, d):
    rows = _features(spark, d)
    return st.occupancy(st.assigned(rows, gp.kmeans_fit(rows, 3, 11)), 3)


@query("hmm_decode")
def _(spark, d):
    rows = _features(spark, d)
    return gp.hmm_decode(rows, gp.hmm_fit(rows, 2, 11))


@query("hmm_score")
def _(spark, d):
    rows = _features(spark, d)
    return gp.hmm_score(rows, gp.hmm_fit(rows, 2, 11))


@query("paired_nbs")
def _(spark, d):
    edges = cn.static_correlation(order_panel(spark, d)).select(*RUN, F.concat_ws("-", "i", "j").alias("endpoint"), F.col("r").alias("value"))
    diffs = nf.paired(edges, "F", "O").select("subject", F.split("endpoint", "-")[0].cast("int").alias("i"), F.split("endpoint", "-")[1].cast("int").alias("j"), "diff")
    return gp.nbs(diffs, 1.5, 99, 5)


# further relational queries


@query("store_subject_filter", fc_sql(HAMMING) + f"SELECT {SEGSQL}, start_frame, i, j, round(z, 6) + 0.0 AS z FROM fc WHERE subject IN ('1', '4')")
def _(spark, d):
    rows = cn.window_fc(order_panel(spark, d), L, S).filter(F.col("subject").isin("1", "4"))
    return rows.select(*sg.SEGMENT, "start_frame", "i", "j", r6("z").alias("z"))


@query("store_slice", fc_sql(HAMMING) + f", ix AS (SELECT *, (dense_rank() OVER (PARTITION BY {SEGSQL} ORDER BY start_frame) - 1)::INT AS sample_idx FROM fc) SELECT {SEGSQL}, sample_idx, i, j, round(z, 6) + 0.0 AS z FROM ix WHERE sample_idx BETWEEN 1 AND 3")
def _(spark, d):
    rank = (F.dense_rank().over(Window.partitionBy(*sg.SEGMENT).orderBy("start_frame")) - 1).cast("int")
    rows = cn.window_fc(order_panel(spark, d), L, S).withColumn("sample_idx", rank).filter("sample_idx between 1 and 3")
    return rows.select(*sg.SEGMENT, "sample_idx", "i", "j", r6("z").alias("z"))


SPECTRUMSQL = ", v AS (SELECT subject, session, roi_idx, var_pop(x) AS v FROM panel GROUP BY ALL), p AS (SELECT subject, session, v / sum(v) OVER q AS p, row_number() OVER (PARTITION BY subject, session ORDER BY v DESC, roi_idx) AS k FROM v WINDOW q AS (PARTITION BY subject, session)) "


def _spectrum(spark, d):
    """Channel variances of each run as a spectrum: proportion p of rank k."""
    v = order_panel(spark, d).groupBy(*RUN, "roi_idx").agg(F.var_pop("x").alias("v"))
    own = Window.partitionBy(*RUN)
    return v.withColumns({"p": F.col("v") / F.sum("v").over(own), "k": F.row_number().over(own.orderBy(F.col("v").desc(), "roi_idx"))})


@query("effective_rank_fixed_spectrum", SPECTRUMSQL + f"SELECT {RUNSQL}, round(exp(-sum(p * ln(p))), 6) + 0.0 AS effective_rank FROM p WHERE p > 0 GROUP BY ALL")
def _(spark, d):
    return _spectrum(spark, d).filter("p > 0").groupBy(*RUN).agg(r6(F.exp(-F.sum(F.col("p") * F.log("p")))).alias("effective_rank"))


@query("eigen_concentration", SPECTRUMSQL + f"SELECT {RUNSQL}, round(sum(p), 6) + 0.0 AS concentration FROM p WHERE k <= 2 GROUP BY ALL")
def _(spark, d):
    return _spectrum(spark, d).filter("k <= 2").groupBy(*RUN).agg(r6(F.sum("p")).alias("concentration"))


@query("subject_disjoint_check", "SELECT count(*)::BIGINT AS shared FROM (SELECT DISTINCT subject FROM keep WHERE subject < '5') a JOIN (SELECT DISTINCT subject FROM keep WHERE subject >= '4') b USING (subject)")
def _(spark, d):
    panel = order_panel(spark, d).select("subject").distinct()
    return panel.filter("subject < '5'").join(panel.filter("subject >= '4'"), "subject", "left_semi").agg(F.count("*").alias("shared"))


@query("nbs_components", GRSQL.format(target=10) + """, ed AS (SELECT i, j, avg(w) AS w FROM ge GROUP BY ALL), pk AS (SELECT i, j FROM (SELECT *, row_number() OVER (ORDER BY w DESC, i, j) AS r FROM ed) WHERE r <= 3),
bo AS (SELECT i AS node, j AS other FROM pk UNION SELECT j, i FROM pk), re AS (SELECT node, other FROM bo), r2 AS (SELECT a.node, b.other FROM bo a JOIN bo b ON a.other = b.node UNION SELECT * FROM re), r4 AS (SELECT a.node, b.other FROM r2 a JOIN r2 b ON a.other = b.node UNION SELECT * FROM r2)
SELECT node, least(node, min(other))::INT AS component FROM r4 GROUP BY node""")
def _(spark, d):
    mean = _graph(spark, d).groupBy("i", "j").agg(F.avg("w").alias("w")).orderBy(F.col("w").desc(), "i", "j").limit(3)
    return nf.components(mean.select("i", "j"), 5)


@query("information_session_summary")
def _(spark, d):
    rows = gp.window_information(order_panel(spark, d), L, S, [0, 1], [2, 3], [4])
    return rows.groupBy(*RUN).agg(F.avg("mi").alias("mean_mi"), F.stddev_pop("mi").alias("sd_mi"), F.avg("cmi").alias("mean_cmi"), F.stddev_pop("cmi").alias("sd_cmi"), F.count("*").alias("n"))
