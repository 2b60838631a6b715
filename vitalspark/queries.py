"""Registered queries over the driver tables, and the DuckDB SQL of each that SQL can express.

Every statistical query reads the canonical cohort (sources.tables). Floating results are rounded on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cohort import CohortSpec, att_weight, ate_weight, atc_weight, min_max, one_hot, reallocate, signed_time, split_control, split_uniform, violations, zscore
from .functions.stats import repair_bounds
from .operators import etl, report
from .operators.cox import SUMMARY_SCHEMA, fit_binary, packed_time_table, fit_cox, sandwich, summary_rows, time_table
from .operators.fedavg import fit_fed_avg
from .operators.km import center_event_table, center_risk_table, event_table, kaplan_meier, on_grid, regular_grid, with_confidence
from .operators.logit import fit_logit
from .operators.maic import fit_maic, maic_targets
from .operators.metrics import accuracy, concordance
from .operators.moments import arm_moments, effective_sample_size, merged_moments, smd, variance_ratio
from .operators.privacy import ORDERS, PrivacyLedger, fit_private_logit
from .operators.quantiles import exact_quantiles
from .operators.resample import bootstrap_metric, bootstrap_variance, draw_multiplicities, draws_packed, poisson_packed, replicate, valid_replicates
from .operators.simulate import CoxSimulator
from .plans import unrolled
from .plans.estimators import CovariateAdjusted, ExternalControlAnalysis, MatchingAdjusted, NaiveComparison, PooledIPTW
from .sources.scratch import settle, shared_dir
from .sources.states import CentreStates
from .sources.tables import COHORT_SQL, COVARIATES, clean_name, clinical_violations, cohort, fingerprint, label_parts, left_join_all, portable_fingerprint, table

SPEC = CohortSpec(covariates=COVARIATES)
CENTERS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C1 = f"WITH c1 AS ({COHORT_SQL})"
_ATE = "(treated / ps + (1 - treated) / (1 - ps))"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select([F.round(F.col(f"`{c}`"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def weighted(spark: SparkSession, sf: str) -> tuple[DataFrame, CohortSpec]:
    return cohort(spark, sf).withColumn("w", ate_weight("treated", F.col("ps"), None)), SPEC.weighted("w")


# ---------------------------------------------------------------- Kaplan-Meier

_EVENTS = """, ev AS (SELECT treated, time, sum({w}) AS leaving, sum({w} * event) AS events FROM c1 GROUP BY treated, time),
er AS (SELECT treated, time, sum(leaving) OVER (PARTITION BY treated ORDER BY time DESC) AS at_risk, events FROM ev),
km AS (SELECT *, product(1 - events / at_risk) OVER (PARTITION BY treated ORDER BY time) AS survival,
  CASE WHEN max(CASE WHEN at_risk = events THEN 1 ELSE 0 END) OVER (PARTITION BY treated ORDER BY time) = 0
       THEN sum(events / nullif(at_risk * (at_risk - events), 0)) OVER (PARTITION BY treated ORDER BY time) END AS cum_greenwood FROM er)"""
_ONE = _EVENTS.format(w="CAST(1 AS double)")
_W = _EVENTS.format(w=_ATE)
_KM = "SELECT treated, time, round({a}, 6) AS at_risk, round({e}, 6) AS events, round(survival, 6) AS survival, round(cum_greenwood, 6) AS cum_greenwood, round(survival * survival * cum_greenwood, 6) AS var_survival FROM km"


def _curve(df: DataFrame) -> DataFrame:
    return rounded(df.select("treated", "time", "at_risk", "events", "survival", "cum_greenwood", "var_survival"))


@query("km_unweighted", C1 + _ONE + _KM.format(a="at_risk", e="events"))
def km_unweighted(spark, sf):
    return _curve(kaplan_meier(cohort(spark, sf), SPEC))


@query("km_weighted", C1 + _W + _KM.format(a="at_risk", e="events"))
def km_weighted(spark, sf):
    df, spec = weighted(spark, sf)
    return _curve(kaplan_meier(df, spec))


_CI = """, ci AS (SELECT *, ln(-ln(CASE WHEN survival > 0 AND survival < 1 THEN survival END)) AS v,
  1.959963984540054 * sqrt(cum_greenwood) / abs(ln(CASE WHEN survival > 0 AND survival < 1 THEN survival END)) AS half FROM km)
SELECT treated, time, round(survival, 6) AS survival, round(CASE WHEN survival >= 1 THEN 1 ELSE exp(-exp(v + half)) END, 6) AS ci_low,
  round(CASE WHEN survival >= 1 THEN 1 ELSE exp(-exp(v - half)) END, 6) AS ci_high FROM ci"""


@query("km_ci_loglog", C1 + _ONE + _CI)
def km_ci_loglog(spark, sf):
    return rounded(with_confidence(kaplan_meier(cohort(spark, sf), SPEC)).select("treated", "time", "survival", "ci_low", "ci_high"))


@query("km_ci_plain", C1 + _ONE + """ SELECT treated, time, round(least(survival, survival - 1.959963984540054 * sqrt(survival * survival * cum_greenwood)), 6) AS ci_low,
  round(greatest(survival, survival + 1.959963984540054 * sqrt(survival * survival * cum_greenwood)), 6) AS ci_high FROM km WHERE cum_greenwood IS NOT NULL""")
def km_ci_plain(spark, sf):
    curve = with_confidence(kaplan_meier(cohort(spark, sf), SPEC), method="greenwood").where("cum_greenwood is not null")
    low, high = repair_bounds(F.col("survival"), F.col("ci_low"), F.col("ci_high"))
    return rounded(curve.select("treated", "time", low.alias("ci_low"), high.alias("ci_high")))


@query("km_on_grid", C1 + _ONE + """, e AS (SELECT treated, max(time) AS m FROM km GROUP BY treated),
g AS (SELECT treated, k * m / 20 AS time FROM e, (SELECT unnest(generate_series(0, 20)) AS k)),
j AS (SELECT g.treated, g.time, arg_max(km.survival, km.time) AS s FROM g LEFT JOIN km ON km.treated = g.treated AND km.time <= g.time GROUP BY 1, 2)
SELECT treated, round(time, 6) AS time, round(coalesce(s, 1), 6) AS survival FROM j""")
def km_on_grid(spark, sf):
    curve = kaplan_meier(cohort(spark, sf), SPEC).persist()
    return rounded(on_grid(curve, regular_grid(curve, 20, ["treated"]), ["treated"]).select("treated", "time", "survival"))


@query("event_table", C1 + _ONE + "SELECT treated, time, at_risk, events FROM er")
def event_table_by_arm(spark, sf):
    return event_table(cohort(spark, sf), SPEC, ["treated"])


@query("event_table_by_center", C1 + ", e AS (SELECT time, " + ", ".join(f"CAST(sum(CASE WHEN center = '{c}' THEN 1 ELSE 0 END) AS double) AS \"{c}\"" for c in CENTERS) + ", CAST(count(*) AS double) AS events FROM c1 WHERE event = 1 GROUP BY time) SELECT * FROM e")
def event_table_by_center(spark, sf):
    return center_event_table(cohort(spark, sf), SPEC, CENTERS)


@query("risk_set", C1 + """, t AS (SELECT time, sum(exp(0.1 * x_lines)) AS s0, sum(x_lines * exp(0.1 * x_lines)) AS s1, sum(x_lines * x_lines * exp(0.1 * x_lines)) AS s2 FROM c1 GROUP BY time)
SELECT time, round(sum(s0) OVER w, 4) AS s0, round(sum(s1) OVER w, 4) AS s1, round(sum(s2) OVER w, 4) AS s2 FROM t WINDOW w AS (ORDER BY time DESC)""")
def risk_set(spark, sf):
    from .operators.scan import suffix_sum

    r, x = F.exp(F.lit(0.1) * F.col("x_lines")), F.col("x_lines")
    at = cohort(spark, sf).groupBy("time").agg(F.sum(r).alias("s0"), F.sum(x * r).alias("s1"), F.sum(x * x * r).alias("s2"))
    return rounded(suffix_sum(at, [], "time", ["s0", "s1", "s2"]), 4)


@query("km_by_center", C1 + """, ev AS (SELECT center, time, count(*) AS leaving, CAST(sum(event) AS double) AS events FROM c1 GROUP BY center, time),
er AS (SELECT center, time, sum(leaving) OVER (PARTITION BY center ORDER BY time DESC) AS at_risk, events FROM ev)
SELECT center, time, round(product(1 - events / at_risk) OVER (PARTITION BY center ORDER BY time), 6) AS survival FROM er""")
def km_by_center(spark, sf):
    return rounded(kaplan_meier(cohort(spark, sf), SPEC, ["center"]).select("center", "time", "survival"))


# ---------------------------------------------------------------- moments, balance

_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT treated, center, '{c}' AS covariate, CAST({c} AS double) AS x, {_ATE} AS w FROM c1" for c in COVARIATES) + ")"
_ARMS = _LONG + """, arm AS (SELECT treated, covariate, count(x) AS n, sum(w) AS sum_w, sum(w * w) AS sum_w2, avg(x) AS mean, var_pop(x) AS var,
  sum(w * x) / sum(w) AS w_mean, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)) AS w_var FROM long GROUP BY treated, covariate)"""


@query("risk_by_center", C1 + ", e AS (SELECT time, " + ", ".join(f"CAST(sum(CASE WHEN center = '{c}' THEN 1 ELSE 0 END) AS double) AS \"{c}\"" for c in CENTERS) + " FROM c1 GROUP BY time), r AS (SELECT time, " + ", ".join(f'sum("{c}") OVER (ORDER BY time DESC) AS "{c}"' for c in CENTERS) + ' FROM e) SELECT *, ' + " + ".join(f'"{c}"' for c in CENTERS) + " AS at_risk FROM r")
def risk_by_center(spark, sf):
    return center_risk_table(cohort(spark, sf), SPEC, CENTERS)


@query("moments_by_arm", C1 + _ARMS + " SELECT treated, covariate, n, round(sum_w, 4) AS sum_w, round(sum_w2, 4) AS sum_w2, round(mean, 6) AS mean, round(var, 6) AS var, round(w_mean, 6) AS w_mean, round(w_var, 6) AS w_var FROM arm")
def moments_by_arm(spark, sf):
    df, spec = weighted(spark, sf)
    m = arm_moments(df, spec, COVARIATES).drop("is_binary")
    return rounded(m.withColumns({"sum_w": F.round("sum_w", 4), "sum_w2": F.round("sum_w2", 4)}))


@query("moments_merged", C1 + _LONG + " SELECT covariate, count(x) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM long GROUP BY covariate")
def moments_merged(spark, sf):
    return rounded(merged_moments(arm_moments(cohort(spark, sf), SPEC, COVARIATES, ["center"]), ["covariate"]))


@query("zscore", C1 + ", m AS (SELECT avg(x_lines) AS a, var_samp(x_lines) AS v, avg(x_bal) AS b, var_samp(x_bal) AS u FROM c1) SELECT patient_id, round((x_lines - a) / sqrt(v), 6) AS x_lines, round((x_bal - b) / sqrt(u), 6) AS x_bal FROM c1, m")
def zscored(spark, sf):
    return rounded(zscore(cohort(spark, sf).select("patient_id", "x_lines", "x_bal"), ["x_lines", "x_bal"]))


_SMD = _ARMS + """, p AS (SELECT a.covariate, b.mean - a.mean AS d, b.w_mean - a.w_mean AS wd, sqrt((a.var + b.var) / 2) AS s,
  sqrt((a.w_var * a.sum_w * a.sum_w / (a.sum_w * a.sum_w - a.sum_w2) + b.w_var * b.sum_w * b.sum_w / (b.sum_w * b.sum_w - b.sum_w2)) / 2) AS ws
  FROM arm a JOIN arm b ON a.covariate = b.covariate AND a.treated = 0 AND b.treated = 1)"""


@query("smd_raw", C1 + _SMD + " SELECT covariate, round(d / s, 6) AS smd_raw FROM p")
def smd_raw(spark, sf):
    return rounded(smd(cohort(spark, sf), SPEC, COVARIATES).select("covariate", "smd_raw"))


@query("smd_weighted", C1 + _SMD + " SELECT covariate, round(wd / s, 6) AS smd_weighted FROM p")
def smd_weighted(spark, sf):
    df, spec = weighted(spark, sf)
    return rounded(smd(df, spec, COVARIATES).select("covariate", "smd_weighted"))


@query("smd_weighted_var", C1 + _SMD + " SELECT covariate, round(wd / ws, 6) AS smd_weighted_var FROM p")
def smd_weighted_var(spark, sf):
    df, spec = weighted(spark, sf)
    return rounded(smd(df, spec, COVARIATES).select("covariate", "smd_weighted_var"))


@query("smd_pooled_pct", C1 + _LONG + """, a AS (SELECT treated, covariate, avg(x) AS m, CASE WHEN covariate = 'x_urgent' THEN avg(x) * (1 - avg(x)) ELSE var_samp(x) END AS v FROM long GROUP BY treated, covariate)
SELECT a.covariate, round(100 * (b.m - a.m) / sqrt((a.v + b.v) / 2), 4) AS smd_pct FROM a JOIN a b ON a.covariate = b.covariate AND a.treated = 0 AND b.treated = 1""")
def smd_pooled_pct(spark, sf):
    out = smd(cohort(spark, sf), SPEC, COVARIATES, ddof=1, scale=100.0, binary=True)
    return rounded(out.select("covariate", F.col("smd_raw").alias("smd_pct")), 4)


@query("ess", C1 + f" SELECT treated, round(sum({_ATE}) * sum({_ATE}) / sum({_ATE} * {_ATE}), 4) AS ess FROM c1 GROUP BY treated")
def ess(spark, sf):
    df, _ = weighted(spark, sf)
    return rounded(effective_sample_size(df, F.col("w"), ["treated"]), 4)


@query("variance_ratio", C1 + " SELECT round(var_pop(x_lines) / var_pop(x_bal), 6) AS variance_ratio FROM c1")
def variance_ratio_query(spark, sf):
    return rounded(variance_ratio(cohort(spark, sf), F.col("x_lines"), F.col("x_bal")))


@query("quality_checks", C1 + " SELECT count(*) AS n_rows, CAST(0 AS bigint) AS bad_event, CAST(0 AS bigint) AS bad_treated, count(*) FILTER (event = 1 AND time <= 0) AS nonpositive_event_time, count(*) FILTER (time IS NULL) AS missing_time, count(*) FILTER (x_lines IS NULL OR x_bal IS NULL OR x_urgent IS NULL) AS missing_covariate FROM c1")
def quality_checks(spark, sf):
    return violations(cohort(spark, sf), SPEC)


@query("signed_time", C1 + " SELECT patient_id, abs(time) * (2 * event - 1) AS y FROM c1")
def signed_times(spark, sf):
    return cohort(spark, sf).select("patient_id", signed_time(SPEC).alias("y"))


# ---------------------------------------------------------------- weights


@query("iptw_ate", C1 + f" SELECT patient_id, round({_ATE}, 6) AS w FROM c1")
def iptw_ate(spark, sf):
    return rounded(cohort(spark, sf).select("patient_id", ate_weight("treated", F.col("ps")).alias("w")))


@query("iptw_att", C1 + " SELECT patient_id, round(treated + ps * (1 - treated) / (1 - ps), 6) AS w FROM c1")
def iptw_att(spark, sf):
    return rounded(cohort(spark, sf).select("patient_id", att_weight("treated", F.col("ps")).alias("w")))


@query("iptw_atc", C1 + " SELECT patient_id, round((1 - treated) + (1 - ps) * treated / ps, 6) AS w FROM c1")
def iptw_atc(spark, sf):
    return rounded(cohort(spark, sf).select("patient_id", atc_weight("treated", F.col("ps")).alias("w")))


@query("weights_histogram", C1 + f", w AS (SELECT {_ATE} AS w FROM c1) SELECT CAST(CASE WHEN w = 7 THEN 25 ELSE floor((w - 1) / CAST(0.24 AS double)) + 1 END AS int) AS bin, count(*) AS n FROM w WHERE w >= 1 AND w <= 7 GROUP BY 1")
def weights_histogram(spark, sf):
    df, _ = weighted(spark, sf)
    return report.histogram(df, F.col("w"), 1, 7, 25)


# ---------------------------------------------------------------- propensity model (one covariate for the SQL form)

def _logit_sql(steps: int = 12) -> str:
    out = C1 + ", b0 AS (SELECT CAST(0 AS double) AS a, CAST(0 AS double) AS b)"
    for k in range(steps):
        out += f""", s{k} AS (SELECT sum(treated - p) AS g0, sum((treated - p) * x_lines) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x_lines) AS h01, sum(p * (1 - p) * x_lines * x_lines) AS h11
 FROM (SELECT treated, x_lines, 1 / (1 + exp(-(a + b * x_lines))) AS p FROM c1, b{k})),
b{k + 1} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM b{k}, s{k})"""
    return out


_PS = _logit_sql() + ", ps1 AS (SELECT c1.patient_id, c1.center, c1.time, c1.event, c1.treated, 1 / (1 + exp(-(a + b * x_lines))) AS p FROM c1, b12)"


@query("logit_irls", _logit_sql() + " SELECT round(a, 5) AS intercept, round(b, 5) AS x_lines FROM b12")
def logit_irls(spark, sf):
    m = fit_logit(cohort(spark, sf), ["x_lines"], "treated")
    return rounded(spark.createDataFrame([m.coef], "intercept double, x_lines double"), 5)


_LOGIT4 = C1 + ", l4 AS (SELECT *, CAST(treated AS double) AS y, CAST(1 AS double) AS x0, x_lines AS x1, x_bal AS x2, CAST(x_urgent AS double) AS x3 FROM c1)" + unrolled.logit("l4", 4, "l")


@query("logit_multi", _LOGIT4 + " " + " UNION ALL ".join(f"SELECT '{c}' AS term, round(b{k}, 5) AS coef FROM ln9" for k, c in enumerate(("intercept", *COVARIATES))))
def logit_multi(spark, sf):
    m = fit_logit(cohort(spark, sf), COVARIATES, "treated")
    return rounded(spark.createDataFrame(list(zip(("intercept", *m.features), m.coef)), "term string, coef double"), 5)


@query("propensity_scores", _PS + " SELECT patient_id, round(p, 5) AS ps, round(treated / p + (1 - treated) / (1 - p), 4) AS w FROM ps1")
def propensity_scores(spark, sf):
    df = cohort(spark, sf)
    m = fit_logit(df, ["x_lines"], "treated")
    df = df.withColumn("p", m.probability())
    return df.select("patient_id", F.round("p", 5).alias("ps"), F.round(ate_weight("treated", F.col("p")), 4).alias("w"))


@query("accuracy", _PS + " SELECT round(avg(CAST((CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = treated AS int)), 6) AS accuracy FROM ps1")
def accuracy_query(spark, sf):
    df = cohort(spark, sf)
    return rounded(accuracy(df, fit_logit(df, ["x_lines"], "treated").probability(), "treated"))


# ---------------------------------------------------------------- Cox, binary treatment

def _cox_sql(weight: str, source: str = "c1", by: str = "", steps: int = 10, head: str = C1) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    out = head + f""", tt AS (SELECT {key}time, sum(CASE WHEN treated = 0 THEN {weight} ELSE 0 END) AS q0, sum(CASE WHEN treated = 1 THEN {weight} ELSE 0 END) AS q1,
  sum({weight} * event) AS dw, sum({weight} * event * treated) AS dwx FROM {source} GROUP BY {key}time),
rt AS (SELECT {key}sum(q0) OVER ({part}ORDER BY time DESC) AS r0, sum(q1) OVER ({part}ORDER BY time DESC) AS r1, dw, dwx FROM tt),
ct AS (SELECT * FROM rt WHERE dw > 0), n0 AS (SELECT DISTINCT {key}CAST(0 AS double) AS beta, CAST(0 AS double) AS h FROM ct)"""
    join = f" JOIN n{{k}} USING ({by})" if by else ", n{k}"
    for k in range(steps):
        out += f", n{k + 1} AS (SELECT {key}any_value(beta) + sum(dwx - dw * s) / sum(dw * s * (1 - s)) AS beta, sum(dw * s * (1 - s)) AS h FROM (SELECT {key}beta, dw, dwx, exp(beta) * r1 / (r0 + exp(beta) * r1) AS s FROM ct{join.format(k=k)}) {f'GROUP BY {by}' if by else ''})"
    return out


@query("cox_iptw", _cox_sql(_ATE) + " SELECT round(beta, 5) AS coef, round(1 / sqrt(h), 5) AS se FROM n10")
def cox_iptw(spark, sf):
    df, spec = weighted(spark, sf)
    beta, info, _, _ = fit_binary(time_table(df, spec, F.col("treated")))[None]
    return rounded(spark.createDataFrame([(beta, info**-0.5)], "coef double, se double"), 5)


@query("cox_iptw_estimated", _cox_sql("(treated / p + (1 - treated) / (1 - p))", "ps1", head=_PS) + " SELECT 'treated' AS covariate, round(beta, 4) AS coef, round(1 / sqrt(h), 4) AS se, round(exp(beta), 4) AS exp_coef FROM n10")
def cox_iptw_estimated(spark, sf):
    result = ExternalControlAnalysis(SPEC, propensity_columns=["x_lines"]).fit(cohort(spark, sf))
    return rounded(result.summary.select("covariate", "coef", "se", "exp_coef"), 4)


_AB = ", full_ AS (SELECT * FROM n10), ts AS (SELECT time, sum(w * exp(beta * treated)) AS s0, sum(w * treated * exp(beta * treated)) AS s1, sum(w * event) AS dw FROM (SELECT c1.*, {w} AS w FROM c1), full_ GROUP BY time), rr AS (SELECT time, sum(s0) OVER (ORDER BY time DESC) AS s0, sum(s1) OVER (ORDER BY time DESC) AS s1, dw FROM ts), ab AS (SELECT time, s0, s1, sum(dw / s0) OVER (ORDER BY time) AS a, sum(dw * s1 / (s0 * s0)) OVER (ORDER BY time) AS b FROM rr), phi AS (SELECT {w} * (event * (treated - s1 / s0) - exp(beta * treated) * (a * treated - b)) AS f, h FROM c1 JOIN ab USING (time), full_) SELECT round(sqrt(sum(f * f)) / any_value(h), 5) AS robust_se FROM phi"


@query("sandwich", _cox_sql(_ATE) + _AB.format(w=_ATE))
def sandwich_query(spark, sf):
    df, spec = weighted(spark, sf)
    fit = fit_cox(df, spec, ["treated"])
    return rounded(spark.createDataFrame([(float(sandwich(df, spec, ["treated"], fit)[0, 0]) ** 0.5,)], "robust_se double"), 5)


def _summary(rows: DataFrame) -> DataFrame:
    """A summary table without the tail probabilities, which DuckDB has no function for."""
    return rounded(rows.drop("p", "minus_log2_p", "cmp_to"), 4)


@query("summary", _cox_sql(_ATE) + " SELECT 'treated' AS covariate, round(beta, 4) AS coef, round(exp(beta), 4) AS exp_coef, round(1 / sqrt(h), 4) AS se, round(beta - 1.959963984540054 / sqrt(h), 4) AS ci_low, round(beta + 1.959963984540054 / sqrt(h), 4) AS ci_high, round(beta * sqrt(h), 3) AS z FROM n10")
def summary(spark, sf):
    result = ExternalControlAnalysis(SPEC, ps=F.col("ps"), clip=None).fit(cohort(spark, sf))
    s = result.summary.select("covariate", "coef", "exp_coef", "se", "ci_low", "ci_high", "z")
    return rounded(s, 4).withColumn("z", F.round("z", 3))


_ROBUST = _cox_sql(_ATE) + _AB.format(w=_ATE).replace("SELECT round(sqrt(sum(f * f)) / any_value(h), 5) AS robust_se FROM phi", "SELECT sqrt(sum(f * f)) / any_value(h) AS se FROM phi")


@query("summary_robust", _ROBUST.replace(" SELECT sqrt(sum(f * f)) / any_value(h) AS se FROM phi", ", rse AS (SELECT sqrt(sum(f * f)) / any_value(h) AS se FROM phi) ") + " SELECT 'treated' AS covariate, round(beta, 4) AS coef, round(exp(beta), 4) AS exp_coef, round(se, 4) AS se, round(beta - 1.959963984540054 * se, 4) AS ci_low, round(beta + 1.959963984540054 * se, 4) AS ci_high, round(exp(beta - 1.959963984540054 * se), 4) AS exp_low, round(exp(beta + 1.959963984540054 * se), 4) AS exp_high, round(beta / se, 4) AS z FROM n10, rse")
def summary_robust(spark, sf):
    return _summary(ExternalControlAnalysis(SPEC, ps=F.col("ps"), variance="robust").fit(cohort(spark, sf)).summary)


@query("cox_by_center", _cox_sql("CAST(1 AS double)", by="center") + " SELECT center, round(beta, 5) AS coef, round(1 / sqrt(h), 5) AS se FROM n10")
def cox_by_center(spark, sf):
    found = fit_binary(time_table(cohort(spark, sf), SPEC, F.col("treated"), by=["center"]), by="center")
    return rounded(spark.createDataFrame([(c, v[0], v[1] ** -0.5) for c, v in sorted(found.items())], "center string, coef double, se double"), 5)


# ---------------------------------------------------------------- Cox, several columns


def _fit_rows(spark: SparkSession, fit, digits: int = 4) -> DataFrame:
    return rounded(spark.createDataFrame(summary_rows(fit.columns, fit.beta, fit.variance), SUMMARY_SCHEMA).select("covariate", "coef", "se", "z"), digits)


def _cox2_sql(steps: int = 9) -> str:
    """Unrolled Newton for treated and x_lines; time is tied heavily, so the table by time is small."""
    out = C1 + ", n0 AS (SELECT CAST(0 AS double) AS b1, CAST(0 AS double) AS b2, CAST(1 AS double) AS v11, CAST(1 AS double) AS v22)"
    for k in range(steps):
        out += f""", t{k} AS (SELECT time, sum(r) AS s0, sum(r * treated) AS a1, sum(r * x_lines) AS a2, sum(r * treated * treated) AS a11, sum(r * treated * x_lines) AS a12, sum(r * x_lines * x_lines) AS a22,
  CAST(sum(event) AS double) AS d, CAST(sum(event * treated) AS double) AS d1, sum(event * x_lines) AS d2 FROM (SELECT *, exp(b1 * treated + b2 * x_lines) AS r FROM c1, n{k}) GROUP BY time),
u{k} AS (SELECT d, d1, d2, sum(s0) OVER w AS s0, sum(a1) OVER w AS a1, sum(a2) OVER w AS a2, sum(a11) OVER w AS a11, sum(a12) OVER w AS a12, sum(a22) OVER w AS a22 FROM t{k} WINDOW w AS (ORDER BY time DESC)),
g{k} AS (SELECT sum(d1 - d * a1 / s0) AS g1, sum(d2 - d * a2 / s0) AS g2, sum(d * (a11 / s0 - a1 * a1 / (s0 * s0))) AS h11, sum(d * (a12 / s0 - a1 * a2 / (s0 * s0))) AS h12, sum(d * (a22 / s0 - a2 * a2 / (s0 * s0))) AS h22 FROM u{k} WHERE d > 0),
n{k + 1} AS (SELECT b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b1, b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b2, h22 / (h11 * h22 - h12 * h12) AS v11, h11 / (h11 * h22 - h12 * h12) AS v22 FROM n{k}, g{k})"""
    return out


@query("cox_multi", _cox2_sql() + " SELECT 'treated' AS covariate, round(b1, 4) AS coef, round(sqrt(v11), 4) AS se FROM n9 UNION ALL SELECT 'x_lines', round(b2, 4), round(sqrt(v22), 4) FROM n9")
def cox_multi(spark, sf):
    return _fit_rows(spark, fit_cox(cohort(spark, sf), SPEC, ["treated", "x_lines"])).drop("z")


#: Columns in units of their deviation; the penalty of step k on coefficient b, softabs sharpened by a.
_NET = C1 + ", sc AS (SELECT *, CAST(1 AS double) AS w, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS x{k}" for k, c in enumerate(("treated", *COVARIATES))) + " FROM c1)"
_NET += unrolled.cox("sc", 4, "e", steps=15, penalty=("0.1 * (0.5 * (2 / (1 + exp(-{a} * {b})) - 1) + 0.5 * {b})", "0.1 * (0.5 * {a} / 2 * (1 - (2 / (1 + exp(-{a} * {b})) - 1) * (2 / (1 + exp(-{a} * {b})) - 1)) + 0.5)"))


@query("cox_elastic_net", _NET + " " + " UNION ALL ".join(f"SELECT '{c}' AS covariate, round(b{k} / (SELECT stddev_samp({c}) FROM c1), 4) AS coef FROM en15" for k, c in enumerate(("treated", *COVARIATES))))
def cox_elastic_net(spark, sf):
    return _fit_rows(spark, fit_cox(cohort(spark, sf), SPEC, ["treated", *COVARIATES], penalizer=0.1, l1_ratio=0.5, max_iter=15)).select("covariate", "coef")


_EFRON1 = C1 + ", e1 AS (SELECT time, CAST(event AS double) AS event, CAST(1 AS double) AS w, CAST(treated AS double) AS x0 FROM c1)" + unrolled.cox("e1", 1, "e", efron=True)


@query("cox_efron", _EFRON1 + " SELECT 'treated' AS covariate, round(b0, 4) AS coef, round(sqrt(v0_0), 4) AS se, round(b0 / sqrt(v0_0), 4) AS z FROM en9")
def cox_efron(spark, sf):
    return _fit_rows(spark, fit_cox(cohort(spark, sf), SPEC, ["treated"], ties="efron"))


#: Robust errors of an Efron fit of two columns under weights: V Q V by hand.
_EFRON2 = C1 + f", e2 AS (SELECT time, CAST(event AS double) AS event, {_ATE} AS w, CAST(treated AS double) AS x0, CAST(x_lines AS double) AS x1 FROM c1)" + unrolled.cox("e2", 2, "r", efron=True) + unrolled.efron_scores("e2", 2, "r")
_EFRON2 += ", qq AS (SELECT sum(f0 * f0) AS q00, sum(f0 * f1) AS q01, sum(f1 * f1) AS q11 FROM rphi)"


@query("sandwich_efron", _EFRON2 + " " + " UNION ALL ".join(f"SELECT '{c}' AS covariate, round(b{k}, 4) AS coef, round(sqrt(v{k}_0 * v{k}_0 * q00 + 2 * v{k}_0 * v{k}_1 * q01 + v{k}_1 * v{k}_1 * q11), 5) AS robust_se FROM rn9, qq" for k, c in enumerate(("treated", "x_lines"))))
def sandwich_efron(spark, sf):
    df, spec = weighted(spark, sf)
    fit = fit_cox(df, spec, ["treated", "x_lines"], ties="efron")
    robust = sandwich(df, spec, fit.columns, fit)
    return spark.createDataFrame([(c, round(float(b), 4), round(float(v) ** 0.5, 5)) for c, b, v in zip(fit.columns, fit.beta, robust.diagonal())], "covariate string, coef double, robust_se double")


@query("naive_comparison", _EFRON1 + " " + unrolled.summary("e", ["treated"]))
def naive_comparison(spark, sf):
    return _summary(NaiveComparison(SPEC).fit(cohort(spark, sf)).summary)


@query("naive_comparison_breslow", _cox_sql("CAST(1 AS double)") + " SELECT round(beta, 5) AS coef, round(1 / sqrt(h), 5) AS se FROM n10")
def naive_comparison_breslow(spark, sf):
    return rounded(NaiveComparison(SPEC, ties="breslow").fit(cohort(spark, sf)).summary.select("coef", "se"), 5)


_ADJUSTED = ("treated", *COVARIATES)


@query("covariate_adjusted", C1 + ", r4 AS (SELECT time, CAST(event AS double) AS event, CAST(1 AS double) AS w, " + ", ".join(f"CAST({c} AS double) AS x{k}" for k, c in enumerate(_ADJUSTED)) + " FROM c1)" + unrolled.cox("r4", 4, "a", efron=True) + " " + unrolled.summary("a", _ADJUSTED))
def covariate_adjusted(spark, sf):
    return _summary(CovariateAdjusted(SPEC).fit(cohort(spark, sf)).summary)


def _iptw_sql(weight: str, columns: tuple[str, ...], efron: bool, source: str = "l4, ln9") -> str:
    """A Cox fit under weights of the propensity p that is fitted on all covariates."""
    ps = f"SELECT *, 1 / (1 + exp(-({' + '.join(f'b{k} * x{k}' for k in range(4))}))) AS p FROM {source}"
    rows = ", ".join(f"CAST({c} AS double) AS x{k}" for k, c in enumerate(columns))
    return _LOGIT4 + f", wr AS (SELECT time, CAST(event AS double) AS event, {weight} AS w, {rows} FROM ({ps}))" + unrolled.cox("wr", len(columns), "c", efron) + " " + unrolled.summary("c", columns)


_OWN_ATE = "treated / p + (1 - treated) / (1 - p)"


@query("pooled_iptw", _iptw_sql(_OWN_ATE, ("treated",), True))
def pooled_iptw(spark, sf):
    return _summary(PooledIPTW(SPEC).fit(cohort(spark, sf)).summary)


@query("pooled_iptw_att", _iptw_sql("treated + p * (1 - treated) / (1 - p)", ("treated",), False))
def pooled_iptw_att(spark, sf):
    return _summary(PooledIPTW(SPEC, effect="ATT", ties="breslow").fit(cohort(spark, sf)).summary)


@query("aiptw", _iptw_sql(_OWN_ATE, ("treated", "x_lines"), False))
def aiptw(spark, sf):
    return _summary(ExternalControlAnalysis(SPEC, strategy="aiptw", cox_columns=["x_lines"]).fit(cohort(spark, sf)).summary)


@query("maic_targets", C1 + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in COVARIATES) + " FROM c1 WHERE treated = 0")
def maic_targets_query(spark, sf):
    return rounded(maic_targets(cohort(spark, sf), "treated", COVARIATES))


_MAIC_Z = "x_lines - ml AS x0, x_bal - mb AS x1, x_lines * x_lines - (ml * ml + sl * sl) AS x2, x_bal * x_bal - (mb * mb + sb * sb) AS x3"
_MAIC = C1 + ", tg AS (SELECT avg(x_lines) AS ml, stddev_samp(x_lines) AS sl, avg(x_bal) AS mb, stddev_samp(x_bal) AS sb FROM c1 WHERE treated = 0)" + f", zs AS (SELECT c1.*, {_MAIC_Z} FROM c1, tg), zt AS (SELECT x0, x1, x2, x3 FROM zs WHERE treated = 1)" + unrolled.moments("zt", 4, "m")
_MAIC_W = "CASE WHEN treated = 1 THEN exp(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3) ELSE 1 END"


@query("maic_weights", _MAIC + f" SELECT patient_id, round({_MAIC_W}, 4) AS w FROM zs, mn14")
def maic_weights(spark, sf):
    df = cohort(spark, sf)
    return rounded(df.select("patient_id", fit_maic(df, "treated", ["x_lines", "x_bal"]).weight("treated").alias("w")), 4)


@query("maic_balance", C1 + " SELECT round(avg(x_lines), 4) AS x_lines_mean, round(sqrt(avg(x_lines * x_lines) - avg(x_lines) * avg(x_lines) + var_samp(x_lines) - var_pop(x_lines)), 4) AS x_lines_std FROM c1 WHERE treated = 0")
def maic_balance(spark, sf):
    """After weighting, treated rows have the controls' mean and deviation; the SQL gives the controls' own."""
    df = cohort(spark, sf)
    w = fit_maic(df, "treated", ["x_lines", "x_bal"]).weight("treated")
    mean = F.sum(w * F.col("x_lines")) / F.sum(w)
    return rounded(df.where("treated = 1").agg(mean.alias("x_lines_mean"), F.sqrt(F.sum(w * F.col("x_lines") * F.col("x_lines")) / F.sum(w) - mean * mean).alias("x_lines_std")), 4)


@query("matching_adjusted", _MAIC + f", wm AS (SELECT time, CAST(event AS double) AS event, {_MAIC_W} AS w, CAST(treated AS double) AS x0 FROM zs, mn14)" + unrolled.cox("wm", 1, "c", efron=True) + " " + unrolled.summary("c", ["treated"]))
def matching_adjusted(spark, sf):
    return _summary(MatchingAdjusted(CohortSpec(covariates=("x_lines", "x_bal"))).fit(cohort(spark, sf)).summary)


@query("c_index", C1 + """, cells AS (SELECT time AS t, event AS e, x_lines AS s, count(*) AS n FROM c1 GROUP BY ALL),
p AS (SELECT sum(CASE WHEN b.s > a.s THEN a.n * b.n ELSE 0 END) AS conc, sum(CASE WHEN b.s = a.s THEN a.n * b.n ELSE 0 END) AS tied, sum(a.n * b.n) AS pairs
 FROM cells a JOIN cells b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))
SELECT CAST(conc AS double) AS concordant, CAST(tied AS double) AS tied, CAST(pairs AS double) AS comparable, round((conc + tied / 2) / pairs, 6) AS c_index FROM p""")
def c_index(spark, sf):
    return rounded(concordance(cohort(spark, sf), "time", "event", "x_lines"))


# ---------------------------------------------------------------- bootstrap

_REPLICATES = 8


def _draws_sql(by: str = "") -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return C1 + f""", rk AS (SELECT *, row_number() OVER ({part}ORDER BY patient_id) - 1 AS rank, count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS n FROM c1),
dr AS (SELECT {key}replicate, CAST('0x' || substr(md5('1:' || replicate || ':0:' || {by + " || ':' || " if by else ""}rank), 1, 13) AS bigint) % n AS rank FROM rk, (SELECT unnest(generate_series(1, {_REPLICATES})) AS replicate)),
pk AS (SELECT {key}replicate, rank, count(*) AS multiplicity FROM dr GROUP BY {key}replicate, rank),
mu AS (SELECT CAST(replicate AS int) AS replicate, patient_id, multiplicity, center, time, event, treated, x_lines, ps FROM pk JOIN rk USING ({key}rank))"""


def _boot(df: DataFrame, by: list[str], keep: str | None = None) -> DataFrame:
    return replicate(df, SPEC, draw_multiplicities(df, SPEC, _REPLICATES, by), keep)


@query("boot_global", _draws_sql() + " SELECT replicate, sum(multiplicity)::bigint AS n, count(*) AS n_distinct, round(sum(multiplicity * time) / sum(multiplicity), 6) AS mean_time FROM mu GROUP BY replicate")
def boot_global(spark, sf):
    b = _boot(cohort(spark, sf), []).where("replicate > 0")
    m = F.col("boot_weight")
    return rounded(b.groupBy("replicate").agg(F.sum(m).cast("long").alias("n"), F.count(F.lit(1)).alias("n_distinct"), (F.sum(m * F.col("time")) / F.sum(m)).alias("mean_time")))


@query("boot_per_center", _draws_sql("center") + " SELECT replicate, center, sum(multiplicity)::bigint AS n, count(*) AS n_distinct FROM mu GROUP BY replicate, center")
def boot_per_center(spark, sf):
    b = _boot(cohort(spark, sf), ["center"]).where("replicate > 0")
    return b.groupBy("replicate", "center").agg(F.sum("boot_weight").cast("long").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("boot_treated_only", _draws_sql() + f", al AS (SELECT replicate, treated, multiplicity FROM mu WHERE treated = 1 UNION ALL SELECT replicate, treated, 1 FROM c1, (SELECT CAST(unnest(generate_series(1, {_REPLICATES})) AS int) AS replicate) WHERE treated = 0) SELECT replicate, treated, sum(multiplicity)::bigint AS n FROM al GROUP BY replicate, treated")
def boot_treated_only(spark, sf):
    b = _boot(cohort(spark, sf), [], "treated = 0").where("replicate > 0")
    return b.groupBy("replicate", "treated").agg(F.sum("boot_weight").cast("long").alias("n"))


@query("boot_valid", _draws_sql() + ", v AS (SELECT replicate, center, count(*) AS n FROM mu GROUP BY replicate, center) SELECT replicate FROM v GROUP BY replicate HAVING min(n) >= 2")
def boot_valid(spark, sf):
    return valid_replicates(_boot(cohort(spark, sf), []).where("replicate > 0"), SPEC)


_BOOT_COX = _cox_sql(f"(multiplicity * {_ATE})", "mu", "replicate", head=_draws_sql())


@query("boot_cox", _BOOT_COX + " SELECT replicate, round(beta, 5) AS coef FROM n10")
def boot_cox(spark, sf):
    return rounded(_boot_estimates(spark, sf), 5)


def _boot_estimates(spark, sf, packed=draws_packed) -> DataFrame:
    df, spec = weighted(spark, sf)
    df = df.select("patient_id", "time", "event", "treated", "w")
    found = fit_binary(packed_time_table(packed(df, spec, _REPLICATES), spec, F.col("treated"), _REPLICATES), by="replicate")
    return spark.createDataFrame([(int(k), v[0]) for k, v in sorted(found.items())], "replicate int, coef double")


def _poisson_sql() -> str:
    """Poisson multiplicities from the digest of a row and a replicate."""
    bounds, total = [], 0.0
    for k in range(20):
        total += math.exp(-1) / math.factorial(k)
        bounds.append(total)
    draws = f"pu AS (SELECT c1.*, CAST(replicate AS int) AS replicate, (CAST('0x' || substr(md5('1:' || replicate || ':' || patient_id), 1, 13) AS bigint) + 0.5) / 4503599627370496.0 AS u FROM c1, (SELECT unnest(generate_series(1, {_REPLICATES})) AS replicate))"
    return C1 + f", {draws}, mu AS (SELECT *, {' + '.join(f'CAST(u >= {b!r} AS int)' for b in bounds)} AS multiplicity FROM pu WHERE u >= {bounds[0]!r})"


@query("boot_cox_poisson", _cox_sql(f"(multiplicity * {_ATE})", "mu", "replicate", head=_poisson_sql()) + " SELECT replicate, round(beta, 5) AS coef FROM n10")
def boot_cox_poisson(spark, sf):
    return rounded(_boot_estimates(spark, sf, poisson_packed), 5)


@query("boot_variance", _BOOT_COX + " SELECT round(stddev_pop(beta), 5) AS std_coef, round(covar_pop(beta, beta), 6) AS cov_coef_coef FROM n10")
def boot_variance(spark, sf):
    return bootstrap_variance(_boot_estimates(spark, sf), ["coef"]).select(F.round("std_coef", 5).alias("std_coef"), F.round("cov_coef_coef", 6).alias("cov_coef_coef"))


@query("boot_metric", _draws_sql() + ", a AS (SELECT replicate, sum(multiplicity * CAST((CASE WHEN ps > 0.5 THEN 1 ELSE 0 END) = treated AS int)) / sum(multiplicity) AS a FROM mu GROUP BY replicate) SELECT round(avg(a), 6) AS accuracy FROM a")
def boot_metric(spark, sf):
    m, hit = F.col("multiplicity"), (F.when(F.col("ps") > 0.5, 1).otherwise(0) == F.col("treated")).cast("int")
    return rounded(bootstrap_metric(_boot(cohort(spark, sf), []), lambda rows, by: rows.groupBy(*by).agg((F.sum(m * hit) / F.sum(m)).alias("accuracy")), "accuracy"))


#: Replicates that whole estimators are fitted on.
_FEW = 2
_BOOT_ROWS = _draws_sql().replace(f"generate_series(1, {_REPLICATES})", f"generate_series(1, {_FEW})") + ", bt AS (SELECT replicate, multiplicity, center, time, event, treated, x_lines, x_bal, x_urgent FROM mu)"


@query("boot_adjusted", _BOOT_ROWS.replace("treated, x_lines, ps FROM pk", "treated, x_lines, x_bal, x_urgent, ps FROM pk") + "".join(
    f", ba{k} AS (SELECT time, CAST(event AS double) AS event, CAST(multiplicity AS double) AS w, CAST(treated AS double) AS x0, x_lines AS x1 FROM bt WHERE replicate = {k})" + unrolled.cox(f"ba{k}", 2, f"b{k}_") for k in (1, 2)
) + " " + " UNION ALL ".join(f"SELECT {k} AS replicate, round(b0, 4) AS treated, round(b1, 4) AS x_lines FROM b{k}_n9" for k in (1, 2)))
def boot_adjusted(spark, sf):
    """Both coefficients of a covariate-adjusted fit in each replicate, all replicates in one aggregation an iteration."""
    est = CovariateAdjusted(CohortSpec(covariates=("x_lines",)), ties="breslow", variance="bootstrap", replicates=_FEW)
    found = est.bootstrap(cohort(spark, sf))
    return rounded(spark.createDataFrame([(k, *map(float, b)) for k, b in sorted(found.items()) if k], "replicate int, treated double, x_lines double"), 4)


def _boot_iptw_sql() -> str:
    """Both models on the repeated rows of each replicate: a row drawn twice is two tied rows."""
    out = _BOOT_ROWS.replace("treated, x_lines, ps FROM pk", "treated, x_lines, x_bal, x_urgent, ps FROM pk")
    for k in range(1, _FEW + 1):
        out += f", bc{k} AS (SELECT time, CAST(event AS double) AS event, CAST(treated AS double) AS y, CAST(1 AS double) AS x0, x_lines AS x1, unnest(generate_series(1, multiplicity)) AS copy FROM bt WHERE replicate = {k})"
        out += unrolled.logit(f"bc{k}", 2, f"l{k}_") + f", bw{k} AS (SELECT time, event, y / p + (1 - y) / (1 - p) AS w, y AS x0 FROM (SELECT *, 1 / (1 + exp(-(b0 * x0 + b1 * x1))) AS p FROM bc{k}, l{k}_n9))"
        out += unrolled.cox(f"bw{k}", 1, f"c{k}_", efron=True)
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS replicate, round(b0, 4) AS treated FROM c{k}_n9" for k in range(1, _FEW + 1))


@query("boot_pooled_iptw", _boot_iptw_sql())
def boot_pooled_iptw(spark, sf):
    """The pooled baseline in each replicate: propensities, weights and Efron's ties fitted anew, all replicates at once."""
    found = PooledIPTW(CohortSpec(covariates=("x_lines",)), variance="bootstrap", replicates=_FEW).bootstrap(cohort(spark, sf))
    return rounded(spark.createDataFrame([(k, float(b[0])) for k, b in sorted(found.items()) if k], "replicate int, treated double"), 4)


# ---------------------------------------------------------------- splits, ETL


@query("split_uniform", C1 + ", r AS (SELECT patient_id, row_number() OVER (ORDER BY (patient_id * 48271) % 2147483647) - 1 AS rank, count(*) OVER () AS n FROM c1) SELECT patient_id, CAST(floor(rank / ceil(n / 4.0)) AS int) AS site FROM r")
def split_uniform_query(spark, sf):
    return split_uniform(cohort(spark, sf).select("patient_id"), 4, (F.col("patient_id") * 48271) % 2147483647, "site")


@query("split_control", C1 + " SELECT patient_id, CAST(CASE WHEN treated = 1 THEN 0 ELSE 1 + patient_id % 3 END AS int) AS site FROM c1")
def split_control_query(spark, sf):
    return split_control(cohort(spark, sf), 4, F.col("patient_id"), name="site").select("patient_id", "site")


@query("exchangeability", C1 + " SELECT CASE WHEN center = 'ASIA' THEN 1 ELSE 0 END AS treated, count(*) AS n, CAST(sum(event) AS bigint) AS events, round(avg(time), 6) AS mean_time FROM c1 WHERE treated = 0 GROUP BY 1")
def exchangeability(spark, sf):
    own = reallocate(cohort(spark, sf), 0, "treated", F.col("center") == "ASIA")
    return rounded(own.groupBy("treated").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.avg("time").alias("mean_time")))


@query("nearest_in_interval", """WITH i AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY user_id),
k AS (SELECT i.user_id, i.at, e.ts AS seen, e.value, row_number() OVER (PARTITION BY i.user_id ORDER BY abs(epoch_us(e.ts) - epoch_us(i.at)), e.ts, e.value) AS rn
 FROM i JOIN events e ON e.user_id = i.user_id AND e.event_type = 'click' AND e.ts >= i.at - INTERVAL 30 HOUR AND e.ts <= i.at + INTERVAL 7 HOUR)
SELECT i.user_id, epoch_us(i.at) AS at_us, coalesce(epoch_us(k.seen), -1) AS seen_us, k.value FROM i LEFT JOIN k ON k.user_id = i.user_id AND rn = 1""")
def nearest_in_interval(spark, sf):
    events = table(spark, sf, "events")
    index = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("at"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), "value")
    near = etl.nearest_record(index, clicks, "user_id", "at", "seen", F.expr("INTERVAL -30 HOURS"), F.expr("INTERVAL 7 HOURS"))
    return near.select("user_id", etl.micros("at").alias("at_us"), F.coalesce(etl.micros("seen"), F.lit(-1)).alias("seen_us"), "value")


@query("time_to_event", """WITH f AS (SELECT user_id, min(ts) AS start FROM events GROUP BY user_id),
h AS (SELECT e.user_id, start, min(CASE WHEN event_type = 'purchase' AND ts > start THEN ts END) AS hit, max(ts) AS last FROM events e JOIN f USING (user_id) GROUP BY e.user_id, start)
SELECT user_id, round((epoch_us(coalesce(hit, last)) - epoch_us(start)) / 1000000.0, 3) AS time, CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS event FROM h""")
def time_to_event(spark, sf):
    out = etl.time_to_event(table(spark, sf, "events"), "user_id", "ts", "event_type", "purchase")
    return out.select("user_id", F.round("time", 3).alias("time"), "event")


@query("exclude_ids", C1 + " SELECT patient_id FROM c1 WHERE patient_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_ids(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("patient_id"))
    return etl.exclude_ids(cohort(spark, sf).select("patient_id"), gone, "patient_id")


@query("one_hot_minmax", "SELECT c_custkey, round((c_acctbal + 1000) / 11000, 6) AS acctbal, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::double ELSE 0.0::double END AS \"c_mktsegment_{s}\"" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot_minmax(spark, sf):
    hot = one_hot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return table(spark, sf, "customer").select("c_custkey", F.round(min_max("c_acctbal", -1000, 10000), 6).alias("acctbal"), *[c.alias(n) for n, c in hot.items()])


_HOLES = "SELECT patient_id, CASE WHEN patient_id % 10 = 0 THEN NULL ELSE x_lines END AS x_lines, CASE WHEN patient_id % 7 = 0 THEN NULL ELSE center END AS center FROM c1"


def _holes(spark, sf) -> DataFrame:
    k = F.col("patient_id")
    return cohort(spark, sf).select("patient_id", F.when(k % 10 != 0, F.col("x_lines")).alias("x_lines"), F.when(k % 7 != 0, F.col("center")).alias("center"))


@query("fill_mean_mode", C1 + f", h AS ({_HOLES}), m AS (SELECT avg(x_lines) AS a FROM h), o AS (SELECT center AS c FROM h WHERE center IS NOT NULL GROUP BY center ORDER BY count(*) DESC, center LIMIT 1) SELECT patient_id, round(coalesce(x_lines, a), 6) AS x_lines, coalesce(center, c) AS center FROM h, m, o")
def fill_mean_mode(spark, sf):
    return rounded(etl.fill_mean_mode(_holes(spark, sf), ["x_lines"], ["center"]))


@query("impute_once", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 AND user_id % 5 <> 0 THEN value END AS value FROM events),
k AS (SELECT user_id, min(value) AS v FROM e GROUP BY user_id), m AS (SELECT avg(v) AS a FROM k)
SELECT event_id, user_id, round(coalesce(value, v, a), 6) AS value FROM e JOIN k USING (user_id), m""")
def impute_once(spark, sf):
    """Rows that repeat a user take the user's own value, or else the mean of the users."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.when((F.col("event_id") % 3 != 0) & (F.col("user_id") % 5 != 0), F.col("value")).alias("value"))
    return rounded(etl.impute_once(e, "user_id", ["value"]))


@query("patient_tables", C1 + " SELECT c1.patient_id, n_late, big FROM c1 LEFT JOIN (SELECT l_orderkey AS patient_id, count(*) AS n_late FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) USING (patient_id) LEFT JOIN (SELECT o_orderkey AS patient_id, o_totalprice > 200000 AS big FROM orders WHERE o_orderpriority = '1-URGENT') USING (patient_id)")
def patient_tables(spark, sf):
    late = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("patient_id")).agg(F.count(F.lit(1)).alias("n_late"))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("patient_id"), (F.col("o_totalprice") > 200000).alias("big"))
    return left_join_all(cohort(spark, sf).select("patient_id"), "patient_id", late, urgent)


@query("clinical_checks", C1 + " SELECT count(*) AS n_rows, count(*) FILTER (x_lines > 6) AS x_lines, count(*) FILTER (center NOT IN ('ASIA', 'EUROPE')) AS center FROM c1")
def clinical_checks(spark, sf):
    return clinical_violations(cohort(spark, sf), {"x_lines": (1, 6)}, {"center": ["ASIA", "EUROPE"]})


@query("overwrite_where", C1 + " SELECT patient_id, CASE WHEN time > 200 THEN 200 ELSE time END AS time, CAST(CASE WHEN time > 200 THEN 0 ELSE event END AS int) AS event FROM c1")
def overwrite_where(spark, sf):
    """Administrative censoring: beyond a time, both time and event are overwritten."""
    df = cohort(spark, sf).select("patient_id", "time", "event")
    return df.withColumns(etl.overwrite_where(F.col("time") > 200, time=F.lit(200.0), event=F.lit(0)))


@query("drop_na", C1 + f", h AS ({_HOLES}) SELECT * FROM h WHERE x_lines IS NOT NULL AND center IS NOT NULL")
def drop_na(spark, sf):
    return _holes(spark, sf).na.drop()


@query("recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'open' ELSE 'other' END AS status, nullif(o_orderpriority, '5-LOW') AS priority, round(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS date)) * 12 / 365.0, 6) AS months FROM orders")
def recode(spark, sf):
    months = etl.months_between_days(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", etl.recode("o_orderstatus", {"F": "dead", "O": "open"}, F.lit("other")).alias("status"), etl.null_if("o_orderpriority", "5-LOW").alias("priority"), F.round(months, 6).alias("months"))


@query("fingerprint")
def fingerprint_query(spark, sf):
    return fingerprint(cohort(spark, sf))


_DIGESTED = ("patient_id", "center", "event", "treated", "x_urgent")
_TEXTS = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in _DIGESTED)


@query("fingerprint_portable", C1 + f" SELECT CAST(sum(CAST('0x' || substr(md5({_TEXTS}), 1, 13) AS bigint)) AS varchar) AS fingerprint, count(*) AS n_rows FROM c1")
def fingerprint_portable(spark, sf):
    return portable_fingerprint(cohort(spark, sf), _DIGESTED)


@query("labels", "SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment || ' / ' || c_name), '[^a-z0-9]+', '_', 'g'), '_') AS name, lower(split_part(c_name, '#', 1)) AS kind, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) END AS number FROM customer")
def labels_query(spark, sf):
    kind, number = label_parts("c_name", "#")
    return table(spark, sf, "customer").select("c_custkey", clean_name(F.concat("c_mktsegment", F.lit(" / "), "c_name")).alias("name"), F.lower(kind).alias("kind"), number.alias("number"))


@query("arm_sizes", C1 + " SELECT center, treated, count(*) AS n FROM c1 GROUP BY center, treated")
def arm_sizes(spark, sf):
    return cohort(spark, sf).groupBy("center", "treated").agg(F.count(F.lit(1)).alias("n"))


@query("binary_columns", C1 + " SELECT 'x_lines' AS covariate, count(DISTINCT x_lines) AS n FROM c1 UNION ALL SELECT 'x_bal', count(DISTINCT x_bal) FROM c1 UNION ALL SELECT 'x_urgent', count(DISTINCT x_urgent) FROM c1")
def binary_columns(spark, sf):
    wide = cohort(spark, sf).agg(*[F.count_distinct(c).alias(c) for c in COVARIATES])
    return wide.unpivot([], list(COVARIATES), "covariate", "n")


@query("binned", C1 + ", q AS (SELECT quantile_cont(x_bal, 0.25) AS a, quantile_cont(x_bal, 0.5) AS b, quantile_cont(x_bal, 0.75) AS c FROM c1) SELECT patient_id, CAST(x_bal > a AS int) + CAST(x_bal > b AS int) + CAST(x_bal > c AS int) AS bin FROM c1, q")
def binned(spark, sf):
    df = cohort(spark, sf).select("patient_id", "x_bal")
    cuts = exact_quantiles(df, ["x_bal"], [0.25, 0.5, 0.75])["x_bal"]
    above = [(F.col("x_bal") > F.lit(c)).cast("int") for c in cuts]
    return df.select("patient_id", (above[0] + above[1] + above[2]).alias("bin"))


_SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


@query("quantiles", C1 + " " + " UNION ALL ".join(f"SELECT '{c}' AS covariate, CAST({p} AS double) AS p, round(quantile_cont(CAST({c} AS double), {p}), 6) AS value FROM c1" for c in (*COVARIATES, "time") for p in _SHARES))
def quantiles(spark, sf):
    found = exact_quantiles(cohort(spark, sf), [*COVARIATES, "time"], _SHARES)
    return rounded(spark.createDataFrame([(c, p, v) for c, own in found.items() for p, v in zip(_SHARES, own)], "covariate string, p double, value double"))


# ---------------------------------------------------------------- results and reports

_LOG = """(SELECT * FROM (VALUES ('iptw', 0, 100, 0.031, 0.41, 1.5), ('iptw', 1, 100, 0.20, 0.39, 1.7), ('iptw', 2, 100, 0.04, 0.52, 1.4), ('fed', 0, 100, 0.03, 0.4102, 2.5), ('fed', 1, 100, 0.21, 0.3901, 2.9),
 ('fed', 2, 100, 0.041, 0.5203, 2.1), ('oracle', 0, 100, 0.03, 0.40, 0.1), ('oracle', 1, 100, 0.15, 0.40, 0.1), ('oracle', 2, 100, 0.02, 0.50, 0.1), ('iptw', 0, 500, 0.001, 0.45, 3.5), ('fed', 0, 500, 0.001, 0.4501, 4.5),
 ('oracle', 0, 500, 0.0001, 0.44, 0.2)) AS t(method, rep_id, x, p, coef, fit_time))"""


def result_log(spark: SparkSession) -> DataFrame:
    """A literal result table."""
    rows = spark.sql(f"SELECT * FROM {_LOG}")
    return rows.select("method", F.col("rep_id").cast("int").alias("rep_id"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in ("p", "coef", "fit_time")])


_LOGD = f"(SELECT method, CAST(rep_id AS int) AS rep_id, CAST(x AS int) AS x, CAST(p AS double) AS p, CAST(coef AS double) AS coef, CAST(fit_time AS double) AS fit_time FROM {_LOG})"


@query("power", f"SELECT method, x, avg(CASE WHEN p < 0.05 THEN 1.0::double ELSE 0.0::double END) AS power, count(*) AS n FROM {_LOGD} GROUP BY method, x")
def power(spark, sf):
    return report.power(result_log(spark), ["method", "x"])


@query("relative_error", f"SELECT a.rep_id, a.x, a.coef AS reference, b.coef AS other, round(abs(b.coef - a.coef) / abs(a.coef), 6) AS relative_error FROM {_LOGD} a JOIN {_LOGD} b ON a.rep_id = b.rep_id AND a.x = b.x AND a.method = 'iptw' AND b.method = 'fed'")
def relative_error(spark, sf):
    return rounded(report.paired_error(result_log(spark), ["rep_id", "x"], "method", "iptw", "fed", "coef"))


@query("relative_error_l2", f"SELECT round(sqrt(sum((b.coef - a.coef) * (b.coef - a.coef))) / sqrt(sum(a.coef * a.coef)), 6) AS relative_error FROM {_LOGD} a JOIN {_LOGD} b ON a.rep_id = b.rep_id AND a.x = b.x AND a.method = 'iptw' AND b.method = 'fed'")
def relative_error_l2(spark, sf):
    from .operators.moments import relative_error_l2 as norm

    pairs = report.paired_error(result_log(spark), ["rep_id", "x"], "method", "iptw", "fed", "coef")
    return rounded(pairs.agg(norm(F.col("reference"), F.col("other")).alias("relative_error")))


@query("oracle_error", f"SELECT method, rep_id, x, round(coef - o, 6) AS error FROM (SELECT *, max(CASE WHEN method = 'oracle' THEN coef END) OVER (PARTITION BY rep_id, x) AS o FROM {_LOGD}) WHERE method <> 'oracle'")
def oracle_error(spark, sf):
    return rounded(report.oracle_error(result_log(spark), ["rep_id", "x"], "method", "oracle", "coef").select("method", "rep_id", "x", "error"))


@query("fit_time_stats", f"SELECT method, x, round(avg(fit_time), 6) AS mean, round(stddev_samp(fit_time), 6) AS std, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY method, x ORDER BY rep_id) AS k FROM {_LOGD}) WHERE k <= 2 GROUP BY method, x")
def fit_time_stats(spark, sf):
    return rounded(report.fit_time_stats(result_log(spark), ["method", "x"], "rep_id", 2))


@query("smd_long", C1 + _SMD + " SELECT 'smd_raw' AS kind, covariate, round(d / s, 6) AS value FROM p UNION ALL SELECT 'smd_weighted', covariate, round(wd / s, 6) FROM p")
def smd_long(spark, sf):
    df, spec = weighted(spark, sf)
    s = smd(df, spec, COVARIATES)
    wide = s.agg(*[F.max(F.when(F.col("covariate") == c, F.col(k))).alias(f"{k}_{c}") for k in ("smd_raw", "smd_weighted") for c in COVARIATES])
    return rounded(report.wide_to_long(wide, [], r"(smd_raw|smd_weighted)_(x_.*)"))


@query("smd_row", C1 + _SMD + " SELECT " + ", ".join(f"max(CASE WHEN covariate = '{c}' THEN round(d / s, 6) END) AS smd_{c}" for c in COVARIATES) + " FROM p")
def smd_row(spark, sf):
    return rounded(report.to_prefixed_row(smd(cohort(spark, sf), SPEC, COVARIATES), "covariate", "smd_raw", "smd_", COVARIATES))


@query("melt", f"SELECT method, rep_id, x, kind, value FROM (SELECT method, rep_id, x, 'p' AS kind, p AS value FROM {_LOGD} UNION ALL SELECT method, rep_id, x, 'coef', coef FROM {_LOGD})")
def melt(spark, sf):
    return result_log(spark).unpivot(["method", "rep_id", "x"], ["p", "coef"], "kind", "value")


@query("repeat_rows", f"SELECT method, CAST(rep_id AS int) AS rep_id, x, copy FROM {_LOGD}, (SELECT CAST(unnest(generate_series(1, 2)) AS int) AS copy) WHERE copy <= rep_id")
def repeat_rows(spark, sf):
    return report.repeat_rows(result_log(spark), F.col("rep_id")).select("method", "rep_id", "x", "copy")


@query("param_grid", "SELECT n, overlap, method FROM (SELECT CAST(unnest([100, 200, 500]) AS bigint) AS n), (SELECT unnest([1.0::double, 10.0::double]) AS overlap), (SELECT unnest(['eca', 'maic']) AS method)")
def param_grid(spark, sf):
    return report.param_grid(spark, {"n": [100, 200, 500], "overlap": [1.0, 10.0], "method": ["eca", "maic"]})


@query("center_pairs", C1 + ", n AS (SELECT DISTINCT center FROM c1) SELECT a.center || '+' || b.center AS centers, 2 AS n FROM n a JOIN n b ON a.center < b.center UNION ALL SELECT string_agg(center, '+' ORDER BY center), CAST(count(*) AS int) FROM n")
def center_pairs(spark, sf):
    return report.center_pairs(cohort(spark, sf), "center")


@query("union_trials", C1 + " SELECT patient_id, time, 'a' AS trial, x_bal FROM c1 WHERE center = 'ASIA' UNION ALL SELECT patient_id, time, 'b', NULL FROM c1 WHERE center = 'EUROPE'")
def union_trials(spark, sf):
    df = cohort(spark, sf)
    a = df.where("center = 'ASIA'").select("patient_id", "time", F.lit("a").alias("trial"), "x_bal")
    b = df.where("center = 'EUROPE'").select("patient_id", "time", F.lit("b").alias("trial"))
    return a.unionByName(b, allowMissingColumns=True)


@query("first_records", C1 + " SELECT center, patient_id, CAST(k AS int) AS k FROM (SELECT center, patient_id, row_number() OVER (PARTITION BY center ORDER BY time DESC, patient_id) AS k FROM c1) WHERE k <= 5")
def first_records(spark, sf):
    k = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("time"), "patient_id"))
    return cohort(spark, sf).select("center", "patient_id", k.alias("k")).where("k <= 5")


# ---------------------------------------------------------------- simulation and others without a SQL form


_SIMULATED = CoxSimulator(1000, 5, ties=0.2, seed=3)


def _simulated_sql(sim: CoxSimulator) -> str:
    """The simulator with linear propensity, constant effect and exponential censoring, from the same digests."""
    uniform = lambda k, at: f"((CAST('0x' || substr(md5('{sim.seed}:{k}:' || id), {at}, 13) AS bigint) + 0.5) / 4503599627370496.0)"
    dotted = lambda b, x: " + ".join(f"({v!r}::double) * {x}{k}" for k, v in enumerate(map(float, b)))
    factor, (alpha, beta) = sim._features(), sim.coefficients()
    g = ", ".join(f"sqrt(-2 * ln({uniform(k, 1)})) * cos(2 * pi() * {uniform(k, 14)}) AS g{k}" for k in range(sim.p))
    x = ", ".join(f"{dotted(factor[i, : i + 1], 'g')} AS x{i}" for i in range(sim.p))
    bins = sim.n - int(sim.ties * sim.n)
    limit = f"-ln(u2) * (SELECT avg(t) FROM tied) * {(1 - sim.censored) / sim.censored!r}"
    outs = ", ".join(f"round(x{k}, 6) AS X_{k}" for k in range(sim.p))
    return f"""WITH base AS (SELECT CAST(id AS varchar) AS id FROM (SELECT unnest(generate_series(0, {sim.n - 1})) AS id)),
d AS (SELECT id, {g}, {uniform(sim.p, 1)} AS u0, {uniform(sim.p, 14)} AS u1, {uniform(sim.p + 1, 1)} AS u2 FROM base),
f AS (SELECT *, {x} FROM d), p AS (SELECT *, 1 / (1 + exp(-({dotted(alpha, 'x')}) / {sim.overlap!r})) AS ps FROM f), a AS (SELECT *, CASE WHEN u0 < ps THEN 1 ELSE 0 END AS treatment FROM p),
l AS (SELECT *, {sim.scale!r} * pow(-ln(u1) / (exp({dotted(beta, 'x')}) * CASE WHEN treatment = 1 THEN {sim.effect!r} ELSE 1 END), {1 / sim.shape!r}) AS latent FROM a),
r AS (SELECT *, floor((row_number() OVER (ORDER BY latent) - 1) * {bins} / {sim.n}.0) AS bin FROM l), tied AS (SELECT *, avg(latent) OVER (PARTITION BY bin) AS t FROM r)
SELECT CAST(id AS bigint) AS patient_id, {outs}, round(ps, 6) AS propensity_scores, CAST(treatment AS int) AS treatment, {sim.effect!r}::double AS cate, round(least(t, {limit}), 6) AS time, CAST(CASE WHEN t <= {limit} THEN 1 ELSE 0 END AS int) AS event FROM tied"""


@query("simulate_cox", _simulated_sql(_SIMULATED))
def simulate_cox(spark, sf):
    return rounded(_SIMULATED.generate(spark))


@query("missforest")
def missforest(spark, sf):
    k = F.col("patient_id")
    holes = cohort(spark, sf).select("patient_id", F.when(k % 10 != 0, F.col("x_lines")).alias("x_lines"), "x_bal", "time", F.when(k % 7 != 0, F.col("x_urgent")).alias("x_urgent"))
    return etl.miss_forest(holes, "patient_id", ["x_lines", "x_bal", "time"], ["x_urgent"])


@query("dp_logit")
def dp_logit(spark, sf):
    m = fit_private_logit(cohort(spark, sf), ["x_lines"], "treated", "patient_id", 10.0, 0.01, 1.0, batch=256, updates=4, rounds=2, center="center")
    return spark.createDataFrame([m.coef], "intercept double, x_lines double")


_FED = {"batch": 256, "updates": 3, "rounds": 2, "rate": 0.05, "seed": 3}


def _fed_sql(batch: int, updates: int, rounds: int, rate: float, seed: int) -> str:
    """Rounds of mini-batch steps of every centre, unrolled; a batch is a run of rows in the order of their digests."""
    end = rounds * updates - 1
    out = C1 + f""", n AS (SELECT center, count(*) AS n, ceil(count(*) / {batch}.0) AS per FROM c1 GROUP BY center),
d AS (SELECT center, pass, per, x_lines AS x, treated AS y, row_number() OVER (PARTITION BY center, pass ORDER BY CAST('0x' || substr(md5('{seed}:' || pass || ':' || patient_id), 1, 13) AS bigint), CAST(patient_id AS varchar)) - 1 AS place
  FROM c1 JOIN n USING (center), (SELECT unnest(generate_series(0, {end})) AS pass) WHERE pass <= floor({end} / per)),
b AS MATERIALIZED (SELECT center, x, y, pass * per + floor(place / {batch}) AS step FROM d), m0 AS (SELECT 0.0::double AS b0, 0.0::double AS b1)"""
    for r in range(rounds):
        at = f"(SELECT center, b0, b1 FROM n, m{r})"
        for k in range(r * updates, (r + 1) * updates):
            out += f", s{k} AS MATERIALIZED (SELECT center, b0 - {rate} * avg(p - y) AS b0, b1 - {rate} * avg((p - y) * x) AS b1 FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM b JOIN {at} USING (center) WHERE step = {k}) GROUP BY center, b0, b1)"
            at = f"s{k}"
        out += f", m{r + 1} AS MATERIALIZED (SELECT sum(n * b0) / sum(n) AS b0, sum(n * b1) / sum(n) AS b1 FROM {at} JOIN n USING (center))"
    return out + " " + " UNION ALL ".join(f"SELECT {r + 1} AS round, round(b0, 6) AS intercept, round(b1, 6) AS x_lines FROM m{r + 1}" for r in range(rounds))


@query("fed_avg", _fed_sql(**_FED))
def fed_avg(spark, sf):
    fit = fit_fed_avg(cohort(spark, sf), ["x_lines"], "treated", "patient_id", "center", **_FED)
    return rounded(spark.createDataFrame([(r, *coef) for r, coef, _ in fit.rounds], "round int, intercept double, x_lines double"))


#: Two runs on every centre: rows of a batch, noise, steps; and the delta of the budget.
_RUNS, _DELTA = ((256, 1.1, 8), (128, 1.5, 4)), 0.01
_SPENT = C1 + ", n AS (SELECT center, CAST(count(*) AS double) AS n FROM c1 GROUP BY center), r AS (" + " UNION ALL ".join(f"SELECT center, {k} AS run, least(1.0, {b} / n) AS q, {s}::double AS s, {t} AS steps FROM n" for k, (b, s, t) in enumerate(_RUNS)) + f"""),
o AS (SELECT CAST(unnest([{', '.join(map(str, ORDERS))}]) AS bigint) AS a), k AS (SELECT a, unnest(generate_series(0, a)) AS k FROM o),
t AS (SELECT center, run, s, q, steps, a, lgamma(a + 1) - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END - CASE WHEN k < a THEN lgamma(a - k + 1) ELSE 0 END + k * ln(q) + (a - k) * ln(1 - q) + k * (k - 1) / (2 * s * s) AS t FROM r, k WHERE q < 1),
l AS (SELECT center, run, steps, a, top + ln(sum(exp(t - top))) AS l FROM (SELECT *, max(t) OVER (PARTITION BY center, run, a) AS top FROM t) GROUP BY center, run, steps, a, top),
e AS (SELECT center, a, steps * l / (a - 1) AS e FROM l UNION ALL SELECT center, a, steps * a / (2 * s * s) FROM r, o WHERE q >= 1)
SELECT center, CAST({sum(t for _, _, t in _RUNS)} AS bigint) AS steps, round(min(e), 5) AS epsilon FROM (SELECT center, sum(e) + ln((a - 1) / a) - (ln({_DELTA}) + ln(a)) / (a - 1) AS e FROM e GROUP BY center, a) GROUP BY center"""


@query("privacy_budget", _SPENT)
def privacy_budget(spark, sf):
    sizes = {r["center"]: r["n"] for r in cohort(spark, sf).groupBy("center").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a centre
    ledger = PrivacyLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", 1e6, _DELTA)
    for k, (batch, noise, steps) in enumerate(_RUNS):
        ledger.charge(f"run {k}", 0, {c: (min(1.0, batch / n), noise, steps) for c, n in sizes.items()})
    steps = sum(t for _, _, t in _RUNS)
    return rounded(spark.createDataFrame([(c, steps, e) for c, e in ledger.spent().items()], "center string, steps long, epsilon double"), 5)


def _delivered(spark, sf) -> CentreStates:
    """States of three deliveries: half the rows of all centres, then two centres whole, then the others whole."""
    df, spec = weighted(spark, sf)
    df = settle(df.select("patient_id", "center", "treated", "time", "event", "w", *COVARIATES), "delivered")  # read by three deliveries
    states = CentreStates(spark, f"{shared_dir(spark)}/states-{uuid.uuid4().hex}", COVARIATES)
    first = F.col("center").isin("ASIA", "EUROPE")
    for version, rows in enumerate((df.where("patient_id % 2 = 0"), df.where(first), df.where(~first))):
        states.deliver(rows, spec, version)
    return states


@query("states_cox", _cox_sql(_ATE) + " SELECT round(beta, 5) AS coef, round(1 / sqrt(h), 5) AS se FROM n10")
def states_cox(spark, sf):
    beta, info, _, _ = fit_binary(_delivered(spark, sf).time_table())[None]
    return rounded(spark.createDataFrame([(beta, info**-0.5)], "coef double, se double"), 5)


@query("states_moments", C1 + _LONG + " SELECT covariate, count(x) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, round(sum(w * x) / sum(w), 6) AS w_mean FROM long GROUP BY covariate")
def states_moments(spark, sf):
    return rounded(_delivered(spark, sf).moments().drop("w_var"))


@query("states_covariances", C1 + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(covar_pop({a}, {b}), 6) AS cov FROM c1" for i, a in enumerate(COVARIATES) for b in COVARIATES[i:]))
def states_covariances(spark, sf):
    return rounded(_delivered(spark, sf).covariances())


@query("experiment")
def experiment(spark, sf):
    from .plans.experiment import single_experiment

    return single_experiment(spark, CoxSimulator(1000, 2, seed=11), methods=("eca", "naive", "maic"))

