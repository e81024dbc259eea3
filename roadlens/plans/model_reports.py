"""Model keys: registry state folds, boosted-tree duration model, isotonic calibration."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.functions import scalars as SC
from roadlens.operators import cox as CX
from roadlens.operators import embedding as EM
from roadlens.operators import features as FE
from roadlens.operators import forecast as FC
from roadlens.operators import graph as G
from roadlens.operators import lookups as L
from roadlens.operators import models as MD
from roadlens.operators import sets as SE
from roadlens.operators import shapley as SH
from roadlens.operators import survival as SV
from roadlens.operators.playbook import playbook_lookup, playbook_rules
from roadlens.plans.ordered import asof_latest
from roadlens.plans.registry import register, rounded
from roadlens.plans.survival_reports import KM_CTES
from roadlens.session import scratch_table

# Promotion rule.
PROMOTE_FACTOR = 1.05

# Candidates: one per model and 200 predictions, of a quality that differs by version; every tenth
# version is followed by a rollback to the version five before it.
VERSION_ROWS, ROLLBACK_EVERY, ROLLBACK_BY = 200, 10, 5
NOISY = ("predicted + ((seq * 17) % 100 - 50) * CAST(0.15 AS DOUBLE) * (1 + (CAST(floor(seq / 200) AS BIGINT) * 5) % 7)")

CAND_SQL = ("cand", f"""SELECT model AS component, version, round(1 - sum(pow(actual - p, 2))
    / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)), 9) AS score
  FROM (SELECT model, seq // {VERSION_ROWS} AS version, actual, {NOISY} AS p FROM predictions) x GROUP BY model, version""")
EVENTS_SQL = ("registry_events", f"""SELECT component, version * 2 AS seq, false AS rb, version AS v, score AS s FROM cand
  UNION ALL SELECT c.component, c.version * 2 + 1, true, o.version, o.score FROM cand c JOIN cand o
    ON o.component = c.component AND o.version = c.version - {ROLLBACK_BY} WHERE c.version % {ROLLBACK_EVERY} = {ROLLBACK_EVERY - 1}""")


def _fold_sql(where: str) -> str:
    state = "{'seq': x.seq, 'rb': false, 'v': x.v, 's': x.s, 'n': a.n + %d}"
    return f"""SELECT component, r.v AS active_version, r.s AS active_score, r.n AS promotions FROM (
  SELECT component, list_reduce(list({{'seq': seq, 'rb': rb, 'v': v, 's': s, 'n': 1}} ORDER BY seq),
    lambda a, x: CASE WHEN x.rb THEN {state % 0} WHEN x.s > {PROMOTE_FACTOR} * a.s THEN {state % 1} ELSE a END) AS r
  FROM registry_events {where} GROUP BY component) f"""


def _candidates(spark, sf):
    p = A.table(spark, sf, "predictions").withColumn("version", F.floor(F.col("seq") / VERSION_ROWS))
    scored = MD.reg_metrics(p.withColumn("predicted", F.expr(NOISY)), "predicted", "actual", ["model", "version"])
    return scored.select(F.col("model").alias("component"), "version", F.round("r2", 9).alias("score"))


def _events(cand):
    old = cand.select("component", (F.col("version") + ROLLBACK_BY).alias("_at"), F.col("version").alias("_v"), F.col("score").alias("_s"))
    at = cand.filter(F.col("version") % ROLLBACK_EVERY == ROLLBACK_EVERY - 1).select("component", F.col("version").alias("_at"))
    back = at.join(old, ["component", "_at"]).select(
        "component", (F.col("_at") * 2 + 1).alias("seq"), F.lit("rollback").alias("kind"), F.col("_v").alias("version"),
        F.col("_s").alias("score"))
    return cand.select("component", (F.col("version") * 2).alias("seq"), F.lit("candidate").alias("kind"), "version", "score").unionByName(back)


@register("model_promotion", A.with_views(_fold_sql(""), CAND_SQL, EVENTS_SQL))
def q_model_promotion(spark, sf):
    return MD.promotion_fold(_events(_candidates(spark, sf)), "component", PROMOTE_FACTOR)


@register("active_model", A.with_views(f"SELECT component, active_version FROM ({_fold_sql('')}) m", CAND_SQL, EVENTS_SQL))
def q_active_model(spark, sf):
    return MD.promotion_fold(_events(_candidates(spark, sf)), "component", PROMOTE_FACTOR).select("component", "active_version")


@register("retrain_gate", A.with_views(f"""
SELECT c.component, c.version AS candidate, a.active_version, a.active_score IS NULL OR c.score > {PROMOTE_FACTOR} * a.active_score AS promote
FROM (SELECT * FROM cand c WHERE version = (SELECT max(version) FROM cand d WHERE d.component = c.component)) c
LEFT JOIN ({_fold_sql("e WHERE seq < 2 * (SELECT max(version) FROM cand d WHERE d.component = e.component)")}) a
  ON a.component = c.component""", CAND_SQL, EVENTS_SQL))
def q_retrain_gate(spark, sf):
    """The newest candidate against the model that was active when it was trained."""
    c = _candidates(spark, sf)
    newest = c.groupBy("component").agg(F.max("version").alias("candidate"), F.max_by("score", "version").alias("score"))
    before = _events(c).join(newest.select("component", "candidate"), "component").filter(F.col("seq") < 2 * F.col("candidate"))
    active = MD.promotion_fold(before, "component", PROMOTE_FACTOR)
    promote = F.col("active_score").isNull() | (F.col("score") > PROMOTE_FACTOR * F.col("active_score"))
    return newest.join(active, "component", "left").select("component", "candidate", "active_version", promote.alias("promote"))


#: Dimensions of the description's embedding among the model inputs; background rows of the attributions.
TEXT_DIMS, BACKGROUNDS = 8, 4
INPUTS = FE.STRUCTURED_COLUMNS


def _labelled(spark, sf) -> DataFrame:
    """Incidents with the model inputs ``x`` (eight features and the description's embedding), both labels and the part of
    their split; written once, as every fit, bound and score reads it."""
    docs = A.table(spark, sf, "documents").filter("doc_id is not null").dropDuplicates(["doc_id"])
    text = EM.embed_text(docs, "doc_id", "text", EM.fitted_words(docs, "text", TEXT_DIMS), TEXT_DIMS)
    n = max(docs.count(), 1)  # an incident's description is the text that its number points to
    inc = A.table(spark, sf, "incidents").withColumn("doc_key", F.pmod("arrival_seq", F.lit(n)))
    inc = FE.structured_features(inc).join(text.withColumnRenamed("doc_id", "doc_key"), "doc_key", "left").drop("doc_key")
    mean = inc.agg(F.avg("duration_min").alias("_mean"))  # one row: null durations take the mean
    inc = inc.join(F.broadcast(mean), F.lit(True)).withColumns({
        "duration_label": F.log1p(F.greatest(F.lit(0.0), F.coalesce("duration_min", "_mean"))),
        "severity_label": FE.severity_proxy_v2(F.col("priority"), F.col("event_cause") == "road_closure", F.col("veh_type"),
                                               F.col("corridor"), F.col("event_cause"), F.col("duration_min"))}).drop("_mean")
    none = F.array_repeat(F.lit(0.0), TEXT_DIMS)  # no description: as a text without words
    x = F.concat(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in INPUTS]), F.coalesce("embedding", none))
    return scratch_table(MD.split3(inc.withColumn("x", x), "incident_id").drop(*INPUTS, "embedding"), "labelled")


def _part(df, name):
    return df.filter(F.col("part") == name)


def _vectors(df):
    return df.withColumn("features", array_to_vector("x"))


class Fits:
    """The models of one table set, fitted when first asked for: on the train part, bounds from the calib part."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _fit(self, label: str):
        return MD.fit_gbt(_vectors(_part(self.rows, "train")), label)

    def _bounds(self, model, label: str) -> tuple[float, float]:
        return MD.conformal_bounds(model, _vectors(_part(self.rows, "calib")), label)

    @cached_property
    def severity(self):
        return self._fit("severity_label")

    @cached_property
    def duration(self):
        return self._fit("duration_label")

    @cached_property
    def severity_bounds(self) -> tuple[float, float]:
        return self._bounds(self.severity, "severity_label")

    @cached_property
    def duration_bounds(self) -> tuple[float, float]:
        return self._bounds(self.duration, "duration_label")


    def both(self) -> Fits:
        """Fit the two models side by side: a fit is many small jobs that leave most cores idle."""
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(lambda name: getattr(self, name), ("severity_bounds", "duration_bounds")))
        return self


_fits: dict[tuple, Fits] = {}


def fitted(spark, sf) -> Fits:
    """The models of an application's table set: every key that scores uses the same ones."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        _fits[key] = Fits(_labelled(spark, sf))
    return _fits[key]


def _within(c):
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def _severities(f: Fits) -> DataFrame:
    """All incidents with the severity and its interval."""
    out = f.severity.transform(_vectors(f.rows)).withColumnRenamed("prediction", "raw_severity").drop("features")
    low, high = f.severity_bounds
    return out.withColumns({"severity": _within(F.col("raw_severity")), "ci_lower": _within(F.col("raw_severity") + min(low, 0.0)),
                            "ci_upper": _within(F.col("raw_severity") + max(high, 0.0))})


@register("duration_model")
def q_duration_model(spark, sf):
    """Held-out errors of the duration model, of the log and of the minutes, beside those of the mean."""
    f = fitted(spark, sf)
    test = f.duration.transform(_vectors(_part(f.rows, "test")))
    test = test.withColumns({"minutes": SC.from_log_duration(F.col("prediction")), "actual": SC.from_log_duration(F.col("duration_label"))})
    mean = _part(f.rows, "train").agg(F.avg(SC.from_log_duration(F.col("duration_label")))).first()[0]
    out = MD.reg_metrics(test, "prediction", "duration_label").select(F.lit("log").alias("scale"), "*")
    out = out.unionByName(MD.reg_metrics(test, "minutes", "actual").select(F.lit("minutes").alias("scale"), "*"))
    return rounded(out.unionByName(MD.reg_metrics(test.withColumn("mean", F.lit(mean)), "mean", "actual").select(
        F.lit("minutes by mean").alias("scale"), "*")))


@register("quantile_severity")
def q_quantile_severity(spark, sf):
    """Severity of every incident with its 95 % interval: boosted trees and split-conformal residual quantiles; ``part`` tells
    the rows that the model was not fitted on."""
    out = _severities(fitted(spark, sf))
    return rounded(out.select("incident_id", "severity", "ci_lower", "ci_upper", F.col("severity_label").alias("actual"), "part"))


@register("calibrate_confidence")
def q_calibrate_confidence(spark, sf):
    """Isotonic calibration of severity and duration confidences, each from its own estimate and error, fitted on one half and
    scored on the other."""
    p = A.table(spark, sf, "predictions").select(F.col("seq").alias("id"), "predicted", "actual")
    f = fitted(spark, sf)
    d = f.duration.transform(_vectors(f.rows.filter("part <> 'train'"))).select(
        F.concat(F.lit("held out "), "incident_id").alias("id"), SC.from_log_duration(F.col("prediction")).alias("predicted"), F.col("duration_min").alias("actual"))
    out = None
    for kind, rows, scale in (("severity", p, 100.0), ("duration", d, 300.0)):
        share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / scale))  # noqa: E731, B023
        rows = MD.split3(rows.dropna(), "id", 50, 0).select("part", share(F.col("predicted")).alias("confidence"), (
            1 - share(F.abs(F.col("predicted") - F.col("actual")))).alias("label"))
        m = MD.isotonic(_part(rows, "train"), "confidence", "label")
        test = m.transform(MD.assemble(_part(rows, "test"), ["confidence"]))
        row = test.agg(F.avg("prediction").alias("mean_calibrated"), F.avg("label").alias("mean_label"),
                       F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("mse"), F.count("*").alias("rows"))
        row = row.select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


COX_COLUMNS = ["cov_type", "cov_priority", "cov_hour"]


def _cox(spark, sf):
    inc = FE.survival_covariates(A.table(spark, sf, "incidents"))
    return inc, CX.cox_fit(inc, "duration_min", "event_observed", COX_COLUMNS)


@register("cox_fit")
def q_cox_fit(spark, sf):
    inc, m = _cox(spark, sf)
    rows = inc.agg(F.count_if((F.col("duration_min") > 0)).alias("rows"))
    coef = F.array(*[F.struct(F.lit(c).alias("covariate"), F.lit(float(b)).alias("coefficient")) for c, b in zip(m.columns, m.beta)])
    return rounded(rows.select("rows", F.explode(coef).alias("c")).select("c.covariate", "c.coefficient", "rows"))


@register("cox_adjust")
def q_cox_adjust(spark, sf):
    inc, m = _cox(spark, sf)
    summ = SV.km_summary(SV.km_curves(inc)).filter(F.col("grp") == SV.POPULATION).select("median_duration", "ci_lower", "ci_upper")
    out = CX.cox_adjust(inc.join(F.broadcast(summ), F.lit(True)), m, ["median_duration", "ci_lower", "ci_upper"])
    return rounded(out.select("incident_id", "cox_factor", "median_duration", "ci_lower", "ci_upper"))


@register("cox_expectation")
def q_cox_expectation(spark, sf):
    inc, m = _cox(spark, sf)
    return rounded(CX.cox_expectation(inc, m).select("incident_id", "expected_duration"))


ROUTE_TYPES = "('accident','congestion','road_closure','hazard','event')"


def _end_text():
    """Observed incidents have an end; of the others' missing ends some are texts."""
    seq = F.col("arrival_seq")
    return F.when(F.col("event_observed"), F.col("start_datetime").cast("string")).when(seq % 3 == 0, "none").when(
        seq % 3 == 1, "").when(seq % 6 == 2, "NaT")


@register("duration_route", A.with_views(f"""
SELECT incident_id, CASE WHEN missing AND known THEN 'survival' WHEN missing THEN 'historical' ELSE 'model' END AS route,
  round(CASE WHEN missing AND known THEN p.median_duration WHEN missing THEN CASE event_cause WHEN 'accident' THEN 45.0 WHEN 'congestion' THEN 70.0
    WHEN 'road_closure' THEN 120.0 WHEN 'hazard' THEN 60.0 WHEN 'event' THEN 90.0 ELSE 70.0 END ELSE duration_min END, 6) AS duration
FROM (SELECT incident_id, event_cause, duration_min, k % 4 < 3 AS missing,
    event_cause IN {ROUTE_TYPES} AND coalesce(lower(priority), 'low') IN ('high', 'medium', 'low') AS known FROM incidents) i
  CROSS JOIN (SELECT median_duration FROM km_summary WHERE grp = '__population__') p""", *KM_CTES))
def q_duration_route(spark, sf):
    """Which estimate an incident's duration comes from, and the duration: the recorded one where the end is known, the population's
    survival median, or the fixed median of an unseen kind.  The estimates of the fitted models stand in ``score_incidents``."""
    inc = A.table(spark, sf, "incidents")
    summ = SV.km_summary(SV.km_curves(inc)).filter(F.col("grp") == SV.POPULATION).select(F.col("median_duration").alias("survival"))
    end = F.when(F.col("k") % 4 == 0, "none").when(F.col("k") % 4 == 1, "").when(F.col("k") % 4 == 2, "NaT").otherwise(
        F.col("start_datetime").cast("string"))
    out = MD.duration_route(inc.withColumn("end_text", end).join(F.broadcast(summ), F.lit(True)), "duration_min", "survival")
    return rounded(out.select("incident_id", "route", "duration"))


EMBED_DIMS = 64


@register("embed_text", A.with_views(rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {EMBED_DIMS} AS b, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY b),
s AS (SELECT doc_id, sqrt(sum(n * idf * n * idf)) AS size FROM c JOIN f USING (b) GROUP BY doc_id)
SELECT d.doc_id, r.b AS dim, round(coalesce(c.n * f.idf / s.size, 0), 6) AS value FROM documents d, range({EMBED_DIMS}) r(b)
LEFT JOIN c ON c.doc_id = d.doc_id AND c.b = r.b LEFT JOIN f ON f.b = r.b LEFT JOIN s ON s.doc_id = d.doc_id"""))
def q_embed_text(spark, sf):
    """Unit vectors of every document's whole text, a row per dimension: words weighted by their frequency in the corpus."""
    docs = A.table(spark, sf, "documents")
    out = EM.embed_text(docs, "doc_id", "text", EM.fitted_words(docs, "text", EMBED_DIMS), EMBED_DIMS)
    return rounded(out.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")))


def _attributions(f: Fits, rows: DataFrame) -> DataFrame:
    """(incident_id, kind, values, base_value, prediction) of the given rows, for both models."""
    behind = SE.sample_by_hash(_part(f.rows, "train"), "incident_id", BACKGROUNDS, 5).select("x").collect()  # a fixed number of rows
    groups = [(i, i + 1) for i in range(len(INPUTS))] + [(len(INPUTS), len(INPUTS) + TEXT_DIMS)]
    plan = SH.coalitions([list(r.x) for r in behind], groups)
    return SH.shapley(rows, "incident_id", "x", plan, {"severity": f.severity, "duration": f.duration})


@register("attributions")
def q_attributions(spark, sf):
    """The five inputs that move every incident's severity and log duration most, by sampled Shapley values."""
    f = fitted(spark, sf).both()
    out = _attributions(f, f.rows)
    named = out.withColumn("id", F.struct("incident_id", "kind", "base_value", "prediction"))
    top = SE.topk_attributions(named, "id", "values", INPUTS, 5)
    return rounded(top.select("id.*", "rk", "feature", "value"))


def _series(spark, sf):
    """Occupancy by road node and step, 0 in steps without an incident: the node of the series k is road node k + 1."""
    s = A.table(spark, sf, "node_series").select((F.col("node_id") + 1).alias("node_id"), F.col("step").cast("long").alias("step"), "occupancy")
    ends = s.agg(F.min("step").alias("a"), F.max("step").alias("b"))  # one row
    steps = s.select("node_id").distinct().join(F.broadcast(ends), F.lit(True)).select("node_id", F.explode(F.sequence("a", "b")).alias("step"))
    return steps.join(s, ["node_id", "step"], "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0.0)))


def _forecast(spark, sf) -> DataFrame:
    s = scratch_table(_series(spark, sf), "series")
    nodes = A.table(spark, sf, "road_nodes").join(s.select("node_id").distinct(), "node_id", "left_semi")
    return FC.forecast(s, G.knn_graph(nodes, 4))


@register("congestion_forecast")
def q_congestion_forecast(spark, sf):
    """Occupancy of every node one to six steps ahead, 0 to 100, with the errors of the model and of the last value over
    held-out steps."""
    return rounded(_forecast(spark, sf))


#: Words of news that count as an active alert.
ALERT_WORDS = ("protest", "strike", "rally")
#: Terms that every incident's search holds beside those of its cause, as in ``news_for_incident``.
COMMON_TERMS = ("the", "und", "der")


def _news(spark, sf, inc: DataFrame) -> DataFrame:
    """(event_cause, news_ids, news_alert): the newest five news items of every cause's terms, and whether one holds an alert word."""
    news = A.table(spark, sf, "news")
    causes = inc.select("event_cause").distinct()
    common = F.array(*[F.lit(t) for t in COMMON_TERMS])
    terms = causes.select(F.col("event_cause").alias("incident_id"), F.concat(F.split(F.lower("event_cause"), "_"), common).alias("terms"))
    top = L.news_for_incident(terms, news, 5, 60)
    hot = L.news_match(news, list(ALERT_WORDS)).select("news_id", F.lit(True).alias("alert"))
    return top.join(hot, "news_id", "left").groupBy(F.col("incident_id").alias("event_cause")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "news_id"))), lambda r: r["news_id"].cast("string")), "|").alias("news_ids"),
        F.coalesce(F.max("alert"), F.lit(False)).alias("news_alert"))


@register("score_incidents")
def q_score_incidents(spark, sf):
    """The prediction row of every incident: severity and duration with intervals, route, weather and news, nearest node and
    its forecast, resources, strongest inputs."""
    f = fitted(spark, sf).both()
    out = f.duration.transform(_vectors(_severities(f))).withColumnRenamed("prediction", "log_duration").drop("features")
    obs = A.table(spark, sf, "weather_obs").select("site", "ts", "precipitation", "obs_id")
    rain = asof_latest(out.select("incident_id", F.expr("user_id % 8").alias("site"), F.col("start_datetime").alias("ts")), obs, ["site"], "ts",
                       ["precipitation"], tie="obs_id")
    rain = rain.select("incident_id", F.coalesce(F.col("precipitation") > 0, F.lit(False)).alias("weather_alert"))
    out = out.join(rain, "incident_id").join(_news(spark, sf, out), "event_cause", "left").withColumn("news_alert", F.coalesce("news_alert", F.lit(False)))
    # duration: the model when the end is known (an alert lengthens it), else survival or the fixed median
    cov = FE.survival_covariates(out)
    out = CX.cox_expectation(cov, CX.cox_fit(cov, "duration_min", "event_observed", COX_COLUMNS), "survival")
    log = SC.alert_multiplier(F.col("log_duration"), F.col("weather_alert"))
    out = out.withColumns({"end_text": _end_text(), "by_model": SC.from_log_duration(log)})
    out = MD.duration_route(out, "by_model", "survival")
    low, high = f.duration_bounds
    model, wide = F.col("route") == "model", SC.duration_interval(F.col("duration"), 0.7, 1.5)
    out = out.withColumns({"duration_low": F.when(model, SC.from_log_duration(log + min(low, 0.0))).otherwise(wide["ci_lower"]),
                           "duration_high": F.when(model, SC.from_log_duration(log + max(high, 0.0))).otherwise(wide["ci_upper"])})
    # defaults of a failed prediction, then what news adds
    boosted = SC.news_boost(F.coalesce("severity", F.lit(50.0)), F.coalesce("duration", F.lit(30.0)), F.col("news_alert"))
    out = out.withColumns({"predicted_by_ai": F.col("severity").isNotNull() & F.col("duration").isNotNull(),
                           "severity_score": boosted["severity"], "duration_estimate": boosted["duration"]})
    forecast = _forecast(spark, sf).filter(F.col("horizon") == FC.HORIZONS).select("node_id", F.col("forecast").alias("congestion_ahead"))
    nodes = A.table(spark, sf, "road_nodes").join(forecast.select("node_id"), "node_id", "left_semi")
    out = out.join(G.nearest_node(out.select("incident_id", "latitude", "longitude"), nodes).select("incident_id", "node_id"), "incident_id", "left")
    out = out.join(forecast, "node_id", "left")
    why = _attributions(f, f.rows).withColumn("id", F.struct("incident_id", "kind"))
    why = SE.topk_attributions(why, "id", "values", INPUTS, 5).groupBy("id.incident_id").agg(*[F.array_join(F.transform(F.array_sort(
        F.collect_list(F.when(F.col("id.kind") == k, F.struct("rk", "feature")))), lambda r: r["feature"]), "|").alias(f"{k}_inputs")
        for k in ("severity", "duration")])
    out = playbook_lookup(out.join(why, "incident_id", "left"), playbook_rules(spark), type_col="event_cause")
    return rounded(out.select(
        "incident_id", "severity_score", F.col("ci_lower").alias("severity_low"), F.col("ci_upper").alias("severity_high"), "severity_bucket",
        "duration_estimate", "duration_low", "duration_high", "route", "weather_alert", "news_alert", "news_ids", "node_id", "congestion_ahead",
        "manpower", "barricading", "diversion", "severity_inputs", "duration_inputs", "predicted_by_ai", "part"))
