"""Join keys and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import dedup as D
from roadlens.operators import graph as G
from roadlens.operators import lookups as L
from roadlens.plans.ordered import asof_latest
from roadlens.plans.registry import AS_OF, register, rounded
from roadlens.session import scratch_table

NEAREST_SQL = ("nearest", """SELECT incident_id, node_id, user_id FROM (
  SELECT i.incident_id, i.user_id, n.node_id, row_number() OVER (PARTITION BY i.incident_id
    ORDER BY pow(n.lon - i.longitude, 2) + pow(n.lat - i.latitude, 2), n.node_id) AS r
  FROM incidents i, road_nodes n) x WHERE r = 1""")
KNN_SQL = ("knn", """SELECT src, dst FROM (
  SELECT a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.node_id
    ORDER BY pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2), b.node_id) AS r
  FROM road_nodes a, road_nodes b WHERE a.node_id <> b.node_id) x WHERE r <= 4""")


@register("nearest_node", A.with_views("SELECT incident_id, node_id FROM nearest", NEAREST_SQL))
def q_nearest_node(spark, sf):
    return G.nearest_node(A.table(spark, sf, "incidents"), A.table(spark, sf, "road_nodes")).select("incident_id", "node_id")


@register("knn_graph", A.with_views("SELECT src, dst FROM knn", KNN_SQL))
def q_knn_graph(spark, sf):
    return G.knn_graph(A.table(spark, sf, "road_nodes"), 4).select("src", "dst")


@register("graph_propagate", A.with_views("""
SELECT n.node_id, round(x0.x, 6) AS x_0, round(h1.x, 6) AS x_1, round(h2.x, 6) AS x_2, round(h3.x, 6) AS x_3,
  round(g1.x, 6) AS g_1, round(g2.x, 6) AS g_2, round(g3.x, 6) AS g_3
FROM road_nodes n JOIN g1 ON g1.node_id = n.node_id JOIN g2 ON g2.node_id = n.node_id JOIN g3 ON g3.node_id = n.node_id
LEFT JOIN x0 ON x0.node_id = n.node_id
LEFT JOIN h1 ON h1.node_id = n.node_id LEFT JOIN h2 ON h2.node_id = n.node_id LEFT JOIN h3 ON h3.node_id = n.node_id""",
    NEAREST_SQL, KNN_SQL,
    ("x0", """SELECT n.node_id, CAST(count(ne.incident_id) AS DOUBLE) AS x FROM road_nodes n
              LEFT JOIN nearest ne ON ne.node_id = n.node_id GROUP BY n.node_id"""),
    ("h1", "SELECT k.src AS node_id, avg(x0.x) AS x FROM knn k JOIN x0 ON x0.node_id = k.dst GROUP BY k.src"),
    ("h2", "SELECT k.src AS node_id, avg(h1.x) AS x FROM knn k JOIN h1 ON h1.node_id = k.dst GROUP BY k.src"),
    ("h3", "SELECT k.src AS node_id, avg(h2.x) AS x FROM knn k JOIN h2 ON h2.node_id = k.dst GROUP BY k.src"),
    ("und", "SELECT src, dst FROM knn UNION SELECT dst, src FROM knn UNION SELECT node_id, node_id FROM road_nodes"),
    ("deg", "SELECT src AS node_id, count(*) AS n FROM und GROUP BY src"),
    ("nw", "SELECT u.src, u.dst, 1 / sqrt(a.n * b.n) AS w FROM und u JOIN deg a ON a.node_id = u.src JOIN deg b ON b.node_id = u.dst"),
    *[(f"g{h}", f"SELECT src AS node_id, sum(w * p.x) AS x FROM nw JOIN {'x0' if h == 1 else f'g{h - 1}'} p ON p.node_id = nw.dst GROUP BY src")
      for h in (1, 2, 3)]))
def q_graph_propagate(spark, sf):
    nodes = A.table(spark, sf, "road_nodes")
    near = G.nearest_node(A.table(spark, sf, "incidents"), nodes)
    x0 = nodes.select("node_id").join(near.groupBy("node_id").agg(F.count("*").alias("n")), "node_id", "left") \
        .select("node_id", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("x"))
    edges = scratch_table(G.knn_graph(nodes, 4), "edges")
    x0 = scratch_table(x0, "loads")
    out = G.propagate(edges, x0, 3).join(G.propagate_normalized(edges, x0, 3), "node_id")
    return rounded(out.select("node_id", *[f"x_{h}" for h in range(4)], *[f"g_{h}" for h in (1, 2, 3)]))


@register("adjacency_edges", A.with_views("""
SELECT n.node_id AS src, m.node_id AS dst FROM (SELECT node_id, unnest([node_id - 1, node_id + 1, node_id + 50]) AS adj FROM road_nodes) n
JOIN road_nodes m ON m.node_id = n.adj"""))
def q_adjacency_edges(spark, sf):
    nodes = A.table(spark, sf, "road_nodes")
    withadj = nodes.select("node_id", F.array(F.col("node_id") - 1, F.col("node_id") + 1, F.col("node_id") + 50)
                           .alias("adjacent_node_ids"))
    return L.adjacency_edges(withadj, nodes)


@register("incident_inject", A.with_views("""
SELECT s.node_id, s.step, round(CASE WHEN s.step = l.last_step AND v.sev IS NOT NULL THEN least(1.0, v.sev / 100.0 + 0.2)
  ELSE s.occupancy END, 6) AS occupancy
FROM node_series s JOIN (SELECT node_id, max(step) AS last_step FROM node_series GROUP BY node_id) l ON l.node_id = s.node_id
LEFT JOIN (SELECT user_id % 8 AS node_id, max_by(least(severity_raw, 100.0), arrival_seq) AS sev FROM incidents GROUP BY user_id % 8) v
  ON v.node_id = s.node_id"""))
def q_incident_inject(spark, sf):
    inc = A.table(spark, sf, "incidents").select((F.col("user_id") % 8).alias("node_id"), "arrival_seq",
                                                 F.least("severity_raw", F.lit(100.0)).alias("severity_score"))
    out = G.inject_incident(A.table(spark, sf, "node_series"), inc)
    return rounded(out.select("node_id", "step", "occupancy"))


TARGETS_SQL = ("targets", """SELECT incident_type, max_by(incident_id, arrival_seq) AS target_id,
  max_by(latitude, arrival_seq) AS t_lat, max_by(longitude, arrival_seq) AS t_lon FROM incidents GROUP BY incident_type""")
NEARBY_SQL = ("nearby", """SELECT t.target_id, i.incident_id, i.severity_raw FROM targets t JOIN incidents i
  ON abs(i.latitude - t.t_lat) < 0.015 AND abs(i.longitude - t.t_lon) < 0.015""")


def _targets(inc):
    return inc.groupBy("incident_type").agg(F.max_by("incident_id", "arrival_seq").alias("incident_id"),
                                            F.max_by("latitude", "arrival_seq").alias("latitude"),
                                            F.max_by("longitude", "arrival_seq").alias("longitude"))


def _nearby(inc):
    t = _targets(inc)
    return D.nearby_targets(t, inc)


@register("nearby_incidents", A.with_views("SELECT target_id, incident_id FROM nearby", TARGETS_SQL, NEARBY_SQL))
def q_nearby_incidents(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return _nearby(inc).select("target_id", "incident_id")


@register("radius_search", A.with_views("""
SELECT n.node_id AS center_id, i.incident_id FROM road_nodes n JOIN incidents i
  ON 2 * 6371000.0 * asin(sqrt(pow(sin(radians(i.latitude - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(i.latitude))
     * pow(sin(radians(i.longitude - n.lon) / 2), 2))) <= 2000.0"""))
def q_radius_search(spark, sf):
    nodes = A.table(spark, sf, "road_nodes").select(F.col("node_id").alias("center_id"), F.col("lat").alias("c_lat"),
                                                    F.col("lon").alias("c_lon"))
    inc = A.table(spark, sf, "incidents").select("incident_id", "latitude", "longitude")
    return D.radius_search(inc, nodes, 2000.0).select("center_id", "incident_id")


@register("mitigated_flag", A.with_views("""
SELECT i.incident_id, i.incident_id IN (SELECT incident_id FROM nearby) AS mitigated FROM incidents i""",
                                         TARGETS_SQL, NEARBY_SQL))
def q_mitigated_flag(spark, sf):
    inc = A.table(spark, sf, "incidents")
    covered = _nearby(inc).select("incident_id").distinct()
    return L.mitigated_flag(inc.select("incident_id"), covered)


@register("dispatch_outcome", A.with_views("""
SELECT target_id, incident_id,
  CASE WHEN incident_id = target_id THEN NULL ELSE round(severity_raw - 30, 6) END AS new_severity,
  CASE WHEN incident_id = target_id THEN 'cleared' WHEN severity_raw - 30 < 40 THEN 'cleared' ELSE 'override' END AS status
FROM nearby""", TARGETS_SQL, NEARBY_SQL))
def q_dispatch_outcome(spark, sf):
    inc = A.table(spark, sf, "incidents")
    return rounded(L.dispatch_outcome(_nearby(inc)).select("target_id", "incident_id", "new_severity", "status"))


@register("recent_predictions", A.with_views(f"""
SELECT i.incident_id, p.model, round(p.predicted, 6) AS predicted FROM incidents i LEFT JOIN predictions p
  ON p.incident_id = i.incident_id WHERE i.start_datetime >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"""))
def q_recent_predictions(spark, sf):
    out = L.recent_predictions(A.table(spark, sf, "incidents"), A.table(spark, sf, "predictions"), AS_OF, 7)
    return rounded(out.select("incident_id", "model", "predicted"))


@register("prediction_vs_actual", A.with_views("""
SELECT p.incident_id, round(abs(p.predicted - least(i.severity_raw, 100.0)), 6) AS abs_error
FROM predictions p JOIN incidents i ON i.incident_id = p.incident_id"""))
def q_prediction_vs_actual(spark, sf):
    inc = A.table(spark, sf, "incidents").select("incident_id", F.least("severity_raw", F.lit(100.0)).alias("truth"))
    return rounded(L.prediction_vs_actual(A.table(spark, sf, "predictions"), inc, "predicted", "truth"))


@register("weather_asof", A.with_views("""
SELECT i.incident_id, w.precipitation, coalesce(w.precipitation > 0, false) AS weather_alert
FROM (SELECT incident_id, user_id % 8 AS site, start_datetime FROM incidents) i
ASOF LEFT JOIN (SELECT site, ts, max_by(precipitation, obs_id) AS precipitation FROM weather_obs GROUP BY site, ts) w
  ON i.site = w.site AND i.start_datetime >= w.ts"""))
def q_weather_asof(spark, sf):
    inc = A.table(spark, sf, "incidents").select("incident_id", (F.col("user_id") % 8).alias("site"),
                                                 F.col("start_datetime").alias("ts"))
    obs = A.table(spark, sf, "weather_obs").select("site", "ts", "precipitation", "obs_id")
    out = asof_latest(inc, obs, ["site"], "ts", ["precipitation"], tie="obs_id")
    return rounded(out.select("incident_id", "precipitation",
                              F.coalesce(F.col("precipitation") > 0, F.lit(False)).alias("weather_alert")))


@register("integrity_orphans", A.with_views("""
SELECT 'orders.o_custkey' AS fk, count(*) AS orphans FROM orders o ANTI JOIN customer c ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem l ANTI JOIN orders o ON o.o_orderkey = l.l_orderkey
UNION ALL SELECT 'predictions.incident_id', count(*) FROM predictions p ANTI JOIN incidents i ON i.incident_id = p.incident_id"""))
def q_integrity_orphans(spark, sf):
    t = lambda n: A.table(spark, sf, n)
    return L.orphan_counts([
        ("orders.o_custkey", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("lineitem.l_orderkey", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("predictions.incident_id", t("predictions"), "incident_id", t("incidents"), "incident_id"),
    ])


@register("insert_if_absent", A.with_views("""
SELECT c.model, c.version FROM (SELECT DISTINCT model, 'v' || CAST(seq // 1000 AS VARCHAR) AS version FROM predictions) c
ANTI JOIN (SELECT DISTINCT model, 'v' || CAST(seq // 1000 AS VARCHAR) AS version FROM predictions WHERE ts < TIMESTAMP '2024-01-15') r
  ON r.model = c.model AND r.version = c.version"""))
def q_insert_if_absent(spark, sf):
    p = A.table(spark, sf, "predictions").withColumn(
        "version", F.concat(F.lit("v"), F.floor(F.col("seq") / 1000).cast("string")))
    existing = p.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).select("model", "version").distinct()
    cand = p.select("model", "version").distinct()
    return L.insert_if_absent(existing, cand, ["model", "version"])


@register("news_match", A.with_views("""
SELECT news_id, array_to_string(list_filter(['the', 'und'], lambda k: contains(lower(title), k)), '|') AS matched
FROM news WHERE contains(lower(title), 'the') OR contains(lower(title), 'und')"""))
def q_news_match(spark, sf):
    return L.news_match(A.table(spark, sf, "news"), ["the", "und"]).select("news_id", "matched")


NEWS_TERMS_SQL = ("terms", """SELECT incident_id, unnest(list_distinct(list_concat(string_split(lower(event_cause), '_'),
  ['the', 'und', 'der']))) AS term FROM incidents""")
NEWS_TOK_SQL = ("tok", """SELECT DISTINCT news_id, age_days, unnest(regexp_split_to_array(lower(title), '[^a-z0-9_]+')) AS term
  FROM news WHERE age_days <= 60""")


@register("news_for_incident", A.with_views("""
SELECT incident_id, news_id, rk FROM (
  SELECT incident_id, news_id, row_number() OVER (PARTITION BY incident_id ORDER BY age_days, news_id) AS rk
  FROM (SELECT DISTINCT t.incident_id, k.news_id, k.age_days FROM terms t JOIN tok k ON k.term = t.term) c) x WHERE rk <= 5""",
    NEWS_TERMS_SQL, NEWS_TOK_SQL))
def q_news_for_incident(spark, sf):
    inc = A.table(spark, sf, "incidents")
    terms = inc.select("incident_id", F.array_distinct(F.concat(F.split(F.lower("event_cause"), "_"),
                                                                F.array(*[F.lit(t) for t in ["the", "und", "der"]])))
                       .alias("terms"))
    return L.news_for_incident(terms, A.table(spark, sf, "news"), 5, 60).select("incident_id", "news_id", "rk")


CACHE_SQL = ("cache", f"""SELECT sha256(d.text) AS text_hash, TIMESTAMP '{AS_OF}' - to_hours(d.doc_id % 48) AS stored_at
  FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id""")


def _cache(spark, sf):
    docs = A.table(spark, sf, "documents")
    lab = A.table(spark, sf, "labels")
    return docs.join(lab, "doc_id", "left_semi").select(
        F.sha2("text", 256).alias("text_hash"),
        F.timestamp_add("HOUR", -(F.col("doc_id") % 48), F.lit(AS_OF).cast("timestamp_ntz")).alias("stored_at"))


@register("embedding_cache_join", A.with_views(f"""
SELECT d.doc_id, sha256(d.text) AS text_hash,
  EXISTS (SELECT 1 FROM cache c WHERE c.text_hash = sha256(d.text) AND c.stored_at + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}') AS cache_hit
FROM documents d""", CACHE_SQL))
def q_embedding_cache_join(spark, sf):
    docs = A.table(spark, sf, "documents")
    out = L.cache_lookup(docs.select("doc_id", F.sha2("text", 256).alias("text_hash")), _cache(spark, sf), AS_OF, 24)
    return out.select("doc_id", "text_hash", "cache_hit")


@register("cache_hit_rate", A.with_views(f"""
SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses, round(count_if(hit) / count(*), 6) AS hit_rate FROM (
  SELECT EXISTS (SELECT 1 FROM cache c WHERE c.text_hash = sha256(d.text) AND c.stored_at + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}') AS hit
  FROM documents d) x""", CACHE_SQL))
def q_cache_hit_rate(spark, sf):
    docs = A.table(spark, sf, "documents")
    out = L.cache_lookup(docs.select("doc_id", F.sha2("text", 256).alias("text_hash")), _cache(spark, sf), AS_OF, 24)
    return rounded(out.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"),
                           (F.count_if("cache_hit") / F.count("*")).alias("hit_rate")))


STORE_SQL = ("store", "SELECT incident_id, 'v1' AS dataset_version, severity_raw FROM incidents WHERE event_observed")


@register("feature_store_get", A.with_views("""
SELECT a.seq, s.incident_id, round(s.severity_raw, 6) AS severity_raw FROM audit_entries a JOIN store s
  ON s.incident_id = a.incident_id AND s.dataset_version = 'v1'""", STORE_SQL))
def q_feature_store_get(spark, sf):
    store = A.table(spark, sf, "incidents").filter("event_observed").select(
        "incident_id", F.lit("v1").alias("dataset_version"), "severity_raw")
    out = L.store_get(A.table(spark, sf, "audit_entries").select("seq", "incident_id"), store, "v1")
    return rounded(out.select("seq", "incident_id", "severity_raw"))


@register("feature_store_has", A.with_views("""
SELECT a.seq, a.incident_id IN (SELECT incident_id FROM store) AS has_features FROM audit_entries a""", STORE_SQL))
def q_feature_store_has(spark, sf):
    store = A.table(spark, sf, "incidents").filter("event_observed").select("incident_id")
    return L.store_has(A.table(spark, sf, "audit_entries").select("seq", "incident_id"), store).select("seq", "has_features")


@register("vector_topk", A.with_views("""
WITH cen AS (SELECT label, list(v ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e
    GROUP BY label, pos) g GROUP BY label),
sc AS (SELECT c.label AS query_label, e.vec_id,
  list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.c, c.c))) AS score
  FROM embeddings e, cen c)
SELECT query_label, vec_id, rk, round(score, 5) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rk FROM sc) x WHERE rk <= 5"""))
def q_vector_topk(spark, sf):
    emb = A.table(spark, sf, "embeddings")
    out = L.vector_topk_by_centroid(emb, "vec_id", "embedding", "label", 5)
    return out.select("query_label", "vec_id", "rk", F.round("score", 5).alias("score"))


@register("vector_index")
def q_vector_index(spark, sf):
    """The approximate index: queries are the vectors with an id divisible by 100; with each query its share of the exact top ten."""
    emb = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    found = scratch_table(L.vector_index(emb, "vec_id", "embedding", queries, 10), "index-found")
    exact = L.vector_topk(emb, "vec_id", "embedding", queries, 10).select(F.col("query_label").alias("qid"), "vec_id", F.lit(1).alias("hit"))
    share = found.join(exact, ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / 10.0).alias("recall"))
    return rounded(found.join(share, "qid").select("qid", "vec_id", "rk", F.round("score", 5).alias("score"), "recall"))
