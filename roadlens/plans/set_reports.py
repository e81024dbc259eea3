"""Set-operation, sort/limit and top-k keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens import adapters as A
from roadlens.operators import lookups as L
from roadlens.operators import sets as S
from roadlens.plans.registry import AS_OF, register, rounded


@register("distinct_locations", A.with_views("""
SELECT DISTINCT longitude, latitude FROM incidents WHERE longitude IS NOT NULL AND latitude IS NOT NULL"""))
def q_distinct_locations(spark, sf):
    return S.distinct_locations(A.table(spark, sf, "incidents"), "longitude", "latitude")


@register("split_random", A.with_views("""
SELECT incident_id, CASE WHEN h1 < 15 THEN 'test' WHEN h2 < 15 THEN 'val' ELSE 'train' END AS split
FROM (SELECT incident_id, CAST('0x' || substr(md5(incident_id || ':test'), 1, 8) AS BIGINT) % 100 AS h1,
  CAST('0x' || substr(md5(incident_id || ':val'), 1, 8) AS BIGINT) % 100 AS h2 FROM incidents) x"""))
def q_split_random(spark, sf):
    return S.split_random(A.table(spark, sf, "incidents"), "incident_id").select("incident_id", "split")


STRATIFIED_SQL = """SELECT incident_id, event_cause, CASE WHEN p < 0.70 THEN 'train' WHEN p < 0.70 + 0.15 THEN 'val' ELSE 'test' END AS split
FROM (SELECT incident_id, event_cause, (row_number() OVER (PARTITION BY event_cause ORDER BY md5(incident_id), incident_id) - 1)
    / CAST(count(*) OVER (PARTITION BY event_cause) AS DOUBLE) AS p, count(*) OVER (PARTITION BY event_cause) AS n FROM incidents) x WHERE n > 5"""


@register("split_stratified", A.with_views(STRATIFIED_SQL))
def q_split_stratified(spark, sf):
    out = S.split_stratified(A.table(spark, sf, "incidents"), "incident_id", "event_cause")
    return out.select("incident_id", "event_cause", "split")


TARGETS = ("targets", """SELECT incident_type, max_by(incident_id, arrival_seq) AS target_id,
  max_by(latitude, arrival_seq) AS t_lat, max_by(longitude, arrival_seq) AS t_lon FROM incidents GROUP BY incident_type""")
NEARBY = ("nearby", """SELECT t.target_id, i.incident_id FROM targets t JOIN incidents i
  ON abs(i.latitude - t.t_lat) < 0.015 AND abs(i.longitude - t.t_lon) < 0.015""")


@register("mitigated_union", A.with_views("""
SELECT incident_id FROM nearby UNION SELECT incident_id FROM incidents WHERE severity_raw >= 400""", TARGETS, NEARBY))
def q_mitigated_union(spark, sf):
    from roadlens.plans.join_reports import _nearby
    inc = A.table(spark, sf, "incidents")
    covered = _nearby(inc).select("incident_id")
    extra = inc.filter(F.col("severity_raw") >= 400).select("incident_id")
    return S.union_distinct(covered, extra)


@register("seen_minus_active", A.with_views("""
SELECT DISTINCT user_id FROM events EXCEPT SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'"""))
def q_seen_minus_active(spark, sf):
    ev = A.table(spark, sf, "events")
    active = ev.filter(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("user_id")
    return S.seen_minus_active(ev.select("user_id"), active, "user_id")


@register("retention_archive", A.with_views(f"""
SELECT CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'archive' ELSE 'live' END AS tier, count(*) AS rows
FROM audit_entries GROUP BY 1"""))
def q_retention_archive(spark, sf):
    out = S.retention_tier(A.table(spark, sf, "audit_entries"), "ts", AS_OF, 7)
    return out.groupBy("tier").agg(F.count("*").alias("rows"))


@register("cache_merge", A.with_views(f"""
SELECT d.doc_id, CASE WHEN c.text_hash IS NOT NULL THEN 'cache' ELSE 'fresh' END AS source
FROM documents d LEFT JOIN (SELECT DISTINCT text_hash FROM (SELECT sha256(d2.text) AS text_hash,
    TIMESTAMP '{AS_OF}' - to_hours(d2.doc_id % 48) AS stored_at FROM documents d2 SEMI JOIN labels l ON l.doc_id = d2.doc_id) x
  WHERE stored_at + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}') c ON c.text_hash = sha256(d.text)"""))
def q_cache_merge(spark, sf):
    from roadlens.plans.join_reports import _cache
    docs = A.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    out = S.cache_merge(docs, _cache(spark, sf), AS_OF, 24)
    return out.select("doc_id", "source")


@register("node_sample", A.with_views("""
SELECT round(lon, 9) AS lon, round(lat, 9) AS lat, n_nodes FROM (SELECT lon, lat, min(node_id) AS node_id, count(*) AS n_nodes FROM road_nodes GROUP BY lon, lat) x
ORDER BY md5(CAST(node_id AS VARCHAR) || ':42'), node_id LIMIT 20"""))
def q_node_sample(spark, sf):
    """Twenty different places of nodes, each with the nodes that stand there."""
    places = A.table(spark, sf, "road_nodes").groupBy("lon", "lat").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n_nodes"))
    return rounded(S.sample_by_hash(places, "node_id", 20, 42).select("lon", "lat", "n_nodes"), 9)


@register("audit_recent", A.with_views("SELECT seq, operation, status FROM audit_entries ORDER BY seq DESC LIMIT 100"))
def q_audit_recent(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    return a.orderBy(F.col("seq").desc()).limit(100).select("seq", "operation", "status")


@register("src_audit_tail", A.with_views("SELECT seq, incident_id FROM audit_entries ORDER BY ts DESC, seq DESC LIMIT 100"))
def q_src_audit_tail(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    return a.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(100).select("seq", "incident_id")


@register("audit_filter", A.with_views("""
SELECT seq, incident_id FROM audit_entries WHERE operation = 'embedding_generation' AND status = 'failure'"""))
def q_audit_filter(spark, sf):
    a = A.table(spark, sf, "audit_entries")
    return S.audit_filter(a, operation="embedding_generation", status="failure").select("seq", "incident_id")


@register("topk_attributions", A.with_views("""
SELECT vec_id, rk, feature, round(value, 6) AS value FROM (
  SELECT vec_id, feature, value, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, feature) AS rk FROM (
    SELECT vec_id, 'f' || CAST(i AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 9) t(i)
    UNION ALL
    SELECT vec_id, 'text', list_sum(list_transform(embedding[9:], lambda x: abs(CAST(x AS DOUBLE)))) * sign(list_sum(list_transform(embedding[9:], lambda x: CAST(x AS DOUBLE))))
    FROM embeddings) a) b WHERE rk <= 5"""))
def q_topk_attributions(spark, sf):
    emb = A.table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    names = [f"f{i}" for i in range(1, 9)]
    out = S.topk_attributions(emb.select("vec_id", v.alias("v")), "vec_id", "v", names, 5)
    return rounded(out.select("vec_id", "rk", "feature", "value"))


@register("news_top_n", A.with_views("""
SELECT source, news_id, rk FROM (
  SELECT source, news_id, row_number() OVER (PARTITION BY source ORDER BY news_id) AS rk FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY news_id) AS r FROM news) s WHERE r <= 15) x
  WHERE age_days <= 60) y WHERE rk <= 5"""))
def q_news_top_n(spark, sf):
    out = L.news_top_n(A.table(spark, sf, "news"), ["source"], "news_id", 5, 60)
    return out.select("source", "news_id", "rk")


@register("latest_news_feed", A.with_views("""
SELECT incident_id, news_id, rk FROM (SELECT incident_id, news_id, row_number() OVER (PARTITION BY incident_id ORDER BY age_days, news_id) AS rk
  FROM (SELECT DISTINCT t.incident_id, k.news_id, k.age_days FROM terms t JOIN tok k ON k.term = t.term) c) x WHERE rk <= 5""",
    ("latest", "SELECT max_by(incident_id, arrival_seq) AS incident_id, max_by(event_cause, arrival_seq) AS event_cause FROM incidents"),
    ("terms", "SELECT incident_id, unnest(list_distinct(list_concat(string_split(lower(event_cause), '_'), ['the', 'und', 'der']))) AS term FROM latest"),
    ("tok", "SELECT DISTINCT news_id, age_days, unnest(regexp_split_to_array(lower(title), '[^a-z0-9_]+')) AS term FROM news WHERE age_days <= 60")))
def q_latest_news_feed(spark, sf):
    inc = A.table(spark, sf, "incidents")
    latest = inc.agg(F.max_by("incident_id", "arrival_seq").alias("incident_id"),
                     F.max_by("event_cause", "arrival_seq").alias("event_cause"))
    terms = latest.select("incident_id", F.array_distinct(F.concat(F.split(F.lower("event_cause"), "_"),
                                                                   F.array(*[F.lit(t) for t in ["the", "und", "der"]])))
                          .alias("terms"))
    return L.news_for_incident(terms, A.table(spark, sf, "news"), 5, 60).select("incident_id", "news_id", "rk")
