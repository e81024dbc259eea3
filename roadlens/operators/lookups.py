"""Lookup-style joins: semi/anti joins, cache and store probes, news matching, vector top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 256  # query vectors per matrix product
PART_VECTORS, PART_QUERIES = 20_000, 4096  # vectors and queries that meet in one task


def adjacency_edges(nodes_with_adj: DataFrame, nodes: DataFrame, adj_col="adjacent_node_ids") -> DataFrame:
    e = nodes_with_adj.select(F.col("node_id").alias("src"), F.explode(adj_col).alias("dst"))
    return e.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def mitigated_flag(incidents: DataFrame, covered: DataFrame, id_col="incident_id") -> DataFrame:
    c = covered.select(F.col(id_col).alias("_c"), F.lit(True).alias("mitigated")).distinct()
    return incidents.join(c, incidents[id_col] == c["_c"], "left").select(
        *incidents.columns, F.coalesce("mitigated", F.lit(False)).alias("mitigated"))


def dispatch_outcome(nearby: DataFrame, drop: float = 30.0, keep_above: float = 40.0) -> DataFrame:
    """The dispatched incident is cleared; each neighbour loses ``drop`` severity points and is
    cleared below ``keep_above``, else kept with an override severity."""
    main = F.col("incident_id") == F.col("target_id")
    new = F.col("severity_raw") - drop
    return nearby.withColumns({
        "new_severity": F.when(main, F.lit(None).cast("double")).otherwise(new),
        "status": F.when(main, "cleared").when(new < keep_above, "cleared").otherwise("override")})


def recent_predictions(incidents: DataFrame, predictions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = incidents.filter(F.col("start_datetime") >= start).select("incident_id", "start_datetime")
    p = predictions.select("incident_id", "model", "predicted")
    return recent.join(p, "incident_id", "left").orderBy(F.col("start_datetime").desc())


def prediction_vs_actual(predictions: DataFrame, truth: DataFrame, pred_col: str, truth_col: str) -> DataFrame:
    return predictions.join(truth, "incident_id").select(
        "incident_id", F.abs(F.col(pred_col) - F.col(truth_col)).alias("abs_error"))


def orphan_counts(specs) -> DataFrame:
    """specs: (label, child, child_key, parent, parent_key) -> one row per foreign key with the orphan count."""
    out = None
    for label, child, ck, parent, pk in specs:
        orph = child.join(parent.select(F.col(pk).alias(ck)).distinct(), ck, "left_anti")
        row = orph.agg(F.count("*").alias("orphans")).select(F.lit(label).alias("fk"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def insert_if_absent(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(existing.select(*keys), keys, "left_anti")


def news_match(news: DataFrame, keywords: list[str], title="title") -> DataFrame:
    kw = F.array(*[F.lit(k.lower()) for k in keywords])
    matched = F.filter(kw, lambda k: F.contains(F.lower(F.col(title)), k))
    return news.withColumn("_m", matched).filter(F.size("_m") > 0).withColumn("matched", F.concat_ws("|", "_m")).drop("_m")


def title_tokens(news: DataFrame, title="title"):
    return F.array_distinct(F.split(F.lower(F.col(title)), "[^a-z0-9_]+"))


def news_for_incident(terms: DataFrame, news: DataFrame, n: int = 5, max_age_days: int = 60) -> DataFrame:
    """Top-n news per incident among items sharing a term, newest (smallest age) first.

    News are ranked once for every different set of terms, and incidents meet that ranking by the set's name: a term of
    a third of all incidents is looked up once.  Each term is first cut to its own top-n (the global top-n of a set is
    inside the union of its terms' top-n), so a common term never pairs a set with every item.
    """
    tok = (news.filter(F.col("age_days") <= max_age_days)
           .select("news_id", "age_days", F.explode(title_tokens(news)).alias("term")))
    wt = Window.partitionBy("term").orderBy("age_days", "news_id")
    per_term = tok.withColumn("_r", F.row_number().over(wt)).filter(F.col("_r") <= n).drop("_r")
    named = terms.select("incident_id", F.array_sort(F.array_distinct("terms")).alias("terms"))
    sets = named.select("terms").distinct()
    cand = sets.select("terms", F.explode("terms").alias("term")).join(per_term, "term").select("terms", "news_id", "age_days").distinct()
    ws = Window.partitionBy("terms").orderBy("age_days", "news_id")
    ranked = cand.withColumn("rk", F.row_number().over(ws)).filter(F.col("rk") <= n)
    ranked = ranked.groupBy("terms").agg(F.collect_list(F.struct("news_id", "age_days", "rk")).alias("_top"))  # n items a set
    return named.join(ranked, "terms").select("incident_id", F.explode("_top").alias("_t")).select("incident_id", "_t.*")


def news_top_n(news: DataFrame, part: list[str], order: str, n: int = 5, max_age_days: int = 60) -> DataFrame:
    """Scan the first 3n items of each feed, drop the old ones, keep n."""
    w = Window.partitionBy(*part).orderBy(order)
    scanned = news.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3 * n)
    fresh = scanned.filter(F.col("age_days") <= max_age_days)
    return fresh.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n).drop("_r")


def cache_lookup(items: DataFrame, cache: DataFrame, as_of: str, ttl_hours: int) -> DataFrame:
    """Hit when the hash is cached and younger than the TTL; misses are what the embedder gets."""
    live = cache.filter(F.timestamp_add("HOUR", F.lit(ttl_hours), F.col("stored_at"))
                        > F.lit(as_of).cast("timestamp_ntz")).select("text_hash").distinct() \
        .withColumn("cache_hit", F.lit(True))
    return items.join(live, "text_hash", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def store_get(requests: DataFrame, store: DataFrame, version: str | None = None) -> DataFrame:
    s = store if version is None else store.filter(F.col("dataset_version") == version)
    return requests.join(s, "incident_id")


def store_has(requests: DataFrame, store: DataFrame) -> DataFrame:
    s = store.select("incident_id").distinct().withColumn("has_features", F.lit(True))
    return requests.join(s, "incident_id", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def centroids(emb: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Mean vector per label (an aggregate per (label, position))."""
    e = emb.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    g = e.groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return g.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s")) \
        .select(label_col, F.transform("_s", lambda s: s["v"]).alias("c"))


def masked_mean(tokens: DataFrame, vec_col: str, mask_col: str, key: str) -> DataFrame:
    """Mean vector ``c`` per key over the rows whose mask is 1 (all zero where there are none)."""
    e = tokens.select(key, mask_col, F.posexplode(vec_col).alias("pos", "x"))
    total = F.sum(F.when(F.col(mask_col) == 1, F.col("x").cast("double")).otherwise(0.0))
    g = e.groupBy(key, "pos").agg((total / F.greatest(F.sum(mask_col), F.lit(1e-9))).alias("v"))
    return g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s")) \
        .select(key, F.transform("_s", lambda s: s["v"]).alias("c"))


def near_pairs(k: int):
    """Of vectors (id, v) and queries (qid, q) that meet in a task, the pairs that can be among a query's best k: scores by matrix
    products, with a margin above their rounding.  Of equal vectors the k smallest ids can, and so of vectors of another length (no
    score); vectors and queries without a direction meet everything."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def matrix(col, dims):
        size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
        same = np.flatnonzero(size == dims)
        x = pc.list_flatten(col.take(pa.array(same))).to_numpy(zero_copy_only=False).astype(float).reshape(len(same), dims)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        return same[good], same[~good], np.flatnonzero(size != dims), x[good] / norm[good, None]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, q = (pa.chunked_array(t[c].chunks, t[c].type).combine_chunks() for t, c in ((left, "v"), (right, "q")))
        pairs = [(np.zeros(0, dtype=np.int64),) * 2]
        if len(v) and len(q):
            sizes = pc.fill_null(pc.list_value_length(q), 0).to_numpy(zero_copy_only=False)
            dims = int(np.bincount(sizes).argmax())
            rank = np.empty(len(v), dtype=np.int64)
            rank[pc.sort_indices(left, sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(v))
            rows, odd, other, x = matrix(v, dims)
            asked, odd_q, other_q, y = matrix(q, dims)
            some = np.concatenate((odd, other[np.argsort(rank[other])][:k]))
            every = np.concatenate((odd_q, other_q))
            pairs += [(np.tile(some, len(asked)), np.repeat(asked, len(some))), (np.tile(np.arange(len(v)), len(every)), np.repeat(every, len(v)))]
            if len(rows) and dims:
                same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * dims}").ravel(), return_inverse=True)[1].ravel()
                order = np.lexsort((rank[rows], same))
                first = np.searchsorted(same[order], same[order])
                kept = order[np.arange(len(order)) - first < k]
                rows, x = rows[kept], x[kept]
                for at in range(0, len(y), QUERY_BLOCK):
                    score = x @ y[at:at + QUERY_BLOCK].T
                    least = np.partition(score, max(len(x) - k, 0), axis=0)[max(len(x) - k, 0)]
                    i, j = np.nonzero(score >= least - 1e-9)
                    pairs.append((rows[i], asked[at + j]))
        i, j = (pa.array(np.concatenate(x)) for x in zip(*pairs))
        return pa.table({"id": left["id"].take(i), "v": left["v"].take(i), "qid": right["qid"].take(j), "q": right["q"].take(j)})

    return run


def vector_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine top-k of the corpus for every row (qid, q) of ``queries``.

    The vectors are cut into parts and the stated query set into blocks, and every part meets every block in one task of
    bounded size.  Matrix products leave the pairs that can be among a query's best k of the part (``near_pairs``); those are
    scored exactly, and a row_number <= k per query keeps the best k.
    """
    parts, blocks = (max(1, -(-df.count() // most)) for df, most in ((corpus, PART_VECTORS), (queries, PART_QUERIES)))
    left = corpus.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    left = left.withColumn("_p", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    right = queries.select("qid", F.transform("q", lambda x: x.cast("double")).alias("q"))
    right = right.withColumn("_b", F.pmod(F.xxhash64("qid", "q"), F.lit(blocks)).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    out = T.StructType([left.schema["id"], left.schema["v"], right.schema["qid"], right.schema["q"]])
    near = left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(near_pairs(k), out)
    v, q = F.col("v"), F.col("q")
    scored = near.select(F.col("id").alias(id_col), F.col("qid").alias("query_label"),
                         (dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))).alias("score"))
    w = Window.partitionBy("query_label").orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def vector_topk_by_centroid(emb: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5) -> DataFrame:
    cen = centroids(emb, vec_col, label_col)
    return vector_topk(emb, id_col, vec_col, cen.select(F.col(label_col).alias("qid"), F.col("c").alias("q")), k)


#: Tables and probes of the random-projection index, and vectors to a bucket.
INDEX_TABLES, INDEX_PROBES, INDEX_BUCKET = 12, 12, 500


def vector_index(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 5, tables: int = INDEX_TABLES,
                 probes: int = INDEX_PROBES, seed: int = 11) -> DataFrame:
    """Approximate cosine top-k for (qid, q): random-projection buckets find candidates, exact scores rank them.

    A table cuts the space by the signs of projections on random directions, as many as leave about ``INDEX_BUCKET`` vectors
    to a bucket.  Every vector lies in one bucket a table; a query asks the ``probes`` buckets whose borders it is nearest to.
    In a bucket, matrix products leave the candidates that can be among a query's best (``near_pairs``); these are scored exactly, once
    a pair; nothing else is compared.  ``vector_topk`` is the exact way.
    """
    import numpy as np
    import pandas as pd

    from roadlens.plans.blocking import split_blocks

    kind = corpus.schema[id_col].dataType.simpleString()
    dims = corpus.select(F.max(F.size(vec_col))).first()[0] or 1
    n = corpus.count()
    bits = max(1, min(16, round(float(np.log2(max(n / INDEX_BUCKET, 1.0))))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    weight = 1 << np.arange(bits)

    def project(vectors: pd.Series) -> np.ndarray:
        x = np.stack([np.resize(np.asarray(v, dtype=float), dims) if len(v) == dims else np.zeros(dims) for v in vectors])
        return np.einsum("nd,tbd->ntb", x, planes)

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                code = (project(pdf["v"]) > 0) @ weight
                yield pd.DataFrame({"table": np.tile(np.arange(tables), len(pdf)), "bucket": code.ravel(), "id": np.repeat(pdf["id"].to_numpy(), tables)})

    def asked(batches):
        for pdf in batches:
            if len(pdf):
                side = project(pdf["q"])
                code = (side > 0) @ weight
                order = np.argsort(np.abs(side), axis=2)
                rows = []
                for c in range(min(probes, 1 << bits)):  # flips of the nearest borders, nearest first
                    flip = sum((1 << order[:, :, j]) * (c >> j & 1) for j in range(bits))
                    rows.append(pd.DataFrame({"table": np.tile(np.arange(tables), len(pdf)), "bucket": (code ^ flip).ravel(),
                                              "qid": np.repeat(pdf["qid"].to_numpy(), tables)}))
                yield pd.concat(rows)

    whole = corpus.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    index = whole.mapInPandas(placed, f"table int, bucket long, id {kind}")
    q_kind = queries.schema["qid"].dataType.simpleString()
    wanted = queries.mapInPandas(asked, f"table int, bucket long, qid {q_kind}")
    whole = whole.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    wanted, index, keys = split_blocks(wanted.distinct(), index.distinct(), ["table", "bucket"], "id", PART_VECTORS)
    left, right = index.join(whole, "id"), wanted.join(queries, "qid")
    out = T.StructType([left.schema["id"], left.schema["v"], right.schema["qid"], right.schema["q"]])
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near_pairs(k), out)
    pairs = near.select("qid", "id").distinct()
    scored = pairs.join(whole, "id").join(queries, "qid").select(
        "qid", F.col("id").alias(id_col), (dot(F.col("v"), F.col("q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
