"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ranged by length (longest first) and cut into buckets of at most ``bucket_rows``; a bucket
is one row with its ids, matrix and length limits.  Queries are blocks of rows.  A first pass over the
longest bucket gives every query a lower bound on its k-th score.  Then each (query block, bucket)
pair that can still matter is one task row.  With theta the query's bound, theta / (|q| * longest) is
the cosine a bucket's vectors must reach: over 1, the query skips the bucket; high, the *coordinate*
test keeps the vectors whose value at the query's largest coordinates is feasible for that cosine;
else the *length* test keeps the prefix of vectors that are long enough.  What is left is verified by
exact integer products, and the k best of each bucket meet in a per-query ranking.

Bounds are taken with a margin for rounding, so no vector is lost; products are integers and are
computed in a float type only while every partial sum is exactly representable.

Scale: the work is (queries / block) * (vectors / bucket) independent pairs, each of bounded memory;
thresholds prune pairs before their matrices are joined.  Nothing is collected; the planner's
pairing join is over one metadata row per block and bucket.

Defined results: a row takes no part if its id or vector is null or a component is null, NaN or
infinite; an empty vector is a vector of length 0; vectors of different dimensions are compared as if
padded with zeros; rows repeated under one id are all candidates for other queries and none for their
own, and their query is the smallest of the vectors; ties go to the smaller vec_id; an empty
table gives no rows; other columns are not read.  Products beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

COORDINATES = 3
#: From this local cosine on, the coordinate test is chosen.
HIGH_COSINE = 0.55


def valid(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, norm2): components floor(scale * x) as doubles that hold integers."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    rows = rows.select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("double")).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))


def blocks(rows: DataFrame, size: int, descending: bool, tag: str) -> DataFrame:
    """Rows (block, n, dims, longest, shortest, largest, ids, mat) of up to ``size`` vectors, by length."""
    order = F.col("norm2").desc() if descending else F.col("norm2")
    n = rows.count()
    parts = max(1, min(-(-n // size), 10_000))
    ranged = rows.repartitionByRange(parts, order, "vec_id").sortWithinPartitions(order, "vec_id")
    ranged = ranged.withColumn("part", F.spark_partition_id())
    schema = "part long, seq long, n long, dims long, longest double, shortest double, largest double, ids binary, mat binary"

    def run(batches):
        seq, held = 0, []

        def made(held, seq):
            ids = np.array([r[0] for r in held], dtype=np.int64)
            dims = max(len(r[1]) for r in held)
            mat = np.zeros((len(held), dims))
            for i, r in enumerate(held):
                mat[i, :len(r[1])] = r[1]
            length = np.sqrt([r[2] for r in held])
            row = [held[0][3], seq, len(held), dims, length.max(), length.min(), np.abs(mat).max(initial=0.0),
                   ids.tobytes(), mat.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=t) for v, t in zip(row, [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.binary()] * 2)],
                ["part", "seq", "n", "dims", "longest", "shortest", "largest", "ids", "mat"])

        for batch in batches:
            ids, vecs, norms, part = batch.columns
            off = vecs.offsets.to_numpy()
            flat = vecs.values.to_numpy(zero_copy_only=False)
            for i, (v, m, p) in enumerate(zip(ids.to_numpy(), norms.to_numpy(), part.to_numpy())):
                held.append((v, flat[off[i]:off[i + 1]], m, p))
                if len(held) == size:
                    yield made(held, seq)
                    seq, held = seq + 1, []
        if held:
            yield made(held, seq)

    made = ranged.select("vec_id", "v", "norm2", "part").mapInArrow(run, schema)
    return C.saved(made.select((F.col("part") * (1 << 32) + F.col("seq")).alias("block"), *[c for c in made.columns if c not in ("part", "seq")]), tag)


def matrix(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix padded to dims) of a block."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    mat = np.frombuffer(row["mat"], dtype=np.float64).reshape(len(ids), row["dims"])
    if row["dims"] < dims:
        mat = np.hstack([mat, np.zeros((len(ids), dims - row["dims"]))])
    return ids, mat


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and p."""
    limit = q.shape[1] * np.abs(q).max(initial=0.0) * np.abs(p).max(initial=0.0)
    if limit < 2**24:
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if limit < 2**53:
        return (q @ p.T).astype(np.int64)
    wide = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in p] for x in q]
    return np.array(wide, dtype=np.int64).reshape(len(q), len(p))


def best(qid: np.ndarray, pid: np.ndarray, score: np.ndarray, k: int):
    """The k highest rows of each query (ties: smaller id)."""
    order = np.lexsort((pid, -score, qid))
    qid, pid, score = qid[order], pid[order], score[order]
    rank = np.arange(len(qid)) - np.searchsorted(qid, qid, side="left")
    keep = rank < k
    return qid[keep], pid[keep], score[keep]


def retrieve(q: dict, b: dict, theta: np.ndarray | None, k: int):
    """The k best of one bucket for each query of one block, as (query ids, vector ids, scores)."""
    dims = max(q["dims"], b["dims"])
    qid, qm = matrix(q, dims)
    pid, pm = matrix(b, dims)
    out = ([], [], [])

    def add(i, rows, score, bound):
        keep = (pid[rows] != qid[i]) & ((score >= bound) if bound is not None else True)
        rows, score = rows[keep], score[keep]
        if len(rows) > k:
            cut = np.lexsort((pid[rows], -score))[:k]
            rows, score = rows[cut], score[cut]
        for col, v in zip(out, (np.full(len(rows), qid[i]), pid[rows], score)):
            col.append(v)

    if theta is None:
        s = products(qm, pm)
        for i in range(len(qid)):
            add(i, np.arange(len(pid)), s[i], None)
    else:
        qlen, plen = np.sqrt((qm * qm).sum(axis=1)), np.sqrt((pm * pm).sum(axis=1))
        slack = 1 + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(theta > 0, theta / (qlen * b["longest"]), -1.0)
        live = np.flatnonzero(~(local > slack))
        high = live[local[live] >= HIGH_COSINE]
        low = live[~(local[live] >= HIGH_COSINE)]
        unit = pm / np.maximum(plen, 1e-300)[:, None]
        for i in high:  # coordinate test
            u, c = qm[i] / qlen[i], min(local[i], 1.0)
            ok = plen * (qlen[i] * slack) >= theta[i]
            for f in np.argsort(-np.abs(u))[:COORDINATES]:
                # a unit vector within the angle of c has its coordinate within the same angle of u[f]
                room = np.sqrt((1 - c * c) * max(0.0, 1 - u[f] * u[f])) + 1e-9
                if u[f] >= -c:
                    ok &= unit[:, f] >= c * u[f] - room
                if u[f] <= c:
                    ok &= unit[:, f] <= c * u[f] + room
            rows = np.flatnonzero(ok)
            if len(rows):
                add(i, rows, products(qm[i:i + 1], pm[rows])[0], theta[i])
        if len(low):  # length test: vectors are sorted by length, longest first
            need = np.where(theta[low] > 0, theta[low] / np.maximum(qlen[low], 1e-300) / slack, -1.0).min()
            upto = int(np.searchsorted(-plen, -need, side="right")) if need > 0 else len(pid)
            s = products(qm[low], pm[:upto])
            hit = s >= theta[low][:, None]
            for j, i in enumerate(low):
                rows = np.flatnonzero(hit[j])
                if len(rows):
                    add(i, rows, s[j, rows], theta[i])
    cols = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
    return cols


_OUT = "query_id long, vec_id long, score long"


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """Run ``retrieve`` on rows holding a query block (q_*) and a bucket (b_*), one pair at a time."""
    schema = _OUT

    def run(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0].as_py() for c in table.column_names}
        q = {c: row[f"q_{c}"] for c in ("dims", "ids", "mat")}
        b = {c: row[f"b_{c}"] for c in ("dims", "ids", "mat", "longest")}
        theta = row.get("theta")
        cols = retrieve(q, b, None if theta is None else np.frombuffer(theta, dtype=np.int64), k)
        return pa.table([pa.array(c, type=pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return pairs.groupBy("q_block", "b_block").applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 64, bucket_rows: int = 4096,
          query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row."""
    rows = C.saved(valid(vectors, scale), "vectors")
    asked = valid(queries, scale).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("x")).select("vec_id", "x.*")
    b = blocks(rows, bucket_rows, True, "buckets")
    q = blocks(asked, query_rows, False, "queries")
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])

    longest = b.agg(F.min("b_block").alias("b_block"))  # the first bucket holds the longest vectors
    head = b.join(longest, "b_block")  # one row of at most bucket_rows vectors
    first = C.saved(_scored(q.join(F.broadcast(head), F.col("q_n") > 0), k), "first")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", F.col("score").alias("t"))

    bounds = C.saved(_bounds(q, kth), "bounds")
    pairs = b.select("b_block", "b_longest").join(
        q.select("q_block", "q_longest").join(bounds.select("q_block", "least"), "q_block"),
        (F.col("least") <= 0) | (F.col("least") <= F.col("b_longest") * F.col("q_longest") * (1 + 1e-9)))
    # the first bucket is scored again with the rest, so that its rows come back only once
    pairs = C.saved(pairs.select("b_block", "q_block"), "pairs")
    full = pairs.join(b, "b_block").join(q, "q_block").join(bounds.select("q_block", "theta"), "q_block")
    found = _scored(full, k)
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(q: DataFrame, kth: DataFrame) -> DataFrame:
    """(q_block, theta, least): per block, the lower bound of every query's k-th score (none: lowest)."""
    schema = "q_block long, vec_id long, place int"

    def ids(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(blob, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block)), pa.array(v),
                                                  pa.array(np.arange(len(v), dtype=np.int32))], ["q_block", "vec_id", "place"])

    each = q.select("q_block", "q_ids").mapInArrow(ids, schema)
    each = each.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")

    def fold(table: pa.Table) -> pa.Table:
        t = table.column("t").fill_null(-(1 << 62)).to_numpy()[np.argsort(table.column("place").to_numpy())]
        return pa.table({"q_block": [table.column("q_block")[0].as_py()], "theta": [t.astype(np.int64).tobytes()],
                         "least": [float(t.min())]})

    return each.groupBy("q_block").applyInArrow(fold, "q_block long, theta binary, least double")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
