"""Operator 1: exact top-k search by inner product over sharded M-trees.

1. Vectors become whole numbers. Of equal vectors only the k + 1 smallest ids can be among anyone's k
   best, so only these are searched (a window with a rank limit, which prunes before its shuffle), and
   equal query vectors are searched once: a very common vector costs as much as any other.
2. Points go to the region of the nearest pivot; pivots are sampled vectors, as many as there are
   shards (``max_pivots`` at most), so regions follow the density and each shard has a ball of its own.
   A region above ``shard_rows`` is dealt over several shards by a hash of the id.
3. Each shard builds its M-tree and at once answers its own queries, which gives every query a k-th
   best score to start from. Trees and answers are written to the shared folder.
4. A query visits the other shards whose ball can reach its k-th best score, packed with others in
   blocks of ``block_queries``. Shards are sorted, trees first, so a task holds one tree at a time and
   blocks stream past it, answered by best-first search.
5. The best of each query's answers by a window with a rank limit; every row of the query set gets its
   own without itself.

Defined cases: null vectors, and those holding null or non-finite components, take no part, nor do
null ids, nor vectors whose squared length is beyond a long, as scores with them may have no place in
the result; vectors of different lengths do not meet; repeated rows (same id and vector) count once, and
no row with the query's id is its result; fewer than k candidates give all; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.common import cut
from roadweave.llm.mtree import NONE, MTree


def _numbers(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * dim else "<i8")


def _matrix(column, dim: int) -> np.ndarray:
    if dim and all(len(b) == 4 * dim for b in column):
        return np.frombuffer(b"".join(column), "<i4").reshape(-1, dim)
    return np.array([_numbers(b, dim) for b in column], np.int64).reshape(len(column), dim)


def _whole(x: np.ndarray) -> bytes | None:
    """Little-endian whole numbers, of 4 bytes if all fit; None if the squared length is beyond a long."""
    most = float(np.abs(x).max(initial=0))
    if most >= 2.0**32:
        return None
    x = x.astype(np.int64)
    if most * most * len(x) >= 2.0**62 and sum(v * v for v in x.tolist()) >= 2**63:
        return None
    return x.astype("<i4" if most < 2**31 else "<i8").tobytes()


def whole_vectors(df: DataFrame, *, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component as little-endian whole numbers; distinct rows that take part."""
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & fine)

    def packed(batches):
        for b in batches:
            vectors = b.column(1).to_pylist()
            data = [_whole(np.floor(scale * np.array(v, np.float64))) for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, vectors)), pa.int32()), pa.array(data, pa.binary())], names=["id", "dim", "v"])

    return rows.mapInArrow(packed, "id long, dim int, v binary").where("v is not null").distinct()


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, n vectors in all, drawn by a hash."""
    sample: dict[int, list[bytes]] = {}
    for r in vectors.orderBy(F.xxhash64("dim", "v"), "v").limit(n).collect():
        sample.setdefault(r["dim"], []).append(bytes(r["v"]))
    return {dim: _matrix(data, dim).astype(np.float64) for dim, data in sample.items()}


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None]
    own = d2.argmin(1)
    return own, np.linalg.norm(x - pivots[own], axis=1)


KEY = ["dim", "region", "part"]
_HOME = "dim int, region int, part int, qid long, data binary, ids array<long>, scores array<long>"
_BLOCK = "dim int, region int, part int, kind int, data binary, qids array<long>, floor array<long>, floor_id array<long>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_BLOCK_SCHEMA = pa.schema([*((c, pa.int32()) for c in (*KEY, "kind")), ("data", pa.binary()), ("qids", pa.list_(pa.int64())), ("floor", pa.list_(pa.int64())), ("floor_id", pa.list_(pa.int64()))])
_FOUND_SCHEMA = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0,
          shard_rows: int = 8192, max_pivots: int = 4096, block_queries: int = 256, page: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best other rows."""
    rows = cut(whole_vectors(df, id_col=id_col, vector_col=vector_col, scale=scale))
    most = k + 1  # one more than asked for: a query's own row may be among them
    alike = Window.partitionBy("dim", "v").orderBy("id")
    points = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= most)
    asked = rows.where(F.col("id") % every == 0)
    queries = asked.groupBy("dim", "v").agg(F.min("id").alias("qid"))
    shards = max(8, -(-2 * rows.count() // shard_rows))
    chosen = _pivots(points.where("n = 1").select("dim", "v"), min(shards, max_pivots))
    placeable = points.select("id", F.lit(None).cast("long").alias("qid"), "dim", "v").union(queries.select(F.lit(None).cast("long"), "qid", "dim", "v"))

    def placed(batches):
        for b in batches:
            dims, data = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_pylist()
            region, dist = np.zeros(len(data), np.int32), np.zeros(len(data))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in chosen:  # a length that the sample missed is one region of its own
                    region[at], dist[at] = _nearest(_matrix([data[i] for i in at], int(dim)).astype(np.float64), chosen[int(dim)])
                else:
                    region[at], dist[at] = -1, np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32()), pa.array(dist)], names=["id", "qid", "dim", "v", "region", "dist"])

    dealt = cut(placeable.mapInArrow(placed, "id long, qid long, dim int, v binary, region int, dist double"))
    regions = dealt.where("id is not null").groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("dist").alias("reach")).withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    # one row for each pivot, max_pivots at most, and one for each length that the sample missed
    sharded = dealt.join(F.broadcast(regions.select("dim", "region", "parts")), ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("id", "qid"), F.col("parts")).cast("int"))

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, region, part = (int(pdf[c].iloc[0]) for c in KEY)
        own, mine = pdf[pdf["qid"].isna()], pdf[pdf["qid"].notna()]
        out: list[tuple] = []
        tree = None
        if len(own):
            tree = MTree.build(own["id"].to_numpy(np.int64), _matrix(list(own["v"]), dim), page=page).prepare()
            out.append((dim, region, part, None, tree.to_bytes(), None, None))
        for lo in range(0, len(mine), block_queries):
            block = mine.iloc[lo : lo + block_queries]
            answers = tree.search(_matrix(list(block["v"]), dim), most) if tree else [(np.zeros(0, np.int64),) * 2] * len(block)
            out += [(dim, region, part, int(qid), v, ids, scores) for qid, v, (scores, ids) in zip(block["qid"], block["v"], answers)]
        return pd.DataFrame(out, columns=["dim", "region", "part", "qid", "data", "ids", "scores"]).astype({"qid": "Int64"})

    homes = cut(sharded.groupBy(*KEY).applyInPandas(planted, _HOME))
    reach: dict[int, list[tuple]] = {}
    for r in regions.orderBy("dim", "region").collect():  # as many rows as there are regions
        reach.setdefault(r["dim"], []).append((r["region"], r["reach"], r["parts"]))
    around = {d: (np.array([chosen[d][r] if r >= 0 else np.zeros(d) for r, _, _ in rows]).reshape(len(rows), d), np.array([far for _, far, _ in rows], float)) for d, rows in reach.items()}
    lengths = {d: np.linalg.norm(at, axis=1) for d, (at, _) in around.items()}

    def routed(batches):
        """Queries -> blocks for the shards that can hold better results than their home shard."""
        held: dict[tuple, list[tuple]] = {}
        n = 0

        def blocks(full: int):
            out = []
            for key in [key for key, got in held.items() if len(got) >= full]:
                got = held.pop(key)
                for lo in range(0, len(got), block_queries):
                    qids, data, floor, floor_id = zip(*got[lo : lo + block_queries])
                    out.append((*key, 1, b"".join(data), qids, floor, floor_id))
            return _batch(out, _BLOCK_SCHEMA)

        for b in batches:
            for dim, region, part, qid, data, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
                q = _numbers(data, dim).astype(np.float64)
                wide = _numbers(data, dim).astype("<i8").tobytes()
                floor, floor_id = (scores[-1], ids[-1]) if len(ids) == most else (NONE, np.iinfo(np.int64).max)
                norm = float(np.linalg.norm(q))
                if dim not in reach:
                    continue
                centers, far = around[dim]
                wide_of = norm * far if norm else np.zeros(len(far))  # a region without a centre has no bound
                bounds = centers @ q + wide_of + 1e-9 * (norm * (lengths[dim] + 1) + np.where(np.isfinite(wide_of), wide_of, 0) + 1)
                for i in np.flatnonzero(bounds >= (-np.inf if floor == NONE else float(floor))).tolist():
                    r, _, parts = reach[dim][i]
                    for p in range(parts):
                        if (r, p) != (region, part):
                            held.setdefault((dim, r, p), []).append((qid, wide, floor, floor_id))
                            n += 1
                if n >= 8 * block_queries:
                    yield blocks(block_queries)
                    if sum(map(len, held.values())) >= 64 * block_queries:  # many shards with few queries each
                        yield blocks(1)
                    n = 0
        yield blocks(1)

    routes = homes.where("qid is not null").mapInArrow(routed, _BLOCK)
    none = {"qids": "array<long>", "floor": "array<long>", "floor_id": "array<long>"}
    trees = homes.where("qid is null").select(*KEY, F.lit(0).alias("kind"), "data", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))

    def answered(batches):
        tree, now = None, None
        for b in batches:
            for i in range(b.num_rows):  # one block at a time
                dim, region, part, kind, data, qids, floor, floor_id = (c[i].as_py() for c in b.columns)
                if kind == 0:
                    tree, now = MTree.from_bytes(data).prepare(), (dim, region, part)
                elif now == (dim, region, part):
                    answers = tree.search(np.frombuffer(data, "<i8").reshape(-1, dim), most, np.array(floor), np.array(floor_id))
                    yield _batch([(qid, ids, scores) for qid, (scores, ids) in zip(qids, answers) if len(ids)], _FOUND_SCHEMA)

    met = trees.union(routes).repartition(*KEY).sortWithinPartitions(*KEY, "kind")
    more = met.mapInArrow(answered, "qid long, ids array<long>, scores array<long>")
    found = homes.where("qid is not null").select("qid", "ids", "scores").union(more)
    each = found.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("qid", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    best = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    others = asked.join(queries, ["dim", "v"]).join(best, "qid").select(
        F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("best")
    )
    return others.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
