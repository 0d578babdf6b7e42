"""Centroid clustering: Lloyd's rounds on vectors that are sharded by dimension.

Vectors are cut into packets of rows and each packet into blocks of columns; the blocks are a table in
the shared folder, bucketed by packet and block. In a round a task works out, for its column blocks, the
exact partial distances of their rows to the matching slices of the centroids; what the blocks of a packet
give is added up by packet and each row takes the nearest centroid. The assignments go back to the
blocks (the bucketed table isn't moved for that), where each block adds up its own columns by cluster,
and its slice of every centroid is replaced by floor(sum / count). Only centroids, of fixed size, pass
through the driver.

All arithmetic is on integers: a component x becomes floor(SCALE * x), and one beyond LARGEST on either
side counts as LARGEST, so that distances of up to 128 components fit a long.

Defined cases: vectors that are null, of another size, or with null or non-finite components are left out;
equal distances go to the smaller number; a cluster without vectors keeps its centroid; a null id is kept
and starts no centroid before one with an id does; repeated rows each get their row, and of equal ids the
least vector starts a centroid first; fewer vectors than centroids give as many centroids as vectors; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, work_dir

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Columns of a block and rows of a packet.
COLUMNS, ROWS = 16, 2048
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dimensions: int, id_column: str, vector_column: str) -> DataFrame:
    """id and v (integers) of the rows that count."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return vectors.filter(v.isNotNull() & (F.size(v) == dimensions) & F.coalesce(finite, F.lit(False))).select(F.col(id_column).alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id: a row for each centroid."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    return np.array([r.v for r in rows.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()], np.int64)


def column_blocks(rows: DataFrame, dimensions: int, columns: int) -> DataFrame:
    """packet, block, n, ids (of block 0 alone) and cells (n rows of a block's columns, as 32-bit integers)."""
    edges = list(range(0, dimensions, columns))
    kind = pa.int64() if dict(rows.dtypes)["id"] == "bigint" else pa.string()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, n = part.column("id").cast(kind).to_pylist(), part.num_rows
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, dimensions)
                cells = [np.ascontiguousarray(v[:, e : e + columns]).tobytes() for e in edges]
                packet = (partition << 32) + at
                at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([packet] * len(edges), pa.int64()), pa.array(range(len(edges)), pa.int32()), pa.array([n] * len(edges), pa.int32()), pa.array([ids, *[None] * (len(edges) - 1)], pa.list_(kind)), pa.array(cells, pa.binary())],
                    names=["packet", "block", "n", "ids", "cells"],
                )

    return rows.mapInArrow(packed, f"packet long, block int, n int, ids array<{'bigint' if pa.types.is_int64(kind) else 'string'}>, cells binary")


def bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, whose files are bucketed so that joins by packet and block don't move them."""
    spark = blocks.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), work_dir(spark, "blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    blocks.repartition(parts, "packet", "block").write.bucketBy(parts, "packet", "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  the name isn't looked up again
    spark.sql(f"DROP TABLE {name}")  # its files stay where the rounds read them
    return table


def assignments(blocks: DataFrame, centroids: np.ndarray, columns: int) -> DataFrame:
    """packet, labels (a byte or two for each row) and distances (longs), as binary: partial distances of the column blocks, added up by packet."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet, block, n, cells in zip(*(batch.column(c).to_pylist() for c in ("packet", "block", "n", "cells"))):
                own = centroids[:, block * columns : (block + 1) * columns]
                v = np.frombuffer(cells, "<i4").astype(np.int64).reshape(n, own.shape[1])
                far = np.stack([((v - c) ** 2).sum(axis=1) for c in own])
                yield pa.RecordBatch.from_arrays([pa.array([packet], pa.int64()), pa.array([far.astype("<i8").tobytes()], pa.binary())], names=["packet", "far"])

    def nearest(group: pa.Table) -> pa.Table:
        """group: the partial distances of a packet's blocks."""
        far = sum(np.frombuffer(x, "<i8") for x in group.column("far").to_pylist()).reshape(len(centroids), -1)
        label = far.argmin(axis=0)
        return pa.table({"packet": group.column("packet")[:1], "labels": pa.array([label.astype("<u2").tobytes()], pa.binary()), "distances": pa.array([far.min(axis=0).astype("<i8").tobytes()], pa.binary())})

    return blocks.select("packet", "block", "n", "cells").mapInArrow(partial, "packet long, far binary").groupBy("packet").applyInArrow(nearest, "packet long, labels binary, distances binary")


def moved(blocks: DataFrame, found: DataFrame, centroids: np.ndarray, columns: int) -> np.ndarray:
    """The centroids after a round: every block's slice from the sums of its own columns."""
    k, edges = len(centroids), list(range(0, centroids.shape[1], columns))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the blocks that the task has, a row for each block and cluster."""
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, n, cells, labels in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "cells", "labels"))):
                label = np.frombuffer(labels, "<u2")
                v = np.frombuffer(cells, "<i4").astype(np.int64).reshape(n, -1)
                own = sums.setdefault(block, [np.zeros(k, np.int64), np.zeros((k, v.shape[1]), np.int64)])
                own[0] += np.bincount(label, minlength=k)
                np.add.at(own[1], label, v)
        for block, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["block", "cluster", "n", "sums"])

    each = found.select("packet", "labels", F.explode(F.array(*(F.lit(b) for b in range(len(edges))))).alias("block"))
    joined = blocks.select("packet", "block", "n", "cells").join(each.hint("shuffle_hash"), ["packet", "block"])
    rows = joined.select("block", "n", "cells", "labels").mapInArrow(added, "block int, cluster int, n long, sums array<long>")
    total = rows.select("block", "cluster", "n", F.posexplode("sums").alias("column", "part")).groupBy("block", "cluster", "column").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in total.filter("n > 0").collect():  # a row for each component of each centroid
        new[r.cluster, r.block * columns + r["column"]] = int(r.total) // r.n
    return new


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3:", dimensions: int = DIMENSIONS, columns: int = COLUMNS, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance (squared, in units of 1 / SCALE) of every vector that counts, and the final centroids."""
    rows = whole_vectors(vectors, dimensions, id_column, vector_column)
    kind = dict(rows.dtypes)["id"]
    centroids = first_centroids(rows, clusters, seed).reshape(-1, dimensions)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    blocks = bucketed(column_blocks(rows, dimensions, columns))
    for _ in range(rounds):
        centroids = moved(blocks, assignments(blocks, centroids, columns), centroids, columns)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, distances in zip(batch.column("ids"), batch.column("labels").to_pylist(), batch.column("distances").to_pylist()):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(labels, "<u2").astype(np.int32)), pa.array(np.frombuffer(distances, "<i8"))], names=["id", "cluster", "distance"])

    named = blocks.filter("block = 0").select("packet", "ids").join(assignments(blocks, centroids, columns).hint("shuffle_hash"), "packet")
    of = dict(blocks.dtypes)["ids"][6:-1]
    out = named.select("ids", "labels", "distances").mapInArrow(listed, f"id {of}, cluster int, distance long")
    return out.select(F.col("id").cast(kind).alias(id_column), "cluster", "distance"), centroids


def centroid_hashes(centroids: np.ndarray) -> list[str]:
    """sha256 of each centroid's components in decimal, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of cluster() with cluster_inertia, inertia (a sum beyond a long is the largest long) and centroid_sha256."""
    found, spark = cut(found, "clusters"), found.sparkSession
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    rows = by.collect()  # a row for each centroid
    total, hashes = sum(int(r.own) for r in rows), centroid_hashes(centroids)
    facts = spark.createDataFrame([(r.cluster, min(int(r.own), 2**63 - 1), min(total, 2**63 - 1), hashes[r.cluster]) for r in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3:", dimensions: int = DIMENSIONS) -> str:
    """The same rounds in SQL, one after the other, for small tables of unique ids."""
    near = """SELECT vec_id, v, n AS cluster, far AS distance FROM (SELECT vec_id, v, n, far, row_number() OVER (PARTITION BY vec_id ORDER BY far, n) AS k FROM
      (SELECT vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM r, {of})) WHERE k = 1"""
    parts = [f"""WITH r AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
      c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1)::INTEGER AS n, v AS c FROM r ORDER BY n LIMIT {clusters})"""]
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED ({near.format(of=f'c{k}')})")
        parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT n, coalesce(new, c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list(CASE WHEN s >= 0 THEN s // m ELSE -((m - 1 - s) // m) END ORDER BY i) AS new FROM
      (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster) ON n = cluster)""")
    parts.append(f"f AS ({near.format(of=f'c{rounds}')})")
    return ", ".join(parts) + f"""
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM f JOIN c{rounds} ON n = cluster"""
