"""Embedding near-dedup by an exact metric range join.

Unit vectors of one label are within cosine c of each other exactly when they are at most
eps = sqrt(2 - 2c) apart. Pivots cut a label's vectors into cells, each vector's home being the nearest
pivot. A vector y at home with pivot j is also sent to cell i if its distance to the plane between i and j
is at most eps: by the triangle inequality no vector of cell i can be that close to y otherwise. So every
cell joins on its own, counting its home vectors' links against all that it holds.

A cell is cut into blocks of home vectors and blocks of all its vectors, and each pair of blocks is a
group of at most about 2 * BLOCK rows, also where near-copies fill a cell. A group returns counts and a
spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

#: Vectors that a cell should be home of; pivots of all labels together; rows in a block.
CELL, PIVOTS, BLOCK = 4096, 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(id, label, size, v) of the vectors that can have links, components of their own type."""
    good = vectors.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    good = good.select("id", "label", F.size("embedding").alias("size"), F.col("embedding").alias("v"))
    good = good.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return good.filter(F.exists("v", lambda x: x != 0))


def unit(rows) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(good: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, size): vectors lowest by a hash of the id, one for CELL vectors, as many as
    PIVOTS allow; a label without pivots is one cell. At most PIVOTS vectors reach the driver."""
    counts = good.groupBy("label", "size").count().orderBy(F.desc("count"), "label", "size").limit(PIVOTS // 2)
    counts = [tuple(r) for r in counts.collect()]
    total = sum(-(-n // CELL) for *_, n in counts)
    scale = min(1.0, PIVOTS / 2 / max(1, total))
    want = [(label, size, max(1, int(-(-n // CELL) * scale)), n) for label, size, n in counts]
    if not want:
        return {}
    # A few times as many candidates as wanted, by the hash, so that the sort is of a bounded table.
    table = good.sparkSession.createDataFrame([(a, s, k, min(1.0, (4 * k + 16) / n)) for a, s, k, n in want], "label string, size int, k int, rate double")
    h = F.xxhash64("id", F.lit(5))
    near = good.withColumn("label", F.col("label").cast("string")).join(F.broadcast(table), ["label", "size"]).filter(F.pmod(h, F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    found: dict[tuple, list] = {}
    for r in near.select("label", "size", "k", "v").orderBy(h, "id").toLocalIterator():
        at = found.setdefault((r["label"], r["size"]), [])
        if len(at) < r["k"]:
            at.append(r["v"])
    return {k: unit(x) for k, x in found.items()}


def cells(v: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the matrix of the cells that hold it."""
    d2 = np.maximum(0, 2 - 2 * v @ pivots.T)
    home = d2.argmin(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    beyond = (d2 - d2[np.arange(len(v)), home][:, None]) / 2  # distance to the plane, times the gap
    return home, beyond <= (eps + 1e-6) * gap + 1e-9


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component): a row for each row of vectors (id long, label, embedding array<float> or
    array<double>).

    Links join rows of the same label whose vectors have equal length and cosine >= `cosine` in double
    precision, components taken as they are. Null labels and vectors, zero vectors and those with null or
    non-finite components have no links. Rows with one id are vectors of their own: each counts as another
    vector, all are of one component, and what one links to the others reach. A null id has no links, and its
    component is null. Ids without links are their own components. Columns of other names are not looked at. An
    empty table gives an empty result."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        raise ValueError(f"vectors of {kind}")
    wide = np.float64 if kind == "double" else np.float32
    # The rows are the nodes, so that no row of a repeated id is lost. The numbers are written and so stay.
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("node"), "id", "label", "embedding"), "vectors")
    one = rows.select(F.when(F.col("id").isNotNull(), F.col("node")).alias("id"), "label", "embedding")
    good = usable(one)
    pivots = choose_pivots(good)
    eps = float(np.sqrt(2 - 2 * cosine))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(ids, label, size, vectors, homes, cells) of the rows of each label in a batch."""
        for batch in batches:
            frame = batch.to_pandas()
            for (label, size), part in frame.groupby(["label", "size"], sort=False):
                v = np.stack(part["v"].tolist()).astype(wide, copy=False)
                p = shared.value.get((label, size))
                home, held = cells(unit(v), p, eps) if p is not None else (np.zeros(len(v), int), np.ones((len(v), 1), bool))
                yield part["id"].to_numpy(np.int64), label, size, v, home, held

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, label, size, v, home, held in homes(batches):
            k = held.shape[1]
            yield pa.RecordBatch.from_pydict({"label": [label] * k, "size": pa.array([size] * k, pa.int32()), "cell": pa.array(range(k), pa.int32()), "home": np.bincount(home, minlength=k), "held": held.sum(axis=0)})

    keyed = good.select("id", F.col("label").cast("string").alias("label"), "size", "v")
    sums = keyed.mapInArrow(count, "label string, size int, cell int, home long, held long").groupBy("label", "size", "cell").agg(F.sum("home").alias("home"), F.sum("held").alias("held"))
    # Cells with one block of each kind need no entry: the table has N / BLOCK rows at most, and PIVOTS.
    cut = {(r["label"], r["size"], r["cell"]): (-(-r["home"] // BLOCK), -(-r["held"] // BLOCK)) for r in sums.filter(F.greatest("home", "held") > BLOCK).toLocalIterator()}
    blocks = spark.sparkContext.broadcast(cut)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, size, v, home, held in homes(batches):
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for cell in range(held.shape[1]):
                own, all_ = blocks.value.get((label, size, cell), (1, 1))
                mine, here = np.flatnonzero(home == cell), np.flatnonzero(held[:, cell])
                rows = np.concatenate([np.repeat(mine, all_), np.repeat(here, own)])
                if not len(rows):
                    continue
                a = np.concatenate([np.repeat(salt[mine] % np.uint64(own), all_), np.tile(np.arange(own), len(here))])
                b = np.concatenate([np.tile(np.arange(all_), len(mine)), np.repeat(salt[here] % np.uint64(all_), own)])
                yield pa.RecordBatch.from_pydict({"label": [label] * len(rows), "size": pa.array([size] * len(rows), pa.int32()), "cell": pa.array([cell] * len(rows), pa.int32()), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)), "home": np.arange(len(rows)) < len(mine) * all_, "id": ids[rows], "v": _bytes(v[rows])})

    dealt = keyed.mapInArrow(deal, "label string, size int, cell int, a int, b int, home boolean, id long, v binary")
    found = materialize(dealt.groupBy("label", "size", "cell", "a", "b").applyInPandas(_join_blocks(cosine, wide), "id long, n long, link long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # Links of nodes become links of ids; those that only join rows of one id go.
    named = rows.select(F.col("node"), F.col("id").alias("name"))
    links = found.filter("link <> id").select("id", "link").join(named.select(F.col("node").alias("id"), F.col("name").alias("a")), "id").join(named.select(F.col("node").alias("link"), F.col("name").alias("b")), "link")
    linked = components(links.select("a", "b"))
    out = rows.select("node", "id").join(counts.select(F.col("id").alias("node"), "n"), "node", "left").join(linked, "id", "left")
    out = materialize(out.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-components")
    discard(rows, found, linked)
    return out


def _bytes(v: np.ndarray) -> pa.Array:
    """Each row's numbers, as the table has them."""
    v = np.ascontiguousarray(v)
    ends = np.arange(len(v) + 1, dtype=np.int32) * (v.itemsize * v.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(v)])


def _join_blocks(cosine: float, wide: type):
    def join(group: pd.DataFrame) -> pd.DataFrame:
        mine, held = group[group["home"]], group[~group["home"]]
        if not len(mine) or not len(held):
            return pd.DataFrame({"id": [], "n": [], "link": []}).astype("int64")
        ia, ib = mine["id"].to_numpy(), held["id"].to_numpy()
        va, vb = (unit(np.frombuffer(b"".join(side["v"]), wide).reshape(len(side), -1)) for side in (mine, held))
        near = (va @ vb.T >= cosine) & (ia[:, None] != ib)
        # The smallest id that links of this group reach, for all rows of both blocks.
        la, lb, none = ia.copy(), ib.copy(), np.iinfo(np.int64).max
        while len(ia) and near.any():
            na = np.minimum(la, np.where(near, lb, none).min(axis=1))
            nb = np.minimum(lb, np.where(near, na[:, None], none).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        out = pd.DataFrame({"id": np.concatenate([ia, ib]), "n": np.concatenate([near.sum(axis=1), np.zeros(len(ib), np.int64)]), "link": np.concatenate([la, lb])})
        return out[(out["n"] > 0) | (out["link"] != out["id"])]

    return lambda group: join(group)


def embedding_duplicates(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; see `near_duplicates`."""
    out = near_duplicates(embeddings.select(F.col("vec_id").alias("id"), "label", "embedding"), cosine)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
