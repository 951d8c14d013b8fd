"""Near-duplicate embeddings: int8 quantised tile products with rigorous per-vector error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, save, spread_join, table
from .components import connected_components

#: Vectors of a tile's side at most, values in them at most, and rows of a tile that are multiplied at once.
TILE, TILE_VALUES, STRIP = 16_384, 1 << 22, 512
#: Vectors of a length on which pivots are picked, and pivots at most.
SAMPLE, PIVOTS = 2048, 256
#: Rounding of products in single precision, for dimensions up to 1024; longer vectors are multiplied in double precision.
SLACK = 2e-5
EXACT_PAIRS = 200_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, scales, and the length of what the codes leave out."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes that edges join; label is the least member's index."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def tile_links(x: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between rows left and rows right of x (the same rows: each pair once).

    For unit vectors x = a + d and y = b + e with codes a, b: |x.y - a.b| <= |d| + |e| + |d||e|. A pair
    whose quantised product is farther than that from the threshold is decided; the rest are
    multiplied again in double precision. Returns the weight linked to each row, labels of the
    classes that the links make, and how many pairs were multiplied again.
    """
    unit = unit_vectors(x)
    codes, scale, err = quantise(unit)
    kind = np.float32 if x.shape[1] <= 1024 else np.float64
    approx = codes.astype(kind)
    linked, label, again = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    same = left is right
    r_scale, r_err = scale[right].astype(kind), err[right]
    wide = r_err.max(initial=0)
    for lo in range(0, len(left), STRIP):
        rows = left[lo : lo + STRIP]
        # integer products below 2**24 are exact in single precision
        dots = (approx[rows] @ approx[right].T) * r_scale
        dots *= scale[rows].astype(kind)[:, None]
        e = err[rows]
        i, j = np.nonzero(dots >= (least - SLACK - (e + wide + e * wide)).astype(kind)[:, None])
        if same:
            i, j = (k[j > i + lo] for k in (i, j))
        bound = e[i] + r_err[j] + e[i] * r_err[j] + SLACK
        off = dots[i, j].astype(np.float64) - least
        i, j, off, bound = (k[off >= -bound] for k in (i, j, off, bound))
        yes = off >= bound
        for k in np.array_split(open_ := np.flatnonzero(~yes), max(1, -(-len(open_) // EXACT_PAIRS))):
            yes[k] = np.einsum("ij,ij->i", unit[rows[i[k]]], unit[right[j[k]]]) >= least
        again += len(open_)
        u, v = rows[i[yes]], right[j[yes]]
        linked += np.bincount(u, weight[v], len(x)).astype(np.int64) + np.bincount(v, weight[u], len(x)).astype(np.int64)
        _unite(label, u, v)
    return linked, label, again


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_cells(unit: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the cell (its nearest pivot), and the cells that may hold a vector linked to it.

    Let v be nearest to pivot p, u to pivot q. With w the unit vector from p to q, u.w - v.w is at least
    (v.p - v.q) / |q - p|, and no more than |u - v|, which a link keeps within sqrt(2 - 2 * least).
    """
    dots = unit @ pivots.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    margin = dots[np.arange(len(dots)), home][:, None] - dots
    return home, margin <= np.sqrt(max(0.0, 2 - 2 * least)) * apart[home] + 1e-6


def pick_pivots(unit: np.ndarray, blocks: float, least: float) -> np.ndarray:
    """Pivots from a sample: as many, a power of two, as let a vector go to the fewest blocks. blocks: how many all vectors fill."""
    chosen, far = [0], unit @ unit[0]
    while len(chosen) < min(PIVOTS, len(unit) // 4):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, unit @ unit[chosen[-1]])
    best, pivots, k = np.inf, unit[:1], 1
    while k <= len(chosen):
        home, near = near_cells(unit, unit[chosen[:k]], least)
        share = np.bincount(home, minlength=k) / len(unit)
        copies = float((near * np.ceil(share * blocks)).sum(1).mean())
        if copies < best - 1e-9:
            best, pivots = copies, unit[chosen[:k]]
        k *= 2
    return pivots


def _tile(pdf: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    pdf = pdf.sort_values("cid", kind="stable")
    block, ids = pdf["block"].to_numpy(), pdf["cid"].to_numpy()
    a, b = pdf["ta"].iloc[0], pdf["tb"].iloc[0]
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    if not len(left) or not len(right):
        return pd.DataFrame({"cid": ids[:0], "linked": ids[:0], "root": ids[:0]})
    x = np.frombuffer(b"".join(pdf["x"]), kind).reshape(len(pdf), -1)
    linked, label, _ = tile_links(x, left, left if a == b else right, pdf["copies"].to_numpy(), least)
    some = linked > 0
    return pd.DataFrame({"cid": ids[some], "linked": linked[some], "root": ids[label[some]]})


def near_vectors(vectors: DataFrame, least: float = 0.95, tile: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Every pair with cosine >= least is a link. Equal vectors are merged first and counted. The others
    are dealt into cells around pivots and cells into blocks; a vector meets only the blocks of cells
    that may hold a link of it by an exact bound. Each pair of blocks is one task that counts links
    and gives each row one representative, so no pair leaves a task. Where vectors lie in no clusters
    the bound excludes nothing, and work grows with the square of the distinct vectors. Vectors of
    different length never link. Null, zero and non-finite vectors, vectors with null components and
    rows without vec_id link with nothing. Rows that repeat a vec_id with an equal vector count once
    for it; with other vectors, each row has the links of its own vector, and their components are one.
    """
    ready(vectors.sparkSession)
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda c: c + F.lit(0).cast(kind)).alias("v"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    # a vector is known by 128 bits of hash; itself it is kept once
    good = rows.where(ok).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    ids = save(good.groupBy("h1", "h2", "vec_id").agg(F.count(F.lit(1)).alias("rows")), "ids")
    counts = ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    def pack(batches):
        for b in batches:
            v = b.column("v")
            data = v.flatten().to_numpy(zero_copy_only=False).astype(code)
            n = np.diff(v.offsets.to_numpy())
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h1", "h2", "rep", "copies")), pa.array(n, pa.int64()), pa.array([data[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["h1", "h2", "rep", "copies", "dim", "x"])

    code = "<f4" if kind == "float" else "<f8"
    once = good.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(counts, ["h1", "h2"])
    classes = save(once.mapInArrow(pack, "h1 long, h2 long, rep long, copies long, dim long, x binary").withColumn("cid", F.monotonically_increasing_id()), "classes")

    side = lambda d: tile or int(np.clip(TILE_VALUES // max(d, 1), 512, TILE))
    blocks = {r["dim"]: r["n"] / side(r["dim"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for d, n in blocks.items():
        if n > 1:
            sample = classes.where(F.col("dim") == d).select("x").orderBy(F.xxhash64("h1", "h2"), "h1").limit(SAMPLE).collect()
            pivots[d] = pick_pivots(unit_vectors(np.frombuffer(b"".join(r["x"] for r in sample), code).reshape(len(sample), -1)), n, least)

    def deal(batches):
        for b in batches:
            dims, x = b.column("dim").to_numpy(), b.column("x").to_pylist()
            home, cells = np.zeros(len(x), np.int32), [[0]] * len(x)
            for d, p in pivots.items():
                for part in np.array_split(own := np.flatnonzero(dims == d), max(1, -(-len(own) // STRIP))):
                    if len(part):
                        at, near = near_cells(unit_vectors(np.frombuffer(b"".join(x[i] for i in part), code).reshape(len(part), -1)), p, least)
                        home[part] = at
                        for i, row in zip(part.tolist(), near, strict=True):
                            cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("copies"), b.column("dim"), b.column("x"), pa.array(home), pa.array(cells, pa.list_(pa.int32()))], names=["cid", "copies", "dim", "x", "home", "cells"])

    dealt = classes.select("cid", "copies", "dim", "x").mapInArrow(deal, "cid long, copies long, dim long, x binary, home int, cells array<int>")
    sizes = {}
    if pivots:
        dealt = save(dealt, "dealt")
        # PIVOTS rows for each length of vectors at most
        sizes = {(r["dim"], r["home"]): -(-r["n"] // side(r["dim"])) for r in dealt.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = vectors.sparkSession.createDataFrame([(d, c, n) for (d, c), n in sizes.items() if n > 1], "dim long, cell int, parts int")
    of = lambda at, name: F.broadcast(parts.select("dim", F.col("cell").alias(at), F.col("parts").alias(name)))
    dealt = dealt.withColumn("cell", F.explode("cells")).drop("cells").join(of("home", "own"), ["dim", "home"], "left").join(of("cell", "theirs"), ["dim", "cell"], "left")
    name = lambda cell, part: F.shiftleft(F.col(cell).cast("long"), 32) + part
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("theirs", F.lit(1)) - 1))).withColumn("other", name("cell", F.col("part")))
    dealt = dealt.withColumn("block", name("home", F.pmod(F.xxhash64("cid"), F.coalesce("own", F.lit(1)))))
    dealt = dealt.select("cid", "copies", "dim", "x", "block", F.least("block", "other").alias("ta"), F.greatest("block", "other").alias("tb"))
    found = save(dealt.groupBy("dim", "ta", "tb").applyInPandas(lambda pdf: _tile(pdf, least, code), "cid long, linked long, root long"), "tiles")

    links = found.select("cid", "root")
    many = ids.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("vec_id")
    if not many.isEmpty():  # an id with several vectors joins their components
        several = ids.join(many, "vec_id", "left_semi").join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid")
        first = several.groupBy("vec_id").agg(F.min("cid").alias("root"), F.count(F.lit(1)).alias("c"))
        links = links.unionByName(spread_join(several, first, ["vec_id"], "c", several.count()).select("cid", "root"))
    label = connected_components(links, "cid", "root")
    slim = classes.select("cid", "rep")
    named = save(slim.join(label, slim["cid"] == label["node"]).select("cid", "rep", "root"), "named")
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c"))
    component = spread_join(named, low, ["root"], "c", named.count()).select("cid", "component_id")
    linked = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    result = classes.select("h1", "h2", "cid", "rep", "copies").join(linked, "cid", "left").join(component, "cid", "left")
    result = result.select("h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    placed = spread_join(ids, result, ["h1", "h2"], "copies", ids.count())
    out = placed.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
