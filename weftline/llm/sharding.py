"""K-d tree sharding: cuts at distributed weighted medians, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, numbered, save, sent, table

#: A cut's order key has 52 bits (20 of the dimension, 32 of the tie), found 18 bits a pass: a node has 262,144 sums a pass at most, whatever the input.
DIGITS, BITS = 3, 18
#: A cut moves to the nearer edge of a group of equal keys if that shifts at most this share of a leaf.
SNAP = 0.005


#: Nodes that a level may have at most for their table to pass through the driver; tables of more are written.
FEW = 4096


def _hold(df: DataFrame, nodes: int) -> DataFrame:
    """A table with one row a node, of which there are `nodes` at most, evaluated once."""
    if nodes > FEW:
        return save(df, "nodes")
    value = lambda v: "null" if v is None else f"double('{v!r}')" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)
    rows = [f"({', '.join(map(value, r))})" for r in df.collect()]
    names = ", ".join(df.columns)
    typed = ", ".join(f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in df.schema)
    none = f"({', '.join(['null'] * len(df.columns))})"
    return df.sparkSession.sql(f"SELECT {typed} FROM VALUES {', '.join(rows) or none} AS t({names}){'' if rows else ' WHERE false'}")


def _small(df: DataFrame, nodes: int) -> DataFrame:
    return F.broadcast(df) if nodes <= FEW else sent(df)


def _crossing(rows: DataFrame, nodes: DataFrame, key: str, n: int) -> DataFrame:
    """node, goal, at, before, group for each of the n nodes at most (node, goal): the value of key where the node's running weight reaches its goal, the weight before it and its own.

    One digit a pass: rows that agree with the digits found so far are summed by the next one, and a
    window over a node's sums finds where they cross.
    """
    state = nodes.select("node", "goal", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("group"))
    order = W.partitionBy("node").orderBy("digit")
    for d in range(DIGITS):
        shift = BITS * (DIGITS - 1 - d)
        inside = rows.select("node", "weight", key).join(_small(state, n), "node").where(F.shiftright(key, shift + BITS) == F.col("at"))
        sums = inside.groupBy("node", "goal", "before", F.shiftright(key, shift).alias("digit")).agg(F.sum("weight").alias("w"))
        run = sums.withColumn("up_to", F.col("before") + F.sum("w").over(order)).withColumn("final", F.lead("digit").over(order).isNull())
        # the first sum that reaches the goal, or a node's last one
        hit = run.where(((F.col("up_to") >= F.col("goal")) & (F.col("up_to") - F.col("w") < F.col("goal"))) | (F.col("final") & (F.col("up_to") < F.col("goal"))))
        old, state = state, _hold(hit.select("node", "goal", F.col("digit").alias("at"), (F.col("up_to") - F.col("w")).alias("before"), F.col("w").alias("group")), n)
        drop(old)
    return state


def kd_shards(rows: DataFrame, dims: list[str], leaves: int) -> tuple[DataFrame, DataFrame]:
    """Add a column shard, 0 to leaves - 1, so that shards have nearly equal sums of the column weight.

    rows has weight (long), tie (long of 32 bits, equal for rows that should stay together), last (long
    of 52 bits) and the columns dims (numbers, null counts as 0). A node with k leaves is cut along its
    widest dimension, relative to the dimension's whole width, where the weight reaches k // 2 of k
    parts. The cut is exact: rows are ordered by dimension, tie and last, and the position is found
    by sums of ever finer ranges of that order. Nodes are a table too, so leaves may be many. Also
    returns the cuts: node, first, leaves, dim, cut, last.
    """
    spark = rows.sparkSession
    whole = rows.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    lo = {d: float(whole[f"lo_{d}"] or 0) for d in dims}
    wide = {d: float(whole[f"hi_{d}"] or 0) - lo[d] for d in dims}
    top = (1 << 20) - 1
    scaled = {d: F.least(F.lit(top), F.floor((F.coalesce(F.col(d).cast("double"), F.lit(0.0)) - lo[d]) / wide[d] * top).cast("long")) if wide[d] > 0 else F.lit(0).cast("long") for d in dims}
    names = {d: f"_{d}" for d in dims}
    placed = rows.withColumns({names[d]: c for d, c in scaled.items()} | {"node": F.lit(1).cast("long"), "first": F.lit(0).cast("long"), "leaves": F.lit(leaves).cast("long")})
    cuts = spark.createDataFrame([], "node long, first long, leaves long, dim string, cut long, last long")
    depth, written = max(0, (leaves - 1).bit_length()), None
    for level in range(depth):
        n = min(leaves, 2**level)  # nodes of this level at most
        span = [F.struct((F.max(names[d]) - F.min(names[d])).alias("span"), F.lit(d).alias("dim")) for d in dims]
        found = placed.where("leaves > 1").groupBy("node", "first", "leaves").agg(F.sum("weight").alias("w"), F.greatest(*span)["dim"].alias("dim") if len(dims) > 1 else F.lit(dims[0]).alias("dim"))
        half = F.floor(F.col("leaves") / 2)
        nodes = _hold(found.select("node", "first", "leaves", "dim", (F.col("w") * half / F.col("leaves")).alias("goal"), (F.col("w") / F.col("leaves") * SNAP).alias("slack")), n)
        if nodes.isEmpty():
            break
        own = F.coalesce(*(F.when(F.col("dim") == d, F.col(names[d])) for d in dims))
        keyed = placed.where("leaves > 1").select("node", "weight", "tie", "last", *names.values()).join(_small(nodes.select("node", "dim"), n), "node")
        keyed = keyed.select("node", "weight", "last", F.shiftleft(own, 32).bitwiseOR(F.col("tie")).alias("key"))
        at = _crossing(keyed, nodes.select("node", "goal"), "key", n)
        under, over = F.col("goal") - F.col("before"), F.col("before") + F.col("group") - F.col("goal")
        edge = at.join(nodes.select("node", "slack"), "node").withColumn("last", F.when(under < over, F.lit(-1)).otherwise(F.lit(1 << 52)).cast("long")).withColumn("deep", F.least(under, over) > F.col("slack"))
        edge = _hold(edge, n)
        deep = edge.where("deep")
        if not deep.isEmpty():  # a group of equal keys is too large to stay together
            group = keyed.join(_small(_hold(deep.select("node", F.col("at").alias("cut")), n), n), "node").where("key = cut").select("node", "weight", "last")
            inner = _crossing(group, deep.select("node", (F.col("goal") - F.col("before")).alias("goal")), "last", n)
            inner = inner.select("node", F.when(under < over, F.col("at") - 1).otherwise(F.col("at")).alias("inner"))
            edge = edge.join(inner, "node", "left").withColumn("last", F.coalesce("inner", "last"))
        table_ = _hold(nodes.join(edge.select("node", F.col("at").alias("cut"), "last"), "node").select("node", "first", "leaves", "dim", "cut", "last"), n)
        cuts = cuts.unionByName(table_)
        side = _small(table_.select("node", "dim", "cut", F.col("last").alias("_last")), n)
        key = F.shiftleft(own, 32).bitwiseOR(F.col("tie"))
        left = (key < F.col("cut")) | ((key == F.col("cut")) & (F.col("last") <= F.col("_last")))
        step = placed.join(side, "node", "left").withColumn("_left", F.when(F.col("dim").isNotNull(), left)).withColumn("_half", F.floor(F.col("leaves") / 2))
        moved = {
            "node": F.when(F.col("_left"), F.col("node") * 2).when(~F.col("_left"), F.col("node") * 2 + 1).otherwise(F.col("node")),
            "first": F.when(~F.col("_left"), F.col("first") + F.col("_half")).otherwise(F.col("first")),
            "leaves": F.when(F.col("_left"), F.col("_half")).when(~F.col("_left"), F.col("leaves") - F.col("_half")).otherwise(F.col("leaves")),
        }
        before, written = written, save(step.withColumns(moved).select(placed.columns), "kd")
        placed = written
        drop(before)
    return placed.withColumn("shard", F.col("first").cast("int")).drop("node", "first", "leaves", *names.values()), cuts


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; sizes of shards are near equal.

    The tree's dimensions are the logarithm of the size and the language; a text that occurs under
    several languages counts under the least, so equal texts share both. Its ties are the text's
    crc32 and then a hash of doc_id. So equal texts lie together unless a cut falls into a group too
    large for its side. With target_bytes the number of leaves follows from the whole size. A null text
    has size 1 and crc 0; a null language is a language; rows that repeat a doc_id with one text stay
    together, also where a cut falls into their group; an empty table gives no rows. Only slim columns
    are moved; other columns are ignored.
    """
    code: Column = F.coalesce(F.crc32(F.col("lang").cast("string").cast("binary")), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), code.alias("lang_code"))
    rows = save(rows.select("*", F.col("size").alias("weight"), F.log2("size").alias("log_size"), F.col("text_crc32").alias("tie"), F.shiftrightunsigned(F.xxhash64("doc_id"), 12).alias("last")), "meta")
    mixed = rows.groupBy("text_crc32", "size").agg(F.min("lang_code").alias("least"), F.max("lang_code").alias("most")).where("least < most").drop("most")
    mixed = save(mixed, "mixed")
    if not mixed.isEmpty():
        rows = rows.join(sent(mixed), ["text_crc32", "size"], "left").withColumn("lang_code", F.coalesce("least", "lang_code")).drop("least")
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    found, _ = kd_shards(rows, ["log_size", "lang_code"], shards)
    slim = numbered(found.select("doc_id", "size", "text_crc32", "shard"), ["shard"], "slot")
    return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
