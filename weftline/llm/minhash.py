"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop, fresh, ready, save, sent, spread_join, table, text_digest, text_slices
from .components import connected_components

#: Minima of a signature, of which two bits each are kept; bands use the first of them.
HASHES = 128
#: A pair at the least similarity shares no band with this probability at most, and is refused by its signature bits with the other.
BAND_MISS, BITS_MISS = 5e-7, 1e-7
#: Rounds in which the members outside a bucket's largest component meet a member of it that a hash picks.
PIVOT_ROUNDS = 1
#: Members of a bucket that one task compares with the bucket's strays.
MEMBERS = 256
SIGNATURE = ("s1", "s2", "s3", "s4")
#: Words of 64 bits in a parity sketch, which bounds how much two sets differ.
PARITY = 32

_MUL, _ADD = tv.stream(HASHES, 11) | np.uint64(1), tv.stream(HASHES, 12)
_FOLD = tv.stream(HASHES, 13) | np.uint64(1)


@dataclass(frozen=True)
class Plan:
    """What follows from the similarity: bands of `rows` minima, and how many minima's two bits may differ."""

    percent: int
    words: int
    bands: int
    rows: int
    off: int

    @classmethod
    def of(cls, percent: int, words: int) -> Plan:
        """The longest bands of which HASHES minima make enough. At similarity s a band is shared with probability s**rows, and a minimum's bits differ with 3/4 * (1 - s)."""
        s = percent / 100
        for rows in range(HASHES, 0, -1):
            bands = 1 if s >= 1 else math.ceil(math.log(BAND_MISS) / math.log1p(-(s**rows)))
            if bands * rows <= HASHES:
                break
        else:
            raise ValueError(f"{HASHES} minima are too few for a similarity of {percent} percent")
        q, off, tail = 0.75 * (1 - s), HASHES, 0.0
        while off and tail + (p := math.comb(HASHES, off) * q**off * (1 - q) ** (HASHES - off)) <= BITS_MISS:
            tail, off = tail + p, off - 1
        return cls(percent, words, bands, rows, off)


def signatures(w: tv.Words, plan: Plan) -> dict[str, np.ndarray | list[bytes]]:
    """For each text: size of its shingle set, 128 bits that name the set (one half from each of the words' two hashes), band keys and signature bits."""
    values, offsets = tv.shingles(w, plan.words)
    others, _ = tv.shingles(w, plan.words, w.others)
    n = len(offsets) - 1
    count, names = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    for i in some:
        own = np.unique(others[offsets[i] : offsets[i + 1]])
        count[i], names[i, 0] = len(own), tv.mix(own).sum()
        names[i, 1] = tv.mix(np.unique(values[offsets[i] : offsets[i + 1]])).sum()
    least = np.zeros((n, HASHES), np.uint64)
    work = np.empty_like(values)
    for j in range(HASHES if len(some) else 0):
        np.multiply(values, _MUL[j], out=work)
        work += _ADD[j]
        work >>= np.uint64(32)
        least[some, j] = np.minimum.reduceat(work, offsets[some])
    keys = np.empty((n, plan.bands), np.uint64)
    for k in range(plan.bands):
        keys[:, k] = tv.mix((least[:, k * plan.rows : (k + 1) * plan.rows] * _FOLD[: plan.rows]).sum(1, dtype=np.uint64) + np.uint64(k + 1))
    planes = [np.packbits((least >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for k in (0, 1)]
    bits = {name: planes[k // 2][:, k % 2] for k, name in enumerate(SIGNATURE)}
    return {"n": count, "cid": [x.tobytes() for x in names]} | bits | {"keys": keys.view(np.int64)}


def _features(docs: DataFrame, plan: Plan) -> DataFrame:
    names = ["doc_id", "h", "n", *SIGNATURE, "cid", "keys"]

    def run(batches):
        for b in batches:
            ids, h = b.column("doc_id"), b.column("h")
            for lo, hi, data, offs in text_slices(b.column("text")):
                s = signatures(tv.words(data, offs, two=True), plan)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * plan.bands, plan.bands, dtype=np.int32)), pa.array(s["keys"].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), h.slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(s[k])) for k in names[2:-2]), pa.array(s["cid"], pa.binary()), keys], names=names)

    return docs.select("doc_id", text_digest().alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, " + ", ".join(f"{c} long" for c in SIGNATURE) + ", cid binary, keys array<long>")


def parity(own: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: each element flips one bit. Sketches differ in no more bits than the sets have elements of one of them only."""
    at = (tv.mix(own ^ np.uint64(0x2127599BF4325C37)) >> np.uint64(64 - (64 * PARITY).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, plan: Plan, repeats: bool) -> DataFrame:
    """cid, whole shingle set and parity sketch of the classes that cids names, from a document of each. The sets hold the hashes that did not make the candidates."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column("text")):
                w = tv.words(data, offs, two=True)
                others, at = tv.shingles(w, plan.words, w.others)
                values, _ = tv.shingles(w, plan.words)
                own = [np.unique(others[at[i] : at[i + 1]]) for i in range(hi - lo)]
                cids = [np.array([tv.mix(x).sum(), tv.mix(np.unique(values[at[i] : at[i + 1]])).sum()], np.uint64).tobytes() for i, x in enumerate(own)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                odd = np.concatenate([parity(x) for x in own])
                rows = np.arange(0, len(odd) + 1, PARITY, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64))), pa.ListArray.from_arrays(pa.array(rows), pa.array(odd))], names=["cid", "shingles", "odd"])

    ids = save(classes.join(cids, "cid", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "ids")
    found = docs.select("doc_id", "text").join(sent(ids), "doc_id", "left_semi").mapInArrow(run, "cid binary, shingles array<long>, odd array<long>")
    if repeats:  # rows of one id may repeat a text, or hold others
        found = found.groupBy("cid").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
    out = save(found, "sets")
    drop(ids)
    return out


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _alike(x: str, y: str, plan: Plan) -> Column:
    """Whether sizes and signatures of the columns with prefixes x and y allow the similarity."""
    size = 100 * F.least(f"{x}n", f"{y}n") >= plan.percent * F.greatest(f"{x}n", f"{y}n")
    off = [F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in SIGNATURE]
    return size & (F.bit_count(off[0].bitwiseOR(off[2])) + F.bit_count(off[1].bitwiseOR(off[3])) <= plan.off)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the parity sketches allow a link. A link has at most (100 - percent) / (100 + percent) of both sizes in one set only, so this loses none."""
    off = sum((F.bit_count(F.col(f"{x}o{i}").bitwiseXOR(F.col(f"{y}o{i}"))) for i in range(PARITY)), F.lit(0))
    return off * (100 + percent) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - percent)


def _prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("key", "part")) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def label_sets(docs: DataFrame, percent: int = 85, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """Features of the rows of docs (doc_id long, text): doc_id, digest h of the text, n, cid and more; and cid, root, component_id, copies of every class that has copies or links. root names a component."""
    ready(docs.sparkSession)
    plan = Plan.of(percent, words)
    feats = save(_features(docs, plan), "minhash")
    real = feats.where("n > 0 and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n", *SIGNATURE, "keys")]
    classes = save(real.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *same), "classes")
    repeats = not real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    own = ("a", "n", *SIGNATURE)
    bands = classes.select(F.col("cid").alias("a"), "n", *SIGNATURE, F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*own)).alias("p")).where("c > 1").select("key", "c", *(F.col(f"p.{c}").alias(f"p_{c}") for c in own))
    shared = save(shared, "shared")
    bucket = save(spread_join(bands, shared, ["key"], "c", classes.count() * plan.bands), "bucket")
    drop(shared)

    first = save(bucket.where("a <> p_a").where(_alike("", "p_", plan)).select("a", F.col("p_a").alias("b")).distinct(), "pairs")
    sets = _sets(docs, classes, first.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), plan, repeats)
    links = save(_confirmed(sets, first, percent), "links")
    drop(first)
    drop(sets)
    label = connected_components(links, "a", "b")

    sets, torn = None, bucket.select("key", *own)
    for k in range(PIVOT_ROUNDS + 1):
        named = torn.join(label, torn["a"] == label["node"], "left").select("key", *own, F.coalesce("root", "a").alias("comp"))
        mixed = save(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed")
        before, torn = torn, save(named.join(sent(mixed), "key", "left_semi"), "torn")
        drop(mixed)
        drop(bucket if not k else before)
        if torn.isEmpty():
            break
        sets = _sets(docs, classes, torn.select(F.col("a").alias("cid")).distinct(), plan, repeats) if sets is None else sets
        held = torn.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct(*own), F.xxhash64("a", "key", F.lit(k))).alias("p"))
        major = held.groupBy("key").agg(F.sum("c").alias("c"), F.max_by(F.struct("comp", "p"), F.struct("c", "comp")).alias("m")).select("key", F.ceil(F.col("c") / MEMBERS).cast("int").alias("parts"), F.col("m.comp").alias("p_comp"), *(F.col(f"m.p.{c}").alias(f"p_{c}") for c in own))
        major = save(major, "major")
        stray = torn.join(sent(major), "key").where("comp <> p_comp")
        if k < PIVOT_ROUNDS:
            near = stray.where(_alike("", "p_", plan)).select(F.greatest("a", "p_a").alias("a"), F.least("a", "p_a").alias("b"))
        else:  # the strays of a bucket meet all its members, which are dealt into parts
            odd = sets.select(F.col("cid").alias("a"), *(F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(PARITY)))
            x = _prefixed(stray.select("key", *own, "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(odd, "a"), "x_")
            members = torn.join(sent(major).select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("a", "key"), F.col("parts")).cast("int")).drop("parts")
            near = x.join(members.join(odd, "a"), ["key", "part"]).where((F.col("x_comp") != F.col("comp")) & _alike("", "x_", plan) & _may_link("", "x_", percent)).select(F.greatest("a", "x_a").alias("a"), F.least("a", "x_a").alias("b"))
        pairs = save(near.distinct(), "pairs")
        more = save(_confirmed(sets, pairs, percent), "links")
        drop(pairs)
        drop(major)
        torn = torn.select("key", *own)
        if not more.isEmpty():
            links = links.unionAll(more)
            drop(label)
            label = connected_components(links, "a", "b")
    drop(sets)

    slim = classes.select("cid", "rep", "copies")
    linked = save(slim.join(label, slim["cid"] == label["node"]).select("cid", "rep", "copies", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c"))
    in_links = spread_join(linked, least, ["root"], "c", linked.count()).select("cid", "root", "component_id", "copies")
    alone = slim.where("copies > 1").join(linked, "cid", "left_anti").select("cid", F.col("cid").alias("root"), F.col("rep").alias("component_id"), "copies")
    return feats, save(in_links.unionByName(alone), "found")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of shingles of `words`
    words. Equal sets are merged first, so copies cost one row. In each bucket, members are compared with the
    bucket's first one; what these links already join needs no more comparing. Then members
    outside a bucket's largest component meet one of its members, which a hash picks anew in each
    bucket; most of a large group is joined by that. Only members that are still outside
    are compared with the rest of their bucket, inside the join, by signatures and by parity sketches
    that bound the sets' difference; so no bucket emits all its pairs and no link between different
    components is lost. A pair is looked at only if its set
    sizes and signature bits allow the similarity, and every link is confirmed on the whole sets.
    A null or empty text has no set and stays alone; so does a null doc_id, which is always kept.
    Rows that repeat a doc_id get a row each, by their own text: unlike texts under one id are compared
    each for itself, and of them one is kept where the id is the least of its component. An empty table
    gives no rows; other columns are ignored.
    """
    feats, found = label_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, words)
    whole = F.col("n") > 0
    rows = feats.where(whole & F.col("doc_id").isNotNull()).select("doc_id", "n", "cid")
    placed = spread_join(rows, found.drop("root"), ["cid"], "copies", feats.count(), "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = feats.where(~whole | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def once(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """docs without the near copies: of each group of linked documents the row of the least doc_id stays, ties by the text's digest, with all its columns.

    Rows are told apart by doc_id and text, so unlike texts under one id are decided each for itself. Of
    rows that agree in both, one stays. Rows with a null doc_id all stay; a null or empty text is no
    copy of another id's. An empty table stays empty.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats, found = label_sets(slim, percent, words)
    rows = feats.where("n > 0 and doc_id is not null").select("doc_id", "h", "cid")
    grouped = save(spread_join(rows, found.drop("component_id"), ["cid"], "copies", feats.count()).select("doc_id", "h", "root"), "grouped")
    stay = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("stay"), F.count(F.lit(1)).alias("c"))
    gone = spread_join(grouped, stay, ["root"], "c", grouped.count()).where(F.struct("doc_id", "h") != F.col("stay"))
    gone = save(gone.select("doc_id", "h").distinct(), "gone")
    again = feats.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "h")
    again = save(again.join(gone, ["doc_id", "h"], "left_anti"), "again")
    id_, digest, at = fresh(docs, "_id", "_h", "_th")
    named = docs.withColumn(at, text_digest())
    keys = lambda df: sent(df).select(F.col("doc_id").alias(id_), F.col("h").alias(digest))
    here = (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(at) == F.col(digest))
    kept = named.join(keys(gone), here, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    single = kept.join(keys(again), here, "left_anti").select(docs.columns)
    return single.unionByName(kept.join(keys(again), here, "left_semi").dropDuplicates(["doc_id", at]).select(docs.columns))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
