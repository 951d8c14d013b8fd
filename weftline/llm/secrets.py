"""Secret scans with corpus-wide ownership frequency, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, save, sent, spread_join, table, text_digest


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the group that holds the credential
    least: int  # its least length


#: A private key reaches to its END line or, without one, over the base64 run after the header: lines of 16 characters or more and a shorter last one, with what stands between them. Possessive groups run in a loop, so a long key needs no stack.
_BEGIN, _END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_GAP = r"(?:\\[nrt]|[^A-Za-z0-9+/=\\-])"
_RUN = rf"(?:(?:\s*+[A-Z][A-Za-z-]*+:\x20[^\r\n]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+=*+)++(?:{_GAP}++[A-Za-z0-9+/]++=*+(?=[\x20\t]*+(?:[\r\n\"'\\]|$)))?+)?+"
#: What a private key's body has beside its characters; copies of a key may differ in that.
_BODY_GAP = r"\\[nrt]|[^A-Za-z0-9+/=]"
#: Base kinds in their order, then those that this method adds.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
    Kind("vendor", r"(?:gh[opsu]_|glpat-|xox[abps]-)[A-Za-z0-9_-]{16,}", 0, 20),
    Kind("private", _BEGIN + rf"((?:[^-]|-(?!----))*+(?={_END})|{_RUN})(?:{_END})?", 1, 0),
)
BASE, PRIVATE = 3, 4
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|gh[opsu]_|glpat-|xox[abps]-|-----BEGIN "
#: A credential that so many owners hold is a copied example; so is one of several owners in so many repositories.
COPIED_OWNERS, COPIED_REPOSITORIES = 4, 8


def _hits(text: Column, kind: Kind, order: int) -> Column:
    """All matches of a kind with the length of the text between them, in order."""
    gaps = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    rows = F.zip_with(F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("w"), v.alias("v"))), F.transform(F.slice(gaps, F.lit(1), F.size(whole)), F.length), lambda a, g: F.struct(g.alias("gap"), a["w"].alias("len"), a["v"].alias("value")))
    return F.struct(F.lit(order).alias("ord"), rows.alias("hits"))


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs without their text, with a row_id; and one row per span: row_id, repo, owner, ord, start, end (code points), value_hash, looks_live.

    Matches of a kind are leftmost and don't overlap; those with a short credential are dropped. A null
    text is empty. The credential itself is not kept, only its hash; a private key's is that of its body.
    A header without a body holds no key and doesn't look live.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.when(t.rlike(_ANY), F.filter(F.array(*(_hits(t, k, i) for i, k in enumerate(KINDS))), lambda h: F.size(h["hits"]) > 0))
    rows = save(docs.select(*(c for c in docs.columns if c != text), repository.alias("_repo"), owner.alias("_owner"), found.alias("_found"), F.monotonically_increasing_id().alias("row_id")), "scan")
    place = ("row_id", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"))
    hits = rows.where(F.size("_found") > 0).select(*place, F.explode("_found").alias("f")).select("row_id", "repo", "owner", "f.ord", F.posexplode("f.hits").alias("pos", "h")).select("row_id", "repo", "owner", "ord", "pos", "h.*")
    before = W.partitionBy("row_id", "ord").orderBy("pos")
    ends = F.sum(F.col("gap") + F.col("len")).over(before)
    least = F.coalesce(*(F.when(F.col("ord") == i, F.lit(k.least)) for i, k in enumerate(KINDS)))
    value = F.when(F.col("ord") == PRIVATE, F.regexp_replace("value", _BODY_GAP, "")).otherwise(F.col("value"))
    spans = hits.select("row_id", "repo", "owner", "ord", (ends - F.col("len")).alias("start"), ends.alias("end"), value.alias("value")).where(F.length("value") >= least)
    varied = F.size(F.array_distinct(F.split("value", ""))) >= 8
    live = (varied & F.col("value").rlike("[0-9]") & ~F.lower("value").rlike("example|changeme|your_?|placeholder|xxxx|1234567")) | ((F.col("ord") == PRIVATE) & (F.col("value") != ""))
    return rows.drop("_found", "_repo", "_owner"), spans.select("row_id", "repo", "owner", "ord", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("value_hash"), live.alias("looks_live"))


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, n_spans, n_repositories, n_owners over the whole corpus, counted from pre-aggregated groups."""
    groups = spans.groupBy("value_hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("value_hash").agg(F.sum("n").alias("n_spans"), F.count_distinct(F.struct("repo", "owner")).alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def find_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, copied: int = COPIED_OWNERS, spread: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per document: its columns but the text, and `spans`, an array of start, ord, kind, end, verdict and owners, by start and then kind.

    verdict: `copied` for a credential that `copied` owners or more hold, or two or more owners in `spread`
    repositories or more, else `live` if it looks like a real one (varied characters with a digit, no
    placeholder word), else `weak`: a value that one owner has in many repositories is still its own. The owner is the
    source and a repository is a source's language unless given. Null owners count as one owner.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    none = F.lit("\0")
    owner = F.coalesce(F.col("source").cast("string"), none) if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), none), F.coalesce(F.col("lang").cast("string"), none)) if repository is None else repository
    rows, spans = scan(docs, repository, owner)
    spans = save(spans, "spans")
    known = ownership(spans)
    wide = (F.col("n_owners") >= copied) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= spread))
    verdict = F.when(wide, "copied").when(F.col("looks_live"), "live").otherwise("weak")
    names = F.array(*(F.lit(k.name) for k in KINDS))
    judged = spread_join(spans, save(known, "known"), ["value_hash"], "n_spans", spans.count()).select("row_id", F.struct("start", "ord", F.get(names, F.col("ord")).alias("kind"), "end", verdict.alias("verdict"), "n_repositories", "n_owners").alias("s"))
    by_row = save(judged.groupBy("row_id").agg(F.sort_array(F.collect_list("s")).alias("spans")), "by_row")
    empty = F.array().cast(by_row.schema["spans"].dataType)
    return rows.join(sent(by_row), "row_id", "left").withColumn("spans", F.coalesce("spans", empty)).drop("row_id")


def redact(docs: DataFrame, verdicts: tuple[str, ...] = ("live",)) -> DataFrame:
    """docs with the spans of these verdicts replaced by [SECRET]; n_chars, if there, is the new length. Other rows stay as they are."""
    id_, digest, size, cut, at, n, new_ = fresh(docs, "_id", "_h", "_n", "_cut", "_th", "_tn", "_new")
    slim = docs.select("doc_id", "text", "source", "lang", text_digest().alias("_h"), F.length("text").alias("_n"))
    found = find_secrets(slim).select("doc_id", "_h", "_n", F.filter("spans", lambda s: s["verdict"].isin(list(verdicts))).alias("_cut"))
    found = save(found.where(F.size("_cut") > 0).groupBy("doc_id", "_h", "_n").agg(F.min("_cut").alias("_cut")), "cuts")
    found = sent(found).select(F.col("doc_id").alias(id_), F.col("_h").alias(digest), F.col("_n").alias(size), F.col("_cut").alias(cut))
    hit = docs.withColumns({at: text_digest(), n: F.length("text")}).join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(at) == F.col(digest)) & (F.col(n) == F.col(size)), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(cut, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    hit = hit.withColumn(new_, F.when(F.col(cut).isNotNull(), done).otherwise(F.col("text")))
    new = {"text": F.col(new_)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(new_)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return hit.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang"))
    base = F.filter("spans", lambda s: s["ord"] < BASE)
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    verdict = lambda name: F.size(F.filter("spans", lambda s: s["verdict"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *(count(k.name) for k in KINDS[:BASE]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), verdict("live"), verdict("copied"))
