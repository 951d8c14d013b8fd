"""Text functions as column expressions; Python only for Unicode normalisation and SQL statements, by Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.parsers import sql

# Fixed values.
WEB_ROOTS = ("src/main/webapp/", "WebRoot/", "WebContent/", "web/")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
CONTROLS = r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]+"
CHUNK, OVERLAP = 256 * 1024, 2 * 1024
SLUG, DIGEST = 48, 16
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)))
#: What stands for the application's own root in links of pages.
CONTEXT_PATH = r"\$\{\s*(?:pageContext\.request\.contextPath|ctx|contextPath)\s*\}|<%=\s*request\.getContextPath\(\)\s*%>"
DYNAMIC = r"\$\{|%\{|#\{|<%"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC, lower case, trimmed."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower().strip())


def path_normal(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def path_is_safe(path: Column) -> Column:
    """Relative, without drive, NUL or a parent step."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.contains("\0") | F.exists(F.split(path, "/"), lambda p: p.isin("..", ".", "")))


def path_is_strict(path: Column) -> Column:
    """Safe, and a name that every system takes: no control or special characters, no reserved device names, no part that ends in a dot or blank or is longer than 255."""
    bad = lambda p: p.rlike(r'[\x00-\x1f<>:"|?*\\]') | p.rlike(r"[. ]$") | (F.length(p) > 255) | F.lower(F.regexp_extract(p, r"^[^.]*", 0)).isin(*RESERVED)
    return path_is_safe(path) & ~F.exists(F.split(path, "/"), bad)


def web_path(path: Column) -> Column:
    """The part after the first web root that a path holds, from /; the whole path from / without one."""
    found = F.coalesce(*(F.when(F.locate(r, path) > 0, F.substring(path, F.locate(r, path) + len(r), F.length(path))) for r in WEB_ROOTS), path)
    return F.concat(F.lit("/"), F.regexp_replace(found, "^/+", ""))


def http_method(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin(*METHODS), v).otherwise("")


def plain_text(value: Column) -> Column:
    """Control, format, surrogate and separator runs become one space."""
    return F.regexp_replace(value, CONTROLS, " ")


def chunks(value: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Distinct overlapping pieces of a long text; a short text is one piece."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(value) - overlap) / step).cast("int"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(value, i * step + 1, F.lit(size))))


def markdown_inline(value: Column, most: int = 32 * 1024) -> Column:
    return F.regexp_replace(F.substring(plain_text(value), 1, most), r"([\\`\[\]<>])", r"\\$1")


def diagram_label(value: Column, most: int = 60) -> Column:
    """Letters, digits and a few marks; a long label ends in a hash of the whole."""
    shown = F.trim(F.regexp_replace(F.regexp_replace(value, r"[^\p{L}\p{N} _./:-]+", " "), r"\s+", " "))
    return F.when(F.length(shown) <= most, shown).otherwise(F.concat(F.substring(shown, 1, most - 9), F.lit("-"), F.substring(F.sha2(value, 256), 1, 8)))


def slug(value: Column) -> Column:
    """A file name of a scope: its normal form if that is plain and short, else its readable part and a digest of the normal form."""
    text = nfkc(F.coalesce(value, F.lit("")))
    readable = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")
    plain = (readable == text) & (F.length(text) <= SLUG) & ~text.isin(*RESERVED)
    named = lambda c: F.when(c == "", "scope").otherwise(c)
    head = named(F.rtrim(F.translate(F.substring(named(readable), 1, SLUG - DIGEST - 2), "-", " ")))
    shown = F.concat(F.translate(head, " ", "-"), F.lit("--"), F.substring(F.sha2(text.cast("binary"), 256), 1, DIGEST))
    return F.when(text == "", "scope").when(plain, text).otherwise(shown)


def module_of(url: Column) -> Column:
    """First segment of a route of two or more, else root."""
    parts = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise("root")


def type_name(value: Column) -> Column:
    """A Java type without generics and array marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"<.*>", ""), r"(?:\[\s*\]|\.\.\.)", ""))


def simple_name(value: Column) -> Column:
    return F.element_at(F.split(type_name(value), r"\."), -1)


def signature_simple(value: Column) -> Column:
    """A method signature without package names."""
    return F.regexp_replace(value, r"(?:[A-Za-z_$][\w$]*\.)+(?=[A-Za-z_$])", "")


def access(reads: Column, writes: Column) -> Column:
    return F.when(reads & writes, "read-write").when(writes, "write").when(reads, "read")


def query_params(url: Column) -> Column:
    """Map of the parameters of a URL; a name with different values, or a dynamic value, has ''. Nameless and dynamic names are dropped."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&(?:amp;)?"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & ~p["k"].rlike(r"[$#]\{|<%"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    value = lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: F.when(p["v"].rlike(r"[$#]\{|<%"), "").otherwise(p["v"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.when(F.size(value(k)) == 1, F.get(value(k), F.lit(0))).otherwise("")))


def merge_params(a: Column, b: Column) -> Column:
    """Union of two parameter maps; values that differ become ''."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull() | (x == y), x).otherwise(""))


def url_resolved(base: Column, target: Column) -> Column:
    """Path of a link on the page `base`; null for an external or dynamic one. Dot steps and repeated slashes go."""
    value = F.trim(F.regexp_replace(target, CONTEXT_PATH, ""))
    path = F.regexp_extract(value, "^[^?#]*", 0)
    off = value.startswith("#") | value.startswith("//") | value.startswith("\\\\") | value.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | path.rlike(f"[<>]|{DYNAMIC}")
    page = F.coalesce(base, F.lit("/"))
    joined = F.when(path == "", page).when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), path))
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s.isin("", "."), done).otherwise(F.concat(done, F.array(s)))
    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step)
    tail = F.when(joined.rlike(r"(?:^|/)\.{0,2}$") & (F.size(parts) > 0), "/").otherwise("")
    return F.when(~off, F.concat(F.lit("/"), F.array_join(parts, "/"), tail))


def table_name(value: Column) -> Column:
    """Normal form of a SQL identifier: no quotes or brackets, dots without spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, r"[\[\]`\"']", ""), r"\s*\.\s*", ".")))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("reads", "writes")]))
def sql_tables(statements: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    """Sorted tables that a statement of a kind (select, update, insert, delete, statement) reads and writes."""
    return pd.DataFrame([sql.lineage(s or "", k) for s, k in zip(statements, kinds, strict=True)], columns=["reads", "writes"])


def citations(text: Column) -> Column:
    """`path:line` references of a text."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z]+:[0-9]+)"), F.lit(1))


def line_count(text: Column) -> Column:
    """Line ends (CR, LF or CRLF) and one, so an empty text has one line; a null text has none."""
    return F.coalesce(F.when(text.isNotNull(), F.size(F.split(text, r"\r\n|\r|\n", -1))), F.lit(0))
