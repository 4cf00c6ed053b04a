"""Secret scan with multipart credential linking (op2), in built-in functions only.

Base kinds (assign, access, hex) are found by regular expressions; positions come from the lengths of
the pieces between matches. Weak parts (a bare secret, an endpoint) are reported only when the same text
has the parts that complete a credential, at any distance: identifiers, secrets and endpoints are joined
inside each row on its few candidates, so nothing is shuffled.

Null text is the empty text (redact() leaves it null); ties in start are sorted by kind; repeated rows get equal results; empty tables give empty tables; rows are kept one for one; extra columns
are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns. (?i:) holds for the letters of the key words alone.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"(?i:\b(?:access_?key_?id|client_?id|account|user(?:name)?|login))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_.=-])"
ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SPAN = "array<struct<s:int,k:int,e:int>>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of one kind: matches and the pieces between them, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(own, F.length).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc, p):
        s = acc["at"] + p["gap"]
        e = s + F.coalesce(p["hit"], F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(p["hit"].isNotNull() & (p["own"] >= least), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, F.aggregate(parts, start, add)["out"]).otherwise(F.array().cast(SPAN))


def overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """(docs with two more columns of spans sorted by start and kind, the name of the base ones, the name of all).

    Helper columns have a prefix that no column of docs begins with."""
    pre = "_"
    while any(c.lower().startswith(pre) for c in docs.columns):
        pre += "_"
    names = {"assign": (ASSIGN, 0, 2, 6), "access": (ACCESS, 1), "hex": (HEX, 2), "ident": (IDENT, 9), "bare": (BARE, 3), "end": (ENDPOINT, 4)}
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({pre + n: spans_of(t, *how) for n, how in names.items()})
    c = lambda *ns: F.concat(*[F.col(pre + n) for n in ns])
    df = df.withColumn(pre + "base", F.array_sort(c("assign", "access", "hex")))
    ids, keys = c("access", "ident"), c("assign", "hex", "bare")
    bare = F.filter(pre + "bare", lambda w: (F.size(ids) > 0) & ~F.exists(pre + "base", lambda b: overlap(w, b)))
    ends = F.filter(pre + "end", lambda w: (F.size(ids) > 0) & F.exists(keys, lambda k: ~overlap(w, k)))
    df = df.withColumn(pre + "spans", F.array_sort(F.concat(pre + "base", bare, ends)))
    return df.drop(*[pre + n for n in names]), pre + "base", pre + "spans"


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    df, base, spans = with_spans(docs.select("doc_id", "text"))
    of = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")  # noqa: E731  (a second parameter of the inner lambda would be the index)
    counts = [of(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return df.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by mask; all other columns stay, n_chars follows the text."""
    cols = docs.columns
    df, _, spans = with_spans(docs)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc, p):
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(p["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], p["e"]).alias("at"), F.when(p["s"] >= acc["at"], F.concat(acc["out"], F.array(piece, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    df = df.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text")))
    if "n_chars" in cols:
        df = df.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*cols)
