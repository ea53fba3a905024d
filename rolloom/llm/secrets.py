"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong spans are reported always: ``assign`` (a password, secret, token or API key set to a
value of 6 or more characters), ``access`` (access identifiers) and ``hex`` (runs of 24 or
more hex digits). Weak candidates are ``ident`` (a user, login, client or key name set to a
value), ``opaque`` (32 or more letters and digits of mixed kinds) and ``endpoint`` (a URL
with a scheme, or a host with a port). A weak candidate is reported only if a
complementary part is within ``SCOPE`` characters of it: identifiers and endpoints need a
secret, opaque secrets need an identifier or an endpoint. Parts meet by an interval join
on blocks of the text.

A pattern's matches and the pieces between them give the positions as running sums of
lengths, in code points. Null texts are empty. Repeated rows give repeated results; a null
key is carried like any other value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions.jsonv import let
from rolloom.session import checkpointed

#: Characters between parts of one credential, and characters per block of the interval join.
SCOPE, BLOCK = 300, 512
#: The patterns of strong spans, in the order their kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least the wanted length; the same spans as longest runs filtered by length.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
IDENT = r"""((?i:user|username|login|client_?id|key_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})"""
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
#: A URL with a scheme, or a run of host characters with a port. No group is repeated: the JVM
#: matches those by recursion. A run is tried from its first character only and taken whole,
#: with what follows the port, so long runs cost linear time; which of them are endpoints is
#: told from the match.
_URL, _HOST = r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;%=-]{4,}", "[A-Za-z0-9.-]"
ENDPOINT = rf"(?:{_URL}|(?<!{_HOST}){_HOST}++:[0-9]{{2,}}{_HOST}*+)"
#: The same matches for engines that know neither lookbehind nor possessive repeats.
ENDPOINT_PLAIN = rf"(?:{_URL}|{_HOST}+:[0-9]{{2,}}{_HOST}*)"
IS_URL, IS_HOST = "://", r"[A-Za-z0-9-]\.[A-Za-z0-9-]+:[0-9]{2,5}$"
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
STRONG = 3
MASK = "[SECRET]"


def _matches(text: Column, kind: str, pattern: str, when: Column, group: int = 0, least: int = 0) -> Column:
    """Array of (kind, k, gap, length, ok) for the pattern's matches in the text."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else whole
    if kind == "opaque":
        ok = lambda p: p.rlike("[a-z]") & p.rlike("[A-Z]") & p.rlike("[0-9]")
    elif kind == "endpoint":
        ok = lambda p: p.contains(IS_URL) | p.rlike(IS_HOST)
    else:
        ok = lambda p: F.char_length(p) >= least
    # one pass over the arrays; the last gap, behind all matches, has none and goes
    zipped = F.zip_with(F.zip_with(whole, parts, lambda m, p: F.struct(F.char_length(m).alias("len"), ok(p).alias("ok"))), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("k"), x["g"].alias("gap"), x["m"]["len"].alias("len"), x["m"]["ok"].alias("ok")))
    found = F.filter(found, lambda x: x["len"].isNotNull())
    return F.when(when, found).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,len:int,ok:boolean>>"))


def _any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Strong spans and weak candidates: ``id``, ``h`` (hash of the text), ``kind`` (number), ``s``, ``e``."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("low", F.lower("t"))
    t, low = F.col("t"), F.col("low")
    strong = [
        _matches(t, "assign", ASSIGN, _any_of(low, ["passw", "secret", "token", "api"]), 2, 6),
        _matches(t, "access", ACCESS, F.contains(t, F.lit("AKIA"))),
        _matches(t, "hex", HEX, t.rlike(HEX)),
        _matches(t, "opaque", OPAQUE, t.rlike(OPAQUE)),
    ]
    found = rows.select("id", "h", "t", "low", F.concat(*strong).alias("found"))
    # identifiers and endpoints count only near a secret
    some = F.size("found") > 0
    weak = [
        _matches(t, "ident", IDENT, some & _any_of(low, ["user", "login", "client", "key", "account"])),
        _matches(t, "endpoint", ENDPOINT, some & F.contains(t, F.lit(":"))),
    ]
    spans = found.where(some).select("id", "h", F.inline(F.concat("found", *weak))).distinct()
    before = W.partitionBy("id", "h", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("bigint") + F.col("len")).over(before)
    return spans.withColumn("e", end).where("ok").select("id", "h", "kind", (F.col("e") - F.col("len")).alias("s"), "e")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """All reported spans: ``id``, ``h``, ``kind`` (number in ``KINDS``), ``s``, ``e``; once for repeated rows."""
    # few rows, used on both sides of the join and besides: found once
    parts = checkpointed(candidates(docs, key, text), "parts")
    role = F.when(F.col("kind").isin(0, 2, 4), "secret").when(F.col("kind").isin(1, 3), "identifier").otherwise("endpoint")
    parts = parts.withColumn("role", role)
    weak = parts.where(F.col("kind") >= STRONG)
    near = weak.withColumn("block", F.explode(F.sequence(F.floor((F.col("s") - scope) / BLOCK), F.floor((F.col("e") + scope) / BLOCK)))).alias("w")
    other = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / BLOCK), F.floor(F.col("e") / BLOCK)))).alias("p")
    meets = (
        F.col("w.id").eqNullSafe(F.col("p.id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.block") == F.col("p.block"))
        & (F.col("w.role") != F.col("p.role")) & ((F.col("w.role") == "secret") | (F.col("p.role") == "secret"))
        & (F.col("p.s") <= F.col("w.e") + scope) & (F.col("w.s") <= F.col("p.e") + scope)
    )
    linked = near.join(other, meets, "left_semi").select("id", "h", "kind", "s", "e").distinct()
    return parts.where(F.col("kind") < STRONG).select("id", "h", "kind", "s", "e").union(linked)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: the key, counts of strong spans, ``base_sha256`` of the strong spans and ``spans``, all reported ones."""
    one = F.struct("s", "kind", "e")
    per_doc = spans(docs, key, text, scope).groupBy("id", "h").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{KINDS[i]}") for i in range(STRONG)], F.array_sort(F.collect_list(one)).alias("all")
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("all", lambda x: x["kind"] < STRONG)
    per_doc = per_doc.select(F.col("id").alias("_id"), F.col("h").alias("_h"), *[f"n_{k}" for k in KINDS[:STRONG]], told(base).alias("base"), told(F.col("all")).alias("spans"))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS[:STRONG]]
    return joined.select(F.col("id").alias(key), *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _pieces(text: Column, begins: Column, ends: Column) -> Column:
    """Parts of a text between given characters, each taken from its blocks: the text is walked once."""

    def of(blocks: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK)
            own = F.slice(blocks, (first + 1).cast("int"), (F.floor(F.greatest(b - 1, a) / BLOCK) - first + 1).cast("int"))
            return F.substring(F.array_join(own, ""), (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))

        return F.zip_with(begins, ends, one)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), of)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every reported span replaced by ``MASK``; overlapping spans become one.

    ``n_chars`` names a column that holds the text's length; it follows the change.
    """
    own = W.partitionBy("id", "h").orderBy("s", "e")
    reach = F.max("e").over(own.rowsBetween(W.unboundedPreceding, -1))
    runs = spans(docs, key, text).withColumn("fresh", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "h", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cuts = runs.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_cuts")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "_cuts")
    # whole rows travel in one column, so that no column of theirs can clash
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), hashed.alias("h"), F.col(text).alias("t"))
    joined = packed.join(cuts, packed["id"].eqNullSafe(cuts["_id"]) & (packed["h"] == cuts["_h"]), "left")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cuts", lambda x: x["e"]))
    ends = F.concat(F.transform("_cuts", lambda x: x["s"]), F.array(F.char_length("t").cast("bigint")))
    clean = F.col("_cuts").isNull()
    out = joined.withColumn("new", F.when(clean, F.col("t")).otherwise(F.array_join(_pieces(F.col("t"), begins, ends), MASK)))
    columns = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text:
            own = F.col("new")
        elif c == n_chars:
            own = F.when(clean, own).otherwise(F.char_length("new").cast(docs.schema[c].dataType))
        columns.append(own.alias(c))
    return out.select(*columns)
