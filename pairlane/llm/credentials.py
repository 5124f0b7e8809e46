"""Secret scans with multipart credential linking.

Base patterns report by themselves.  Weak candidates (access identifiers,
secret-like strings, endpoints) say little alone: an interval join over the
candidates of a document keeps those only where complementary parts lie within
``SCOPE`` characters.  An identifier needs a secret, a secret an identifier or
an endpoint, an endpoint both.  Base spans serve as parts too.

Everything is built-in expressions and joins.  Spans are code points, end
exclusive; a null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import stored

SCOPE = 300

#: Base patterns, fixed values of the contract: kind, pattern, group whose
#: length counts, least length.  Matches that fall short are dropped.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same matches without the short ones, where that is the same thing (a run
#: is matched whole, so only its length decides); cheaper to look for.
LONG_ONLY = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

#: Weak candidates: kind, part, pattern.
WEAK = (
    ("weak_id", "id", r"(?:A3T[A-Z0-9]|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{12,}"
                      r"""|(?i:client_?id|access_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{4,}"""),
    ("weak_secret", "secret", r"[A-Za-z0-9+/]{40,}={0,2}"),
    ("endpoint", "endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+|jdbc:[a-z0-9]+:[^\x20\x09-\x0D"'<>]+"""),
)
PART_OF_BASE = {"assign": "secret", "access": "id", "hex": "secret"}
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
ORDER = {k: i for i, k in enumerate(KINDS)}

SPAN = "struct<start:int,kind:int,stop:int>"


def _found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of spans of the leftmost non-overlapping matches.  What lies
    between matches is what ``split`` returns, so places are running sums."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), size.alias("part"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(a, r):
        start = a["at"] + F.length(r["gap"])
        stop = start + F.coalesce(F.length(r["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(ORDER[kind]).alias("kind"), stop.alias("stop"))
        ok = F.coalesce(F.length(r["part"]) >= max(1, least), F.lit(False))
        return F.struct(stop.alias("at"), F.when(ok, F.concat(a["spans"], F.array(span)))
                        .otherwise(a["spans"]).alias("spans"))

    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pl_base`` and ``pl_weak``, arrays of spans."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = [_found(t, kind, LONG_ONLY.get(kind, pattern), 0 if kind in LONG_ONLY else group, least)
            for kind, pattern, group, least in BASE]
    weak = [_found(t, kind, pattern) for kind, _, pattern in WEAK]
    return docs.withColumns({"pl_base": F.sort_array(F.concat(*base)), "pl_weak": F.concat(*weak)})


def linked(rows: DataFrame) -> DataFrame:
    """(pl_row, pl_linked): the weak spans of each row that have their
    complements in scope.  Only rows with weak candidates take part.  A weak
    span lies in every bin that it covers, another span in every bin that it
    covers widened by the scope; two in scope share a bin, and meet in the first."""
    part = F.element_at(F.create_map(*[x for k, i in ORDER.items() for x in (
        F.lit(i), F.lit(PART_OF_BASE.get(k) or next(p for w, p, _ in WEAK if w == k)))]), F.col("s.kind"))
    spans = (rows.where(F.size("pl_weak") > 0)
             .select("pl_row", F.explode(F.concat("pl_base", "pl_weak")).alias("s"))
             .select("pl_row", "s.start", "s.stop", "s.kind", part.alias("part")))
    near = spans.select(
        F.col("pl_row").alias("r"), F.col("part").alias("p"), F.col("start").alias("b"), F.col("stop").alias("e"),
        F.floor((F.col("start") - SCOPE) / SCOPE).alias("first"), F.floor((F.col("stop") + SCOPE) / SCOPE).alias("last"))
    near = near.withColumn("bin", F.explode(F.sequence("first", "last")))
    weak = (spans.where(F.col("kind") >= len(BASE))
            .withColumn("own_first", F.floor(F.col("start") / SCOPE))
            .withColumn("own_bin", F.explode(F.sequence("own_first", F.floor(F.col("stop") / SCOPE)))))
    meets = weak.join(near, (F.col("pl_row") == F.col("r")) & (F.col("own_bin") == F.col("bin"))
                      & (F.col("bin") == F.greatest("first", "own_first"))
                      & (F.col("part") != F.col("p")) & (F.col("b") <= F.col("stop") + SCOPE)
                      & (F.col("start") <= F.col("e") + SCOPE)
                      # parts that overlap are readings of one string, no complement
                      & ((F.col("e") <= F.col("start")) | (F.col("stop") <= F.col("b"))))
    has = {p: F.max(F.when(F.col("p") == p, 1).otherwise(0)) for p in ("id", "secret", "endpoint")}
    kept = (meets.groupBy("pl_row", "start", "stop", "kind", "part")
            .agg(*[e.alias(f"has_{p}") for p, e in has.items()])
            .where("(part = 'id' AND has_secret = 1) OR (part = 'secret' AND (has_id = 1 OR has_endpoint = 1))"
                   " OR (part = 'endpoint' AND has_id = 1 AND has_secret = 1)"))
    return kept.groupBy("pl_row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("pl_linked"))


def scan(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with ``pl_base`` (sorted) and ``pl_spans`` (base and
    linked weak spans, sorted).  Repeated rows stay apart: each has its own
    number in the written table."""
    found = candidates(docs).withColumn("pl_row", F.monotonically_increasing_id())
    rows = stored(found if keep_text else found.drop("text"), "secrets")
    links = linked(rows.select("pl_row", "pl_base", "pl_weak"))
    both = F.concat("pl_base", F.coalesce("pl_linked", F.array().cast(f"array<{SPAN}>")))
    return (rows.join(links, "pl_row", "left").withColumn("pl_spans", F.sort_array(both))
            .drop("pl_row", "pl_weak", "pl_linked"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans of every row."""
    df = scan(docs.select("doc_id", "text"), keep_text=False)
    counts = [F.expr(f"cast(size(filter(pl_base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}")
              for i, (k, *_) in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(_listed(F.col("pl_base")), 256).alias("base_sha256"),
                     _listed(F.col("pl_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (overlapping spans
    by one); ``n_chars``, where it is a column, follows the new text."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("pl_doc"), "text")
    df = scan(packed.select("pl_doc", "text"))

    def step(a, s):
        gap = F.substring("text", a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"),
                        F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(gap)))
                        .otherwise(a["out"]).alias("out"))

    parts = F.aggregate("pl_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
                        lambda a: a)
    df = df.withColumn("pl_parts", F.when(F.size("pl_spans") > 0, parts))
    clean = F.when(F.col("pl_parts").isNull(), F.col("text")).otherwise(F.concat(
        F.array_join("pl_parts.out", mark), F.lit(mark), F.expr("substring(text, pl_parts.at + 1)")))
    df = df.withColumn("pl_clean", clean)
    out = []
    for c in own:
        col = F.col("pl_doc")[c]
        if c == "text":
            col = F.col("pl_clean")
        elif c == "n_chars":
            col = F.when(F.col("pl_parts").isNull(), col).otherwise(F.length("pl_clean").cast("long"))
        out.append(col.alias(c))
    return df.select(*out)
