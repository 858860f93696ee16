"""Secret scans: base patterns, and weak parts of a credential that count only where their counterparts are near.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import row_hash, whole_text
from flowlens.llm.components import apart
from flowlens.plans.small import cut_lineage

SCOPE = 256  # code points between the starts of two parts of one credential
BASE = ["assign", "access", "hex"]
WEAK = ["ident", "value", "endpoint"]
#: kind: (pattern, the group whose length counts, its least length, role in a credential). A hex run or an access
#: identifier that is too short fails from every later start of its run too, so its length can stand in the pattern.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "identity"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret"),
    "ident": (
        r"""(?i:client_?id|access_?key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3, "identity",
    ),
    "value": (r"""(?i:credential|private_?key|auth|pwd|pass|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, "secret"),
    "endpoint": (r"""(?i:[a-z]+)://([^\x20\x09-\x0D"'<>]+)""", 1, 4, "endpoint"),
}


def measured(kind: str) -> Column:
    """For each match of a kind its length, whether it is long enough, and the code points since the match before it."""
    pattern, group, least, _ = PATTERNS[kind]
    regex = F.lit(pattern)
    gaps = F.split("text", pattern, -1)
    matches = F.regexp_extract_all("text", regex, F.lit(0))
    long_enough = F.regexp_extract_all("text", regex, F.lit(group)) if group else matches
    cells = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"), long_enough.alias("part")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["match"]).alias("length"),
            (F.length(x["part"]) >= least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,length:int,ok:boolean>>")
    return F.when(F.col("text").rlike(pattern), cells).otherwise(none)


def parts(docs: DataFrame, text: str) -> DataFrame:
    """``(row, kind, role, start, end)``: every match that is long enough, once for rows equal in id and text."""
    source = docs.select(row_hash(text).alias("row"), whole_text(text).alias("text"))
    found = source.select("row", F.array(*[measured(k) for k in PATTERNS]).alias("kinds"))
    found = found.select("row", F.explode("kinds").alias("matches")).where(F.size("matches") > 0)
    each = found.select("row", F.posexplode("matches").alias("place", "m")).select("row", "place", "m.*").distinct()
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(upto).cast("int")
    role = F.create_map(*[F.lit(x) for k, p in PATTERNS.items() for x in (k, p[3])])
    placed = each.withColumn("end", end).where("ok")
    return placed.select("row", "kind", role[F.col("kind")].alias("role"), (F.col("end") - F.col("length")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """The weak parts of ``parts`` that touch no base span and have a counterpart in scope.

    Counterparts are an identity or an endpoint for a secret, and a secret for either. Starts within ``SCOPE`` of each other
    are in one scope. An interval join on cells of that length: the lowest and highest start of each role in a cell
    stand for all its parts, so that a cell of many parts gives no pairs; all starts of a cell are in scope of each
    other, in the cell before the highest start is the nearest, in the one after the lowest.
    """
    weak = F.col("kind").isin(WEAK)
    by_start = Window.partitionBy("row").orderBy("start")
    upto = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    touched = F.coalesce(F.max(F.when(~weak, F.col("end"))).over(upto) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(~weak, F.col("start"))).over(since) < F.col("end"), F.lit(False)
    )
    free = found.withColumn("touched", touched).where(~weak | ~F.col("touched")).drop("touched")
    celled = free.withColumn("cell", F.expr(f"start div {SCOPE}"))
    bounds = celled.groupBy("row", "cell", "role").agg(F.min("start").alias("lowest"), F.max("start").alias("highest"))
    bounds = bounds.select(apart("row").alias("r"), "cell", F.col("role").alias("other"), "lowest", "highest")
    asking = celled.where(weak).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    asking = asking.withColumn("near", F.col("cell") + F.col("side")).drop("cell")
    in_scope = (
        F.when(F.col("side") == 0, F.lit(True))
        .when(F.col("side") < 0, F.col("start") - F.col("highest") <= SCOPE)
        .otherwise(F.col("lowest") - F.col("start") <= SCOPE)
    )
    complementary = (F.col("role") == "secret") != (F.col("other") == "secret")
    hit = asking.join(bounds, (F.col("row") == F.col("r")) & (F.col("near") == F.col("cell")) & complementary & in_scope, "left_semi")
    return hit.select("row", "kind", "role", "start", "end").distinct()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, row, spans)`` of every row of ``docs``: ``spans`` is an array of (start, rank, end, kind), in that order.

    Base spans are always there; parts of the weak kinds only if they are linked. Null and empty texts have no span.
    Repeated rows get repeated results; an empty table gives an empty one; other columns are not read.
    """
    found = cut_lineage(parts(docs, text))
    kept = found.where(F.col("kind").isin(BASE)).unionByName(linked(found))
    rank = F.array_position(F.array(*[F.lit(k) for k in BASE + WEAK]), F.col("kind")).cast("int")
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    rows = docs.select("doc_id", row_hash(text).alias("row"))
    joined = rows.join(spans.select(apart("row").alias("r"), "spans"), F.col("row") == F.col("r"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return joined.select("doc_id", "row", F.coalesce("spans", none).alias("spans"))


def said(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
