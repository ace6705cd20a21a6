"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (assigned secrets, access key ids, long hex) are reported wherever they stand. Weak candidates are
parts of a credential: who (a login or client id), what (a long mixed token, or an assigned value too short to count
alone) and where (an endpoint). They say little alone, so they are reported only when complementary parts stand
within `reach` characters of each other in the same text: an identifier needs a secret nearby, a secret an identifier,
and an endpoint both. Strong spans count as parts too. Parts meet in an interval join on position buckets, whose
groups are bounded by the number of parts that fit into `reach` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored

# The strong patterns, the group that is measured, and the least length that counts.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}+", 0, 18),
    "hex": (r"[0-9a-f]{16,}+", 0, 16),
}
# The weak patterns. user and blob are parts only; short assigned values come from the first strong pattern.
WEAK = {
    "user": r"""(?i:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+""",
    "blob": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
    "endpoint": r"""(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}+""",
}
KINDS = [*STRONG, "user", "short", "blob", "endpoint"]
ROLE = {"assign": "what", "access": "who", "hex": "what", "user": "who", "short": "what", "blob": "what", "endpoint": "where"}
#: Hits whose positions are summed up at once.
CHUNK = 128
SPANS = "array<struct<start: int, kind: int, end: int, long: boolean>>"


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches, as code point spans; long tells whether the group has the least length.

    The texts between matches and the matches themselves, laid end to end, give every position. Running sums go by chunks
    of hits, then by chunks' totals, so that a text of very many hits does not copy all of them at each.
    """
    number = F.lit(KINDS.index(kind))
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.filter(F.arrays_zip(pieces.alias("gap"), found.alias("hit"), measured.alias("core")), lambda p: p["hit"].isNotNull())
    sized = F.transform(parts, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("hit"), (F.char_length(p["core"]) >= least).alias("long")))
    none = F.array().cast(SPANS)

    def step(st: Column, p: Column) -> Column:
        begin = st["at"] + p["gap"]
        end = begin + p["hit"]
        return F.struct(end.alias("at"), F.concat(st["spans"], F.array(F.struct(begin.alias("start"), number.alias("kind"), end.alias("end"), p["long"].alias("long")))).alias("spans"))

    def chunk(hits: Column, first: Column) -> Column:
        return F.aggregate(F.slice(hits, first, CHUNK), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def moved(st: Column, c: Column) -> Column:
        spans = F.transform(c["spans"], lambda s: F.struct((s["start"] + st["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + st["at"]).alias("end"), s["long"].alias("long")))
        return F.struct((st["at"] + c["at"]).alias("at"), F.concat(st["all"], F.array(spans)).alias("all"))

    def positions(hits: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(hits), F.lit(CHUNK)), lambda first: chunk(hits, first))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("all")), moved, lambda st: st["all"]))

    # One entry, so that the matches are found once however often they are named.
    return F.when(text.rlike(pattern), F.transform(F.array(sized), positions)[0]).otherwise(none)


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def find_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, proof (hash of the text), base spans and weak spans of every document. One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("proof", F.xxhash64("t"))
    for kind, (pattern, group, least) in STRONG.items():
        d = d.withColumn(kind, spans_of(F.col("t"), pattern, kind, group, least))
    d = d.withColumn("base", F.concat(F.filter("assign", lambda s: s["long"]), "access", "hex"))
    d = d.withColumn("short", F.transform(F.filter("assign", lambda s: ~s["long"]), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("short")).alias("kind"), s["end"].alias("end"), s["long"].alias("long"))))
    # A weak part needs a who and a what: what is missing settles most texts without another search.
    d = d.withColumn("user", spans_of(F.col("t"), WEAK["user"], "user"))
    who = (F.size("user") > 0) | (F.size("access") > 0)
    d = d.withColumn("blob", F.when(who, spans_of(F.col("t"), WEAK["blob"], "blob")).otherwise(F.array().cast(SPANS)))
    what = (F.size("blob") > 0) | (F.size("short") > 0) | F.exists("base", lambda s: s["kind"] != KINDS.index("access"))
    d = d.withColumn("endpoint", F.when(who & what, spans_of(F.col("t"), WEAK["endpoint"], "endpoint")).otherwise(F.array().cast(SPANS)))
    d = d.withColumn("weak", F.when(who & what, F.concat("user", "short", "blob", "endpoint")).otherwise(F.array().cast(SPANS)))
    return d.select("id", "proof", "base", "weak")


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """id, proof, links: the weak spans that have their complements within reach."""
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("s.kind") + 1)
    spans = parts.where("size(weak) > 0").select("id", "proof", F.explode(F.concat("base", "weak")).alias("s")).distinct().select("id", "proof", "s", role.alias("role"), (F.col("s.kind") >= len(STRONG)).alias("is_weak"))
    touched = F.sequence(F.floor(F.col("s.start") / reach), F.floor(F.col("s.end") / reach))
    # A blob that overlaps a base span or a short value is that span, seen again.
    is_blob = F.col("s.kind") == KINDS.index("blob")
    solid = spans.where(F.col("s.kind").isin(*range(len(STRONG)), KINDS.index("short"))).select(
        F.col("id").alias("id2"), F.col("proof").alias("proof2"), F.col("s").alias("s2"), F.explode(touched).alias("bucket2"))
    same_place = F.col("id").eqNullSafe(F.col("id2")) & (F.col("proof") == F.col("proof2")) & (F.col("bucket") == F.col("bucket2"))
    over = (F.col("s2.start") < F.col("s.end")) & (F.col("s.start") < F.col("s2.end"))
    again = spans.where(is_blob).withColumn("bucket", F.explode(touched)).join(solid, same_place & over, "left_semi").select(F.col("id").alias("id2"), F.col("proof").alias("proof2"), F.col("s").alias("s2"))
    spans = spans.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("proof") == F.col("proof2")) & (F.col("s") == F.col("s2")), "left_anti")
    # A span lies in all buckets that it touches, or one far longer than reach would miss what follows it.
    left = spans.where("is_weak").select("id", "proof", "s", "role", F.explode(touched).alias("bucket"))
    right = spans.where("role != 'where'").select(
        F.col("id").alias("id2"), F.col("proof").alias("proof2"), F.col("s").alias("s2"), F.col("role").alias("role2"),
        F.explode(F.sequence(F.floor(F.col("s.start") / reach) - 1, F.floor(F.col("s.end") / reach) + 1)).alias("bucket2"),
    )
    near = (F.col("s2.start") - F.col("s.end") <= reach) & (F.col("s.start") - F.col("s2.end") <= reach)
    met = left.join(right, same_place & (F.col("role") != F.col("role2")) & near)
    enough = F.when(F.col("role") == "where", F.size("roles") == 2).otherwise(F.lit(True))
    return met.groupBy("id", "proof", "s", "role").agg(F.collect_set("role2").alias("roles")).where(enough).groupBy("id", "proof").agg(F.collect_list("s").alias("links"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_spans, spans (all, weak ones included) and n_linked.

    Spans are text, kind:start:end by start, in code points, end exclusive. Null and empty texts have none. A null id is
    an id like any other. Repeated rows (same id, same text) each get the spans of their text. Very long texts are
    searched whole. An empty table gives an empty table. Only id_col and text_col are read, so other columns cannot clash.
    """
    parts = stored(find_parts(docs, id_col, text_col), "secret-parts")
    links = linked(parts, reach)
    p, l = parts.alias("p"), links.alias("l")
    found = p.join(l, F.col("p.id").eqNullSafe(F.col("l.id")) & (F.col("p.proof") == F.col("l.proof")), "left")
    count = lambda kind: F.size(F.filter(F.col("p.base"), lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("p.id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.coalesce(F.size("l.links"), F.lit(0)).cast("long").alias("n_linked"),
        as_text(F.col("p.base")).alias("base_spans"),
        as_text(F.concat(F.col("p.base"), F.coalesce(F.col("l.links"), F.array().cast(SPANS)))).alias("spans"),
    )
