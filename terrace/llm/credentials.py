"""Secret scan with multipart credential linking.

Strong kinds (assignments, access keys, long hex runs) are reported wherever they
stand.  Weak kinds (login names, opaque tokens, endpoints) mean little alone; they
are reported only where complementary parts stand within one scope.  Parts are
joined as intervals: two parts complement each other when at most SCOPE code
points lie between them, found by an equi-join on scope cells and a check of the
gap.  Only DataFrame expressions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import apart, checkpoint, put_back, small_side, text_key

# Kind -> (pattern, group whose length counts, least length).
STRONG = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "login": (r"""(?i)(?:user|username|user_id|client_id|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    "opaque": (r"[A-Za-z0-9+/_-]{16,}={0,2}", 0, 16),
    "endpoint": (r"(?:https?|ftp|jdbc:[a-z]+|mongodb|redis|amqps?|postgres(?:ql)?|mysql)://[A-Za-z0-9_.:@/?&=%~-]+", 0, 10),
}
KINDS = [*STRONG, *WEAK]
#: Role of each kind in a credential of several parts.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "login": "id", "endpoint": "place"}
#: Roles that must both stand within a scope of a weak part of the role.
NEEDS = {"id": ["secret"], "secret": ["id"], "place": ["id", "secret"]}
#: Code points between two parts of one credential at most.
SCOPE = 160


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<kind, start, end>> of the matches, leftmost and non-overlapping, in code points; null without any."""
    between, whole, counted = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), None
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(between.alias("gap"), whole.alias("match"), counted.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        good = F.coalesce(F.length(p["value"]) >= least, F.lit(False))
        if kind == "opaque":  # letters and digits both
            good = good & F.coalesce(p["value"].rlike("[0-9]") & p["value"].rlike("[A-Za-z]"), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    quick = {"hex": pattern, "access": "AKIA[A-Z0-9]{16}"}.get(kind, pattern)
    return F.when(text.rlike(quick), F.aggregate(parts, start, step, lambda acc: acc["found"]))


def scan_parts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with strong and weak: arrays of (kind, start, end) of all matches, by kind and start."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = {k: F.coalesce(_found(F.col("__text"), k, *v), none) for k, v in (STRONG | WEAK).items()}
    both = F.struct(F.concat(*[found[k] for k in STRONG]).alias("strong"), F.concat(*[found[k] for k in WEAK]).alias("weak"))
    # the generator keeps filters on the spans above it, so each pattern runs once over a text
    return texts.withColumn("__text", value).select(*[F.col(f"`{c}`") for c in texts.columns], F.inline(F.array(both)))


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed; equal ones once."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def linked_weak_parts(parts: DataFrame) -> DataFrame:
    """(text_key, kind, start, end) of weak parts whose complementary roles stand within SCOPE.

    ``parts``: (text_key, kind, start, end), distinct.  A cell of SCOPE code points
    holds few parts, whatever the length of the text, so the join stays linear.
    """
    roles = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    parts = parts.withColumn("role", roles[F.col("kind")])
    weak = parts.filter(F.col("kind").isin(*WEAK)).select(
        "text_key", "kind", "start", "end", "role", F.explode(F.sequence(F.floor((F.greatest(F.col("start") - SCOPE, F.lit(0))) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))).alias("cell")
    )
    other = parts.select(
        "text_key", F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))).alias("cell"),
    )
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    near = weak.join(other, ["text_key", "cell"]).filter((F.col("role") != F.col("o_role")) & (gap <= SCOPE))
    have = near.groupBy("text_key", "kind", "start", "end", "role").agg(
        *[F.max((F.col("o_role") == r).cast("int")).alias(f"has_{r}") for r in ("id", "secret")]
    )
    complete = reduce(
        Column.__or__, [(F.col("role") == r) & reduce(Column.__and__, [F.col(f"has_{n}") == 1 for n in need]) for r, need in NEEDS.items()]
    )
    return have.filter(complete).select("text_key", "kind", "start", "end")


def find_credentials(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with base_spans and spans: arrays of (kind, start, end) in code points, end exclusive.

    ``base_spans`` has the strong kinds, ``spans`` those and the linked weak parts.
    Weak parts that overlap a strong one are left out.

    Defined cases: null and empty texts have no spans; equal texts get equal spans,
    linked once per distinct text; one text may hold any number of parts; an empty
    table gives an empty one; columns of these names that ``docs`` has are replaced.
    """
    # texts without a candidate for a link need no join: a weak part and another role
    scanned = scan_parts(apart(docs, ("text",))).withColumn(
        "__key", F.when((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1), text_key(F.coalesce("text", F.lit(""))))
    )
    parts = (
        scanned.filter(F.col("__key").isNotNull())
        .select(F.col("__key").alias("text_key"), F.explode(F.concat("strong", "weak")).alias("p"))
        .select("text_key", "p.kind", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"))
        .distinct()
    )
    linked = linked_weak_parts(checkpoint(parts))
    span = F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    links = linked.groupBy(F.col("text_key").alias("__link_key")).agg(F.collect_list(span).alias("__links"))
    # rows without a key meet none; a key of their own spreads them
    side = F.coalesce("__key", F.xxhash64(F.monotonically_increasing_id(), F.lit("none")))
    joined = scanned.withColumn("__key", side).join(small_side(links), F.col("__key") == F.col("__link_key"), "left")
    clear = F.filter(F.coalesce("__links", F.array().cast("array<struct<kind:string,start:int,end:int>>")), _clear_of_strong)
    result = joined.withColumns({"base_spans": _ordered(F.col("strong")), "spans": _ordered(F.concat("strong", clear))})
    return put_back(result, docs, ("base_spans", "spans"))


def _clear_of_strong(w: Column) -> Column:
    return ~F.exists("strong", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` and n_chars, where it exists, counted anew.

    Overlapping spans are replaced by one mark.  Columns and their order stay.
    """
    found = find_credentials(apart(docs, ("text", "n_chars")))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], before, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.when(
        F.size("spans") > 0, F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    ).otherwise(text)
    found = found.withColumn("__clean", clean)
    if "n_chars" in docs.columns:
        length = F.when(F.size("spans") > 0, F.length("__clean")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return put_back(found.withColumn("text", F.col("__clean")), docs)
