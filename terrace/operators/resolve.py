"""Entity resolution: our team names to candidate clubs inside a block.

Tiers: hand map, known-absent, exact, unique containment, strict similarity.
Nothing is paired with everything: containment looks the shorter name up by its rarest
run of characters; similarity candidates share a whole segment of the candidate's name at
nearly the same place or, where names are long or a segment is common, one of their rarest
trigrams, which any pair at 0.90 or above does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions.text import fold_ascii, grams, name_similarity, normalize_name, trigrams
from terrace.scale import checkpoint, hot_keys

SIMILARITY_FLOOR = 0.90
#: Widths of the runs by which a contained name is looked up.
ANCHORS = (1, 2, 3, 6, 12)
#: Longest candidate name that is cut into segments; longer ones are found by trigrams alone.
SEGMENT_LENGTH = 24
#: Candidates that may hold one segment; those of commoner segments must share a rare trigram too.
SEGMENT_HELD = 32
_SEGMENT = ["block", "b", "most", "i", "segment"]


def _names(teams: DataFrame, drop_tokens: str) -> DataFrame:
    return teams.select("block", "team").distinct().withColumn("n", normalize_name(F.col("team"), drop_tokens))


def _clubs(candidates: DataFrame, drop_tokens: str) -> DataFrame:
    return candidates.select("block", "cid", "name").distinct().withColumn("nn", normalize_name(F.col("name"), drop_tokens))


def manual_hits(names: DataFrame, clubs: DataFrame, manual: DataFrame) -> DataFrame:
    """(block, team, manual_cid): mapped names; the id is null when the target is not in the block.

    ``manual`` is (team, target), or (block, team, target) when names repeat across blocks.
    """
    mapped = names.join(manual, ["block", "team"] if "block" in manual.columns else ["team"])
    target = clubs.groupBy("block", F.col("name").alias("target")).agg(F.min("cid").alias("manual_cid"))
    return mapped.join(target, ["block", "target"], "left").select("block", "team", "manual_cid")


def absent_names(names: DataFrame, absent: DataFrame) -> DataFrame:
    return names.join(absent, "team", "left_semi")


def exact_hits(names: DataFrame, clubs: DataFrame) -> DataFrame:
    """Normalised names that equal exactly one candidate of the block."""
    keyed = clubs.groupBy("block", F.col("nn").alias("n")).agg(F.count("*").alias("c"), F.min("cid").alias("cid"))
    return names.join(keyed.filter("c = 1"), ["block", "n"]).select("block", "team", "cid")


def _anchored(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """(block, short, long): the longs that contain a short, for distinct (block, short) and (block, long).

    A short is looked up by one run of characters only: of its runs of the widest of
    ANCHORS that it can have, the one that fewest longs hold.  A long has a key for each
    place and width, so keys grow with the length of a name, not with its square.
    """
    widest = F.lit(ANCHORS[0])
    for w in ANCHORS[1:]:
        widest = F.when(F.length("short") >= w, w).otherwise(widest)
    keys = longs.select("block", "long", F.explode(grams(F.col("long"), ANCHORS)).alias("g"))
    held = keys.groupBy("block", "g").agg(F.count("*").alias("held"))
    runs = F.transform(F.sequence(F.lit(1), F.length("short") - F.col("w") + 1), lambda i: F.substring("short", i, F.col("w")))
    tried = shorts.filter("short <> ''").withColumn("w", widest).select("block", "short", F.explode(F.array_distinct(runs)).alias("g"))
    # a run that no long holds rules the short out
    counted = tried.join(held, ["block", "g"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    anchors = counted.groupBy("block", "short").agg(F.min(F.struct("held", "g")).alias("a")).filter("a.held > 0").select("block", "short", "a.g")
    return anchors.join(keys, ["block", "g"]).filter(F.col("long").contains(F.col("short"))).select("block", "short", "long")


def containment_hits(names: DataFrame, clubs: DataFrame) -> DataFrame:
    """Names where exactly one candidate contains the name or is contained in it."""
    names = names.filter(F.col("n") != "")
    per_name = clubs.filter(F.col("nn") != "").groupBy("block", "nn").agg(F.count("*").alias("c"), F.min("cid").alias("cid"))
    own = names.select("block", "n").distinct()
    known = per_name.select("block", "nn")
    around = _anchored(own.withColumnRenamed("n", "short"), known.withColumnRenamed("nn", "long")).toDF("block", "n", "nn")
    within = _anchored(known.withColumnRenamed("nn", "short"), own.withColumnRenamed("n", "long")).toDF("block", "nn", "n").filter("nn <> n")
    total = around.unionByName(within).join(per_name, ["block", "nn"]).groupBy("block", "n").agg(F.sum("c").alias("c"), F.min("cid").alias("cid"))
    return names.join(total.filter("c = 1"), ["block", "n"]).select("block", "team", "cid")


def _rare_grams(strings: DataFrame, held: DataFrame, floor: float) -> DataFrame:
    """(block, s, g): the rarest trigrams of each string, as many as a partner of ``floor`` or more can lack, and one more.

    With lengths a and b, at most (1 - floor) * (a + b) characters of the two are outside the matched blocks and
    b <= a * (2 / floor - 1).  A character outside destroys three trigrams at most, so the
    rarest trigram that both have is among these of either one.
    """
    each = strings.select("block", "s", F.explode(trigrams(F.col("s"))).alias("g")).join(held, ["block", "g"], "left")
    ranked = each.groupBy("block", "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "g"))).alias("gs"))
    lacked = 3 * F.floor(F.length("s") * (2.0 * (1.0 - floor) / floor) + 1e-9).cast("int")
    return ranked.select("block", "s", F.explode(F.slice("gs", F.lit(1), lacked + 1)).alias("x")).select("block", "s", "x.g")


def _outside(a: Column, b: Column, floor: float) -> Column:
    """Most characters of two strings of these lengths outside their matched blocks at ``floor``; as odd or even as a + b."""
    most = F.floor((1.0 - floor) * (a + b) + 1e-9).cast("int")
    return most - F.pmod(most - (a + b), F.lit(2))


def _partner_lengths(n: Column, floor: float, top: int | None = None) -> Column:
    """All lengths of strings that a string of length ``n`` can be similar to, and a few more."""
    hi = F.ceil(n * (2.0 / floor - 1.0)).cast("int")
    lo = F.greatest(F.floor(n / (2.0 / floor - 1.0)).cast("int"), F.lit(1))
    return F.sequence(lo, hi) if top is None else F.filter(F.sequence(lo, hi), lambda b: b <= top)


def _cut(df: DataFrame, text: str, shift: Column) -> DataFrame:
    """``segment``: the i-th of ``most`` + 1 nearly equal parts of a string of length b, as ``text`` has it moved by ``shift``."""
    part = lambda i: F.floor(i * F.col("b") / (F.col("most") + 1)).cast("int")
    df = df.withColumns({"_p": part(F.col("i")) + shift, "_n": part(F.col("i") + 1) - part(F.col("i"))})
    return df.filter((F.col("_p") >= 0) & (F.col("_p") + F.col("_n") <= F.length(text))).withColumn("segment", F.substring(text, F.col("_p") + 1, F.col("_n")))


def _similar_candidates(own: DataFrame, per_name: DataFrame, floor: float) -> DataFrame:
    """(block, n, nn): every pair at ``floor`` or above and few others.

    Similar strings differ by at most ``most`` single characters that only one of them has.  Of
    ``most`` + 1 parts of the candidate's name one is left whole, with as many such characters
    before it as it has parts before it, so the name holds that part at one of few places.
    """
    held = per_name.select("block", F.explode(trigrams(F.col("s"))).alias("g")).groupBy("block", "g").agg(F.count("*").alias("held"))
    a = _rare_grams(own, held, floor).withColumnRenamed("s", "n")
    b = _rare_grams(per_name, held, floor).withColumnRenamed("s", "nn")
    lb = F.length("nn")
    pairs = [a.filter(F.length("n") >= int(SEGMENT_LENGTH / (2.0 / floor - 1.0))).join(b.filter(lb > SEGMENT_LENGTH), ["block", "g"]).select("block", "n", "nn")]

    short = per_name.filter(F.length("s") <= SEGMENT_LENGTH).select("block", F.col("s").alias("nn"), F.length("s").alias("b"))
    fits = lambda a, b: F.when(_outside(a, b, floor) >= F.abs(a - b), _outside(a, b, floor))
    mosts = F.array_distinct(F.transform(_partner_lengths(F.col("b"), floor), lambda a: fits(a, F.col("b"))))
    cut = short.withColumn("most", F.explode(F.filter(mosts, lambda m: m.isNotNull()))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    cut = _cut(cut, "nn", F.lit(0)).select(*_SEGMENT, "nn")

    asked = own.select("block", F.col("s").alias("n"), F.length("s").alias("a")).withColumn("b", F.explode(_partner_lengths(F.col("a"), floor, SEGMENT_LENGTH)))
    asked = asked.withColumn("most", fits(F.col("a"), F.col("b"))).filter("most is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    asked = asked.withColumn("moved", F.explode(F.sequence(-F.col("i"), F.col("i"), F.lit(2)))).filter("abs(a - b - moved) <= most - i")
    asked = _cut(asked, "n", F.col("moved")).select(*_SEGMENT, "n").distinct()

    common = hot_keys(cut, _SEGMENT, SEGMENT_HELD)
    rare = cut
    if common is not None:
        rare = cut.join(common, _SEGMENT, "left_anti")
        left = asked.join(common, _SEGMENT, "left_semi").join(a, ["block", "n"])
        right = cut.join(common, _SEGMENT, "left_semi").join(b, ["block", "nn"])
        pairs.append(left.join(right, [*_SEGMENT, "g"]).select("block", "n", "nn"))
    pairs.append(asked.join(rare, _SEGMENT).select("block", "n", "nn"))
    la, most = F.length("n"), _outside(F.length("n"), lb, floor)
    close = (most >= F.abs(la - lb)) & (F.call_function("levenshtein", "n", "nn", F.greatest(most, F.lit(0))) >= 0)
    out = [p.filter(close) for p in pairs]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0].distinct()


def similarity_hits(names: DataFrame, clubs: DataFrame, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Best candidate at or above ``floor``; ties go to the smallest id.

    Candidates come from ``_similar_candidates``, which loses no pair at the floor; only they are scored.
    """
    own = checkpoint(names.filter(F.col("n") != "").select("block", F.col("n").alias("s")).distinct())
    per_name = checkpoint(clubs.filter(F.col("nn") != "").groupBy("block", F.col("nn").alias("s")).agg(F.min("cid").alias("cid")))
    scored = _similar_candidates(own, per_name, floor).withColumn("score", name_similarity("n", "nn")).filter(F.col("score") >= floor)
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("cid")))
    best = scored.join(per_name.withColumnRenamed("s", "nn"), ["block", "nn"]).groupBy("block", "n").agg(first.alias("b"))
    return names.join(best, ["block", "n"]).select("block", "team", F.col("b.cid").alias("cid"), (-F.col("b.s")).alias("score"))


def resolve_names(
    teams: DataFrame,
    candidates: DataFrame,
    manual: DataFrame | None = None,
    absent: DataFrame | None = None,
    drop_tokens: str = V.CLUB_DROP_TOKENS,
    similarity: bool = True,
    manual_falls_through: bool = False,
) -> DataFrame:
    """(block, team, cid, tier) for every team; unresolved names keep a null id.

    ``teams`` is (block, team), ``candidates`` (block, cid, name), ``manual``
    (team, target), ``absent`` (team).  Each tier only sees what the earlier tiers
    left over.
    """
    names, clubs = _names(teams, drop_tokens), checkpoint(_clubs(candidates, drop_tokens))
    key = ["block", "team"]
    nothing = F.lit(None).cast(clubs.schema["cid"].dataType)
    base = names
    if manual is not None:
        base = base.join(manual_hits(names, clubs, manual).withColumn("_m", F.lit(True)), key, "left")
    else:
        base = base.withColumns({"manual_cid": nothing, "_m": F.lit(None).cast("boolean")})
    if absent is not None:
        base = base.join(absent.select("team", F.lit(True).alias("_gone")).distinct(), "team", "left")
    else:
        base = base.withColumn("_gone", F.lit(None).cast("boolean"))
    base = base.join(exact_hits(names, clubs).withColumnRenamed("cid", "_x"), key, "left")
    by_hand = F.col("manual_cid").isNotNull() if manual_falls_through else F.col("_m").isNotNull()
    tier = F.when(by_hand, "manual").when(F.col("_gone"), "absent").when(F.col("_x").isNotNull(), "exact")
    cid = F.when(by_hand, F.col("manual_cid")).when(F.col("_gone"), nothing).otherwise(F.col("_x"))
    out = checkpoint(base.select("block", "team", "n", cid.alias("cid"), tier.alias("tier")))

    tiers = [("contains", containment_hits)] + ([("similar", similarity_hits)] if similarity else [])
    for label, find in tiers:
        hits = find(out.filter(F.col("tier").isNull()).select("block", "team", "n"), clubs)
        found = hits.select("block", "team", F.col("cid").alias("_c"))
        out = out.join(found, key, "left")
        out = out.withColumns({"tier": F.coalesce("tier", F.when(F.col("_c").isNotNull(), label)), "cid": F.coalesce("cid", "_c")})
        out = checkpoint(out.drop("_c"))
    return out.select("block", "team", "cid", F.coalesce("tier", F.lit("none")).alias("tier"))


def coverage(teams: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per league: teams, mapped, mismatch (pool exists, no match) and structural (no pool)."""
    joined = teams.join(resolved.select("block", "team", "cid"), ["block", "team"], "left")
    has_pool = F.col("block").isNotNull()
    return joined.groupBy("league").agg(
        F.count("*").alias("teams"),
        F.count("cid").alias("mapped"),
        F.count(F.when(has_pool & F.col("cid").isNull(), 1)).alias("mismatch"),
        F.count(F.when(~has_pool, 1)).alias("structural"),
    )


def latest_covered_league(team_rows: DataFrame, covered: list[str]) -> DataFrame:
    """Last covered league of each team, else its last league."""
    at = F.struct("match_date", "match_seq")
    return team_rows.groupBy("team").agg(
        F.coalesce(
            F.max_by("competition", F.when(F.col("competition").isin(*covered), at)), F.max_by("competition", at)
        ).alias("league")
    )


def alias_lookup(external: DataFrame, known: DataFrame, aliases: DataFrame, name_cols: list[str]) -> DataFrame:
    """Resolve external names to known keys: exact, else alias of the folded name; try each name column in turn.

    ``known`` is (team), ``aliases`` (alias, target).
    """
    live = aliases.join(known.withColumnRenamed("team", "target"), "target", "left_semi")
    out = external
    tried = []
    for i, c in enumerate(name_cols):
        exact = known.select(F.col("team").alias(c), F.col("team").alias(f"_e{i}"))
        alias = live.select(F.col("alias").alias(f"_f{i}"), F.col("target").alias(f"_a{i}"))
        out = out.join(exact, c, "left").withColumn(f"_f{i}", F.lower(F.trim(fold_ascii(F.col(c))))).join(alias, f"_f{i}", "left")
        tried.append(F.coalesce(f"_e{i}", f"_a{i}"))
    extra = [f"_{k}{i}" for i in range(len(name_cols)) for k in "efa"]
    return out.withColumn("team", F.coalesce(*tried)).drop(*extra)


def club_mapping(teams: DataFrame, clubs: DataFrame, similarity: bool = True) -> DataFrame:
    """(team, league, cid, tier) of our teams against the value source's clubs.

    ``teams`` is (team, league), ``clubs`` (club_id, name, domestic_competition_id).
    Candidates come from the league's own competition; the hand tables apply.
    """
    from terrace import name_maps

    spark = teams.sparkSession
    comps = V.literal_table(spark, list(V.LEAGUE_VALUE_COMP.items()), ["league", "block"])
    keyed = teams.join(comps, "league")
    pool = clubs.select(F.col("domestic_competition_id").alias("block"), F.col("club_id").alias("cid"), "name")
    hits = resolve_names(keyed, pool, name_maps.manual_clubs(spark), name_maps.absent_clubs(spark), similarity=similarity)
    return keyed.join(hits, ["block", "team"]).select("team", "league", "cid", "tier")


def rating_mapping(teams: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(team, league, country, norm_name) against the rating source's clubs of the country.

    ``snapshots`` is (country, norm_name, ...).  A hand-mapped name that is missing
    falls through to the exact and containment tiers.
    """
    from terrace import name_maps

    spark = teams.sparkSession
    countries = V.literal_table(spark, list(V.LEAGUE_RATING_COUNTRY.items()), ["league", "block"])
    keyed = teams.join(countries, "league")
    pool = snapshots.select(F.col("country").alias("block"), F.col("norm_name").alias("cid"), F.col("norm_name").alias("name")).distinct()
    by_hand = name_maps.manual_ratings(spark).withColumn("target", normalize_name(F.col("target"), V.RATING_DROP_TOKENS))
    hits = resolve_names(keyed, pool, by_hand, None, V.RATING_DROP_TOKENS, similarity=False, manual_falls_through=True)
    return keyed.join(hits, ["block", "team"]).select("team", "league", F.col("block").alias("country"), F.col("cid").alias("norm_name"))
