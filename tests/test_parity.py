"""Rules that are easy to get wrong, on tiny literal frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrace.functions import dates, goals, text
from terrace.operators import blocks, components, feeds, match_rows, metrics, ratings, resolve, scenario, squad_values, team_state, windows

STATS = [f"{s}_{n}" for s in ("home", "away") for n in ("shots", "shots_on_target", "corners", "fouls", "yellow", "red")]


def table(spark, rows):
    """rows: (id, date, home, away, hs, as)"""
    df = spark.createDataFrame(
        [(i, i, date.fromisoformat(d), "PL", h, a, hs, aws) for i, d, h, a, hs, aws in rows],
        "match_id long, match_seq long, match_date date, competition string, home_team string, away_team string, home_score int, away_score int",
    )
    df = match_rows.with_outcome(df)
    return df.withColumns({c: F.lit(None).cast("int") for c in STATS})


def test_streak_sign_and_reset(spark):
    m = table(
        spark,
        [(1, "2020-01-01", "A", "B", 1, 0), (2, "2020-01-08", "A", "C", 2, 0), (3, "2020-01-15", "A", "B", 1, 1), (4, "2020-01-22", "A", "C", 0, 1), (5, "2020-01-29", "A", "B", 0, 0)],
    )
    w = windows.team_windows(match_rows.team_rows(m)).filter("team = 'A'").orderBy("match_id")
    assert [r.streak for r in w.collect()] == [0, 1, 2, -1, 0]


def test_ewma_weights_the_oldest_match_most(spark):
    m = table(spark, [(1, "2020-01-01", "A", "B", 3, 0), (2, "2020-01-08", "A", "B", 0, 0), (3, "2020-01-15", "A", "B", 0, 0)])
    last = windows.team_windows(match_rows.team_rows(m)).filter("team = 'A' and match_id = 3").first()
    assert last.ewma_gs == pytest.approx(3 / 1.3)


def test_drawn_high_scoring_match_is_not_over_25(spark):
    m = table(spark, [(1, "2020-01-01", "A", "B", 2, 2), (2, "2020-01-08", "A", "B", 3, 0), (3, "2020-01-15", "A", "B", 0, 0)])
    last = windows.team_windows(match_rows.team_rows(m)).filter("team = 'A' and match_id = 3").first()
    assert last.o25_rate_5 == pytest.approx(0.5)


def test_baseline_switches_at_200_prior_matches(spark):
    m = table(spark, [(i, "2020-01-%02d" % (1 + i // 10), f"H{i}", f"A{i}", 2, 0) for i in range(202)])
    got = {r.match_id: r for r in windows.league_baseline(m).collect()}
    assert (got[199].league_base_home_goals, got[199].league_base_away_goals) == (1.45, 1.20)
    assert (got[200].league_base_home_goals, got[200].league_base_away_goals) == (2.0, 0.0)


def test_elo_gap_pull_and_margin(spark):
    m = table(spark, [(1, "2020-01-01", "A", "B", 3, 0), (2, "2020-03-01", "A", "B", 0, 0)])
    r = {x.match_id: x for x in ratings.rate_matches(m).collect()}
    expect = 1.0 / (1.0 + 10 ** (-65 / 400))
    post = 1500 + 40 * (14 / 8) * (1 - expect)
    assert r[1].home_elo_post == pytest.approx(post)
    assert r[2].home_elo == pytest.approx(1500 + (post - 1500) * 0.9)
    assert r[2].home_sos == pytest.approx(3000 - post)  # opponents before the pull


def test_components_stay_apart(spark):
    m = table(spark, [(1, "2020-01-01", "A", "B", 1, 0), (2, "2020-01-02", "B", "C", 1, 0), (3, "2020-01-03", "X", "Y", 1, 0)])
    got = {r.team: r.component for r in components.team_components(m).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}


def test_components_of_a_long_chain(spark):
    m = table(spark, [(i, "2020-01-01", f"t{i:03d}", f"t{i + 1:03d}", 1, 0) for i in range(60)])
    assert {r.component for r in components.team_components(m).collect()} == {"t000"}


def test_probabilities_sum_to_one_and_native_equals_grid(spark):
    df = spark.createDataFrame([(1, 0.4, 3.9), (2, 1.45, 1.2), (3, 9.0, 8.5)], "match_id long, exp_home double, exp_away double")
    ph, pd_, pa = goals.outcome_probabilities(F.col("exp_home"), F.col("exp_away"))
    native = {r.match_id: r for r in df.select("match_id", ph.alias("h"), pd_.alias("d"), pa.alias("a")).collect()}
    grid = scenario.grid_rows(df).groupBy("match_id").agg(
        F.sum(F.when(F.col("i") > F.col("j"), F.col("p")).otherwise(0)).alias("h"), F.sum("p").alias("all")
    )
    for r in grid.collect():
        n = native[r.match_id]
        assert r.all == pytest.approx(1) and n.h + n.d + n.a == pytest.approx(1)
        assert n.h == pytest.approx(r.h)


def test_state_takes_newest_row_with_venue_history(spark):
    """The newest match is the team's first away match, so the home match before it is captured."""
    m = table(spark, [(1, "2020-01-01", "A", "B", 1, 0), (2, "2020-01-08", "A", "C", 1, 0), (3, "2020-01-15", "B", "A", 2, 2)])
    long = windows.venue_windows(windows.team_windows(match_rows.team_rows(m)))
    ref = team_state.team_state(long).filter("team = 'A'").first()
    latest = team_state.team_state(long, mode="latest").filter("team = 'A'").first()
    assert (ref.ppf_10, latest.ppf_10) == (3.0, 3.0) and ref.matches_played == 1 and latest.matches_played == 0
    assert ref.away_matches_played == 0 and ref.home_matches_played == 1


def test_dates(spark):
    texts = ["15/08/25", "5/8/1997", "2020-02-29", "Fri Aug 11 2023", "31/31/2020", "", "01/01/97"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(dates.parse_match_date(F.col("t")).alias("d")).collect()]
    assert got == [date(2025, 8, 15), date(1997, 8, 5), date(2020, 2, 29), date(2023, 8, 11), None, None, date(1997, 1, 1)]


def test_normalize_equals_unicode_folding(spark):
    import re
    import unicodedata

    from terrace.fixed_values import CLUB_DROP_TOKENS

    names = ["Atlético de Madrid", "1.FC Nürnberg", "ﬁne & Co", "Łódź", "Spółka-Akcyjna", "Ďáblice SK", "½ Town", "São Paulo FC", "Ǆungla", ""]

    def want(n):
        s = unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()
        s = s.replace("&", " and ").replace("-", " ").replace(".", " ")
        return re.sub(r"[^a-z0-9]", "", re.sub(CLUB_DROP_TOKENS, " ", s))

    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.x for r in df.select(text.normalize_name(F.col("n")).alias("x")).collect()]
    assert got == [want(n) for n in names]


def test_similarity_and_containment_equal_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    teams = []
    for b in base:
        edits = [b, b[:-1] + "z", b + "x", b[:5], b[1:], "q" + b[2:] + "q"]
        teams.append(rng.choice(edits))
    t = spark.createDataFrame([("B", n) for n in sorted(set(teams))], "block string, team string")
    c = spark.createDataFrame([("B", i, n) for i, n in enumerate(base)], "block string, cid long, name string")
    names, clubs = resolve._names(t, r"\b(zzzz)\b"), resolve._clubs(c, r"\b(zzzz)\b")
    near = {r.team: r.cid for r in resolve.similarity_hits(names, clubs).collect()}
    held = {r.team: r.cid for r in resolve.containment_hits(names, clubs).collect()}
    want_near, want_held = {}, {}
    for n in set(teams):
        best, score = None, 0.0
        for i, b in enumerate(base):
            s = SequenceMatcher(None, n, b).ratio()
            if s > score:
                best, score = i, s
        if score >= 0.90:
            want_near[n] = best
        inside = [i for i, b in enumerate(base) if n in b or b in n]
        if len(inside) == 1:
            want_held[n] = inside[0]
    assert near == want_near and held == want_held


def test_manual_target_missing_means_no_match(spark):
    t = spark.createDataFrame([("B", "Alpha"), ("B", "Gone")], "block string, team string")
    c = spark.createDataFrame([("B", 1, "Alpha"), ("B", 2, "Gone")], "block string, cid long, name string")
    manual = spark.createDataFrame([("Alpha", "Nobody")], "team string, target string")
    absent = spark.createDataFrame([("Gone",)], "team string")
    got = {r.team: (r.cid, r.tier) for r in resolve.resolve_names(t, c, manual, absent).collect()}
    assert got == {"Alpha": (None, "manual"), "Gone": (None, "absent")}
    through = {r.team: (r.cid, r.tier) for r in resolve.resolve_names(t, c, manual, None, manual_falls_through=True).collect()}
    assert through["Alpha"] == (1, "exact")


def test_emptied_club_records_zero(spark):
    v = spark.createDataFrame(
        [(date(2020, 1, 10), "p", 5, "X", 1), (date(2020, 3, 5), "p", 7, "Y", 2)], "valued_on date, player_id string, value_eur int, club_id string, seq long"
    ).withColumn("value_eur", F.col("value_eur").cast("decimal(18,2)"))
    got = {(r.club_id, r.month): r.value_eur for r in squad_values.month_snapshots(v).collect()}
    assert got == {("X", "2020-02"): 5.0, ("X", "2020-04"): 0.0, ("Y", "2020-04"): 7.0}


def test_gated_blocks_need_both_sides(spark):
    df = spark.createDataFrame([(None, 5e6), (0.0, 5e6), (4e6, 5e6)], "h double, a double")
    got = df.select(*[c.alias(n) for n, c in blocks.squad_block(F.col("h"), F.col("a")).items()]).collect()
    assert [r.has_squad_value for r in got] == [0.0, 0.0, 1.0] and got[0].away_squad_value == 0.0


def test_rps_is_ordinal_and_ties_pick_the_lowest_class(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (-1, 0.0, 0.0, 1.0), (0, 0.0, 0.0, 1.0), (0, 1 / 3, 1 / 3, 1 / 3)], "y int, p_away double, p_draw double, p_home double")
    got = df.select(metrics.rps(F.col("y")).alias("r"), metrics.argmax_class().alias("c"), metrics.pick_label().alias("p")).collect()
    assert got[0].r == 0 and got[1].r > got[2].r
    assert got[3].c == -1 and got[3].p == "Home Win"


def test_reliability_edge_sits_below_the_float_edge(spark):
    df = spark.createDataFrame([(1, 0.3, 0.35, 0.35), (1, 0.1, 0.1, 0.8), (1, 0.0, 0.0, 1.0)], "y int, p_away double, p_draw double, p_home double")
    bins = {r.bin_low for r in metrics.reliability(df, F.col("y")).collect()}
    assert bins == {0.3, 0.8, 0.9}


def test_simulated_tables_keep_their_invariants(spark):
    from itertools import permutations

    teams = ["a", "b", "c", "d"]
    f = spark.createDataFrame(
        [(i, "L", h, a, 0.5, 0.25, 0.25, 1.5, 1.1) for i, (h, a) in enumerate(permutations(teams, 2))],
        "match_id long, lg string, home_team string, away_team string, p_home double, p_draw double, p_away double, exp_home double, exp_away double",
    )
    ex = scenario.expand(f, ["lg"], 300, block=64)
    assert ex.count() == 300 * 12 and ex.select("sim").distinct().count() == 300
    pos = scenario.ranked(scenario.simulated_tables(ex, ["lg"]), ["lg"])
    assert pos.filter("position = 1").count() == 300
    assert pos.agg(F.sum("gd")).first()[0] == 0
    share = ex.agg(F.avg(F.when(F.col("outcome") == 1, 1.0).otherwise(0.0))).first()[0]
    assert abs(share - 0.5) < 0.03
    same = scenario.expand(f, ["lg"], 300, block=1000)
    assert ex.select("match_id", "sim", "outcome", "hg", "ag").exceptAll(same.select("match_id", "sim", "outcome", "hg", "ag")).isEmpty()
    salted = scenario.simulated_tables(scenario.expand(f, ["lg"], 300, max_rows=1), ["lg"])
    assert salted.exceptAll(scenario.simulated_tables(same, ["lg"])).isEmpty()
    exact = {r.team: r.expected_points for r in scenario.expected_points(f, ["lg"]).collect()}
    mean = {r.team: r.expected_points for r in scenario.summary(pos, ["lg"]).collect()}
    assert all(abs(exact[t] - mean[t]) < 0.6 for t in teams)


def test_rejected_rows_are_counted(spark):
    raw = spark.range(10)
    r = feeds.rejected_count(raw, raw.filter("id < 7")).first()
    assert (r.read, r.kept, r.rejected) == (10, 7, 3)


def test_look_alike_clubs_stay_apart(spark):
    teams = spark.createDataFrame(
        [("Ath Madrid", "PD"), ("Real Madrid", "PD"), ("Verona", "SA"), ("Atletico-MG", "BSA"), ("Nowhere", "PL"), ("Odd", "ZZ")], "team string, league string"
    )
    clubs = spark.createDataFrame(
        [
            ("1", "Atlético de Madrid", "ES1"), ("2", "Real Madrid CF", "ES1"), ("3", "Hellas Verona", "IT1"), ("4", "Chievo Verona", "IT1"),
            ("5", "Clube Atlético Mineiro", "BRA1"), ("6", "Clube Atlético Paranaense", "BRA1"), ("7", "Arsenal FC", "GB1"),
        ],
        "club_id string, name string, domestic_competition_id string",
    )
    got = {r.team: r.cid for r in resolve.club_mapping(teams, clubs).collect()}
    assert got == {"Ath Madrid": "1", "Real Madrid": "2", "Verona": "3", "Atletico-MG": "5", "Nowhere": None}


def test_rating_names_per_country(spark):
    teams = spark.createDataFrame([("Ath Madrid", "PD"), ("Hearts", "SCO1"), ("Bayern Munich", "BL1"), ("Ghost", "PL")], "team string, league string")
    snaps = spark.createDataFrame(
        [("ESP", "atletico", "2020-01", 1.0), ("ESP", "realmadrid", "2020-01", 1.0), ("SCO", "hearts", "2020-01", 1.0), ("GER", "bayern", "2020-01", 1.0), ("ENG", "arsenal", "2020-01", 1.0)],
        "country string, norm_name string, month string, elo double",
    )
    got = {r.team: r.norm_name for r in resolve.rating_mapping(teams, snaps).collect()}
    assert got == {"Ath Madrid": "atletico", "Hearts": "hearts", "Bayern Munich": "bayern", "Ghost": None}
