"""Feed queries: derived matches are rendered as feed text and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.operators import feeds, match_rows, tables
from terrace.plans.catalogue import query
from terrace.plans.sql import APPEARANCES, LONG, MATCHES, RATINGS, VALUATIONS, probs, with_ctes
from terrace.scale import checkpoint
from terrace.sources import derived, headed_csv, match_feeds, pages, side_json

_CORE = "match_id, match_date, home_team, away_team, home_score, away_score, result"


def _text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _lines(df, file, body, header):
    """(file, match_id, value): one header line per file and one line per match.

    The rendered text is written out once, as real files would be.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpoint(df.select(file.alias("file"), F.col("match_id"), body.alias("value")).repartition(n))
    heads = rows.select("file").distinct().select("file", F.lit(None).cast("long").alias("match_id"), F.lit(header).alias("value"))
    return rows.unionByName(heads)


def _out(df, *more):
    return df.select("match_id", "match_date", "home_team", "away_team", "home_score", "away_score", "result", *more)


def _file(m):
    return F.concat_ws("_", F.concat(F.year("match_date").cast("string"), F.lit("-"), F.date_format("match_date", "yy")), F.lit("eng.1"))


@query("src_footballcsv", with_ctes(MATCHES, select=f"SELECT {_CORE} FROM matches WHERE match_id % 19 <> 0"))
def src_footballcsv(spark, sf_dir):
    m = derived.matches(spark, sf_dir)
    score = F.when(F.col("match_id") % 19 == 0, "?").otherwise(F.concat_ws("-", "home_score", "away_score"))
    body = F.concat_ws(",", F.date_format("match_date", "E MMM d yyyy"), "home_team", score, F.lit("?"), F.concat(F.col("away_team"), F.lit("\r")))
    lines = _lines(m, _file(m), body, "Date,Team 1,FT,HT,Team 2")
    rows = headed_csv.headed_rows(lines, match_feeds.MIRROR_HEADER, width=8)
    return _out(match_feeds.parse_mirror(rows.withColumns({"season": F.lit(""), "feed_code": F.lit("eng.1")})))


_STAT_OUT = [f"{side}_{s}" for side in ("home", "away") for s in ("shots", "corners", "red")]


@query(
    "src_resultsfeed",
    with_ctes(
        MATCHES,
        select=f"""
SELECT match_id, match_date, home_team, away_team, CASE WHEN match_id % 23 = 0 THEN 0 ELSE home_score END AS home_score, away_score,
  CAST(sign(CASE WHEN match_id % 23 = 0 THEN 0 ELSE home_score END - away_score) AS INTEGER) AS result, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _STAT_OUT)}
FROM matches WHERE match_id % 29 <> 0""",
    ),
)
def src_resultsfeed(spark, sf_dir):
    m = derived.matches(spark, sf_dir)
    k = F.col("match_id")
    letter = F.when(k % 29 == 0, "").when(F.col("result") == 1, "H").when(F.col("result") == 0, "D").otherwise("A")
    day = F.when(k % 2 == 0, F.date_format("match_date", "dd/MM/yy")).otherwise(F.date_format("match_date", "dd/MM/yyyy"))
    stats = [_text(c) for c in V.STAT_COLUMNS]
    home = F.when(k % 23 == 0, "").otherwise(_text("home_score"))
    body = F.concat_ws(",", F.lit("E0"), day, "home_team", "away_team", home, _text("away_score"), letter, *stats)
    lines = _lines(m, _file(m), body, "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR," + ",".join(V.STAT_COLUMNS.values()))
    rows = headed_csv.headed_rows(lines, match_feeds.RESULTS_HEADER, width=24)
    parsed = match_feeds.parse_results(rows.withColumns({"season": F.lit(""), "feed_code": F.lit("eng.1")}))
    return _out(parsed, *[F.col(c).cast("double").alias(c) for c in _STAT_OUT])


@query(
    "src_wholehistory",
    with_ctes(
        MATCHES,
        select=f"SELECT {_CORE}, CAST(year(match_date) - 1 AS VARCHAR) || '-' || strftime(match_date, '%y') AS season FROM matches WHERE match_id % 31 <> 0 AND year(match_date) BETWEEN 1996 AND 1999",
    ),
)
def src_wholehistory(spark, sf_dir):
    """A calendar-year league whose file mixes '1997' and '1996/1997' labels, cut to four seasons."""
    m = derived.matches(spark, sf_dir)
    k, y = F.col("match_id"), F.year("match_date")
    label = F.when(k % 2 == 0, y.cast("string")).otherwise(F.concat((y - 1).cast("string"), F.lit("/"), y.cast("string")))
    res = F.when(k % 31 == 0, "").when(F.col("result") == 1, "H").when(F.col("result") == 0, "D").otherwise("A")
    body = F.concat_ws(
        ",", F.lit("Brazil"), F.lit("Serie A"), label, F.date_format("match_date", "dd/MM/yyyy"), F.lit("20:00"), "home_team", "away_team",
        _text("home_score"), _text("away_score"), res,
    )
    lines = _lines(m, F.lit("br.1"), body, "Country,League,Season,Date,Time,Home,Away,HG,AG,Res")
    rows = headed_csv.headed_rows(lines, match_feeds.HISTORY_HEADER, width=12).withColumn("feed_code", F.col("file"))
    seasons = ["1995-96", "1996-97", "1997-98", "1998-99"]
    return _out(match_feeds.parse_history(match_feeds.season_slots(rows, seasons)), "season")


@query("src_shape_detect", with_ctes(MATCHES, select=f"SELECT {_CORE} FROM matches"))
def src_shape_detect(spark, sf_dir):
    """Two shapes in one set of files, told apart by each file's header."""
    m = derived.matches(spark, sf_dir)
    letter = F.when(F.col("result") == 1, "H").when(F.col("result") == 0, "D").otherwise("A")
    a = F.concat_ws(",", F.date_format("match_date", "yyyy-MM-dd"), "home_team", F.concat_ws("-", "home_score", "away_score"), F.lit(""), "away_team")
    b = F.concat_ws(",", F.date_format("match_date", "dd/MM/yyyy"), "away_team", "home_team", letter, _text("home_score"), _text("away_score"))
    even, odd = m.filter("match_id % 2 = 0"), m.filter("match_id % 2 = 1")
    lines = _lines(even, F.lit("mirror"), a, "Date,Team 1,FT,HT,Team 2").unionByName(
        _lines(odd, F.lit("results"), b, "Date,AwayTeam,HomeTeam,FTR,FTHG,FTAG")
    )
    rows = headed_csv.headed_rows(lines, match_feeds.ANY_HEADER, width=8)
    return _out(match_feeds.parse_any(rows.withColumns({"season": F.lit(""), "feed_code": F.lit("eng.1")})))


@query(
    "src_match_json",
    with_ctes(
        MATCHES,
        select=f"SELECT {_CORE}, competition, CAST(home_shots AS DOUBLE) AS home_shots FROM matches JOIN orders ON o_orderkey = match_id WHERE o_orderstatus = 'F' AND match_id % 7 <> 0",
    ),
)
def src_match_json(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), "o_orderstatus")
    m = derived.matches(spark, sf_dir).join(o, "match_id")
    team = lambda c: F.struct(F.col(c).alias("name"))
    full = F.struct(F.when(F.col("match_id") % 7 != 0, F.col("home_score")).alias("home"), F.col("away_score").alias("away"))
    doc = F.struct(
        F.col("match_id").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("TIMED").alias("status"),
        F.date_format("match_date", "yyyy-MM-dd'T'15:00:00'Z'").alias("utcDate"),
        team("home_team").alias("homeTeam"),
        team("away_team").alias("awayTeam"),
        F.struct(full.alias("fullTime")).alias("score"),
        F.struct(F.col("competition").alias("code")).alias("competition"),
        F.create_map(F.lit("home_shots"), F.col("home_shots")).alias("stats"),
    )
    text = m.select("match_id", F.to_json(doc).alias("json"))
    parsed = text.select("match_id", F.from_json("json", match_feeds.MATCH_JSON_SCHEMA).alias("doc"))
    flat = match_feeds.flatten_matches(parsed, keep=["match_id"])
    return _out(flat, "competition", F.col("home_shots").cast("double").alias("home_shots"))


@query(
    "src_odds",
    with_ctes(
        MATCHES,
        f"priced AS (SELECT match_id, result AS y, competition, {probs()} FROM matches)",
        "odds AS (SELECT match_id, y, competition, floor(95.0::DOUBLE / p_home) / 100.0 AS oh, floor(95.0::DOUBLE / p_draw) / 100.0 AS od, floor(95.0::DOUBLE / p_away) / 100.0 AS oa FROM priced)",
        select="""
SELECT match_id, y, round(1 / oh / (1 / oh + 1 / od + 1 / oa), 6) AS p_home, round(1 / od / (1 / oh + 1 / od + 1 / oa), 6) AS p_draw, round(1 / oa / (1 / oh + 1 / od + 1 / oa), 6) AS p_away
FROM odds WHERE match_id % 13 <> 0 AND competition <> 'ZZ1'""",
    ),
)
def src_odds(spark, sf_dir):
    """Files with one whole triple, with a broken first triple, and with none."""
    m = derived.probabilities(derived.matches(spark, sf_dir))
    odd = [(F.floor(95.0 / F.col(c)) / 100.0).cast("string") for c in ("p_home", "p_draw", "p_away")]
    odd[0] = F.when(F.col("match_id") % 13 == 0, "0").otherwise(odd[0])
    letter = F.when(F.col("result") == 1, "H").when(F.col("result") == 0, "D").otherwise("A")
    whole = F.concat_ws(",", "home_team", "away_team", letter, *odd)
    broken = F.concat_ws(",", "home_team", "away_team", letter, F.lit("9"), F.lit("9"), *odd)
    lines = _lines(m.filter("competition not in ('PD', 'ZZ1')"), F.col("competition"), whole, "HomeTeam,AwayTeam,FTR,B365H,B365D,B365A")
    lines = lines.unionByName(_lines(m.filter("competition = 'PD'"), F.col("competition"), broken, "HomeTeam,AwayTeam,FTR,B365H,B365D,PSH,PSD,PSA"))
    lines = lines.unionByName(_lines(m.filter("competition = 'ZZ1'"), F.col("competition"), whole, "HomeTeam,AwayTeam,FTR,X,Y,Z"))
    out = match_feeds.parse_odds(headed_csv.headed_rows(lines, match_feeds.RESULTS_HEADER, width=10))
    return out.select("match_id", "y", *[F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")])


@query(
    "src_reference_csvgz",
    with_ctes(VALUATIONS, select="SELECT seq, valued_on, CAST(player_id AS VARCHAR) AS player_id, CAST(value_eur AS DOUBLE) AS value_eur, club_id FROM valuations WHERE seq % 10 > 2"),
)
def src_reference_csvgz(spark, sf_dir):
    v = derived.valuations(spark, sf_dir).withColumnRenamed("seq", "match_id")
    k = F.col("match_id")
    amount = F.when(k % 10 == 0, "").when(k % 10 == 1, "abc").otherwise(F.col("value_eur").cast("string"))
    body = F.concat_ws(",", F.col("player_id").cast("string"), F.col("valued_on").cast("string"), amount, F.when(k % 10 == 2, "").otherwise(F.col("club_id")))
    rows = headed_csv.headed_rows(_lines(v, F.lit("player_valuations"), body, "player_id,date,market_value_in_eur,current_club_id"), "^player_id,", width=6)
    out = match_feeds.parse_valuations(rows)
    return out.select(k.alias("seq"), "valued_on", "player_id", F.col("value_eur").cast("double").alias("value_eur"), "club_id")


@query(
    "src_appearances",
    with_ctes(
        APPEARANCES,
        select="""
SELECT club_id, count(*) AS n, min(played_on) AS first_day, CAST(sum(goals) AS DOUBLE) AS goals, CAST(sum(yellow_cards + red_cards) AS DOUBLE) AS cards
FROM appearances WHERE game_id % 17 <> 0 GROUP BY 1""",
    ),
)
def src_appearances(spark, sf_dir):
    a = derived.appearances(spark, sf_dir).withColumn("match_id", F.col("game_id"))
    s = lambda c: F.col(c).cast("string")
    game = F.when(F.col("game_id") % 17 == 0, "").otherwise(s("game_id"))
    blank0 = lambda c: F.when(F.col(c) == 0, "").otherwise(s(c))
    body = F.concat_ws(",", "club_id", game, s("played_on"), blank0("goals"), s("assists"), s("yellow_cards"), blank0("red_cards"))
    header = "player_club_id,game_id,date,goals,assists,yellow_cards,red_cards"
    out = match_feeds.parse_appearances(headed_csv.headed_rows(_lines(a, F.lit("appearances"), body, header), "^player_club_id,", width=8))
    return out.groupBy("club_id").agg(
        F.count("*").alias("n"), F.min("played_on").alias("first_day"), F.sum("goals").alias("goals"), F.sum(F.col("yellow_cards") + F.col("red_cards")).alias("cards")
    )


@query(
    "src_rating_snapshots",
    with_ctes(RATINGS, select="SELECT 'ENG' AS country, lower(club_id) AS norm_name, month, elo FROM snapshots WHERE right(club_id, 1) <> '3'"),
)
def src_rating_snapshots(spark, sf_dir):
    r = derived.rating_snapshots(spark, sf_dir).withColumn("match_id", F.lit(0).cast("long"))
    elo = F.when(F.col("club_id").endswith("3"), "n/a").otherwise(F.col("elo").cast("string"))
    body = F.concat_ws(",", F.lit("1"), F.concat(F.lit("FC "), F.col("club_id")), F.lit("ENG"), elo)
    lines = _lines(r, F.concat(F.lit("ratings_"), F.col("month"), F.lit(".csv")), body, "Rank,Club,Country,Elo")
    out = match_feeds.parse_rating_snapshots(headed_csv.headed_rows(lines, "^Rank,", width=5))
    return out.select("country", "norm_name", "month", "elo")


@query(
    "src_standings_json",
    with_ctes(
        MATCHES,
        LONG,
        """
t AS (SELECT competition, CAST(year(match_date) AS BIGINT) AS season_id, team, CAST(sum(points) AS INTEGER) AS points, CAST(sum(gd) AS INTEGER) AS gd, CAST(sum(gs) AS INTEGER) AS gf, CAST(count(*) AS INTEGER) AS played
  FROM long_form GROUP BY 1, 2, 3)""",
        select="SELECT competition, season_id, team AS name, points, gd, gf, played, CAST(row_number() OVER (PARTITION BY competition, season_id ORDER BY points DESC, gd DESC, gf DESC, team) AS INTEGER) AS position FROM t",
    ),
)
def src_standings_json(spark, sf_dir):
    """One document per table row group of a league season, holding a TOTAL and a HOME block."""
    rows = match_rows.team_rows(derived.matches(spark, sf_dir)).withColumn("season", F.year("match_date").cast("long"))
    t = tables.league_table(rows, ["competition", "season"])
    entry = F.struct(
        "position", F.struct(F.xxhash64("team").alias("id"), F.col("team").alias("name"), F.col("team").alias("shortName")).alias("team"),
        F.col("played").alias("playedGames"), "points", F.col("gd").alias("goalDifference"), F.col("gf").alias("goalsFor"),
    )
    block = lambda kind: F.struct(F.lit(kind).alias("type"), F.array(entry).alias("table"))
    doc = F.struct(F.struct(F.col("season").alias("id")).alias("season"), F.array(block("HOME"), block("TOTAL")).alias("standings"))
    docs = t.select("competition", F.to_json(doc).alias("json"))
    out = side_json.standings_rows(docs, keep=["competition"])
    return out.select("competition", "season_id", "name", "points", "gd", "gf", "played", "position")


@query(
    "src_availability_json",
    with_ctes(
        MATCHES,
        select="SELECT match_id, home_team AS club, round((match_id % 40) / 80.0, 4)::DOUBLE AS value_out_fraction, (match_id % 5)::DOUBLE AS key_absences FROM fixtures",
    ),
)
def src_availability_json(spark, sf_dir):
    k = F.col("match_id")
    entry = F.struct(F.round((k % 40) / 80.0, 4).alias("value_out_fraction"), (k % 5).cast("double").alias("key_absences"))
    doc = F.struct(F.create_map(F.concat_ws("#", "home_team", k.cast("string")), entry).alias("availability"))
    docs = derived.fixtures(spark, sf_dir).select(F.to_json(doc).alias("json"))
    rows = side_json.availability_rows(docs)
    part = F.split("club", "#")
    return rows.select(part[1].cast("long").alias("match_id"), part[0].alias("club"), "value_out_fraction", "key_absences")


@query(
    "src_style_metrics",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, CAST(CASE match_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 4 END AS INTEGER) AS def_shape, round((match_id % 4 + match_id % 3)::DOUBLE / (match_id % 9), 3) AS cards_pg,
  round(CASE WHEN home_score + away_score + 1 > 0 THEN (away_score + 1)::DOUBLE / (home_score + away_score + 1) ELSE 0 END, 3) AS late_share
FROM matches WHERE match_id % 9 <> 0""",
    ),
)
def src_style_metrics(spark, sf_dir):
    k = F.col("match_id")
    tot = lambda c: F.struct(c.cast("int").alias("total"))
    shape = lambda f, n: F.struct(F.lit(f).alias("formation"), n.cast("int").alias("played"))
    lineups = F.array(shape("3-5-2", F.when(k % 3 == 0, 9).otherwise(1)), shape("5-4-1", F.when(k % 3 == 1, 9).otherwise(2)), shape("x", F.lit(5)))
    doc = F.struct(
        F.struct(F.struct((k % 9).cast("int").alias("total")).alias("played")).alias("fixtures"),
        lineups.alias("lineups"),
        F.struct(
            F.create_map(F.lit("0-15"), tot(k % 4)).alias("yellow"), F.create_map(F.lit("0-15"), tot(k % 3), F.lit("16-30"), tot(F.lit(None))).alias("red")
        ).alias("cards"),
        F.struct(
            F.struct(
                F.create_map(
                    F.lit("0-15"), tot(F.col("home_score")), F.lit("76-90"), tot(F.col("away_score")), F.lit("91-105"), tot(F.lit(1))
                ).alias("minute")
            ).alias("for")
        ).alias("goals"),
    )
    docs = derived.matches(spark, sf_dir).select("match_id", F.to_json(doc).alias("json"))
    return side_json.style_metrics(docs, keep=["match_id"])


# --- pages ------------------------------------------------------------------

_LINKS = "links AS (SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(l) AS label FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) AS l FROM pages))"


@query("src_pages_links", with_ctes(_LINKS, select="SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM links"))
def src_pages_links(spark, sf_dir):
    return pages.link_rows(derived.table(spark, sf_dir, "pages"))


@query(
    "win_carry_date",
    with_ctes(
        _LINKS,
        "marked AS (SELECT *, CASE WHEN length(label) % 2 = 0 THEN label END AS mark FROM links)",
        select="""
SELECT page_id, CAST(pos AS INTEGER) AS pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS carried FROM marked""",
    ),
)
def win_carry_date(spark, sf_dir):
    rows = pages.link_rows(derived.table(spark, sf_dir, "pages"))
    rows = rows.withColumn("mark", F.when(F.length("label") % 2 == 0, F.col("label")))
    return feeds.carry_forward(rows, ["page_id"], "pos", "mark", "carried").select("page_id", "pos", "carried")


def _anchor(team, key):
    return F.concat(F.lit('<td><a title="'), team, F.lit('" href="/x/startseite/verein/'), key.cast("string"), F.lit('/saison">t</a></td>'))


@query(
    "src_pages_results",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id AS page_id, 1 AS pos, match_date, home_team, away_team, home_score, away_score FROM matches
UNION ALL SELECT match_id, 3, match_date, away_team, home_team, away_score + 1, home_score FROM matches WHERE match_id % 2 = 0""",
    ),
)
def src_pages_results(spark, sf_dir):
    """A results page per match: dated played row, unplayed row, and a second played row that inherits the date."""
    m = derived.matches(spark, sf_dir)
    k = F.col("match_id")

    def played(h, a, hs, as_):
        link = F.concat(F.lit('<td><a class="ergebnis-link" href="/r"> '), hs.cast("string"), F.lit(":"), as_.cast("string"), F.lit(" </a></td>"))
        return F.concat(F.lit("\n<tr class='x'>"), _anchor(h, k), link, _anchor(a, k), F.lit("</tr>"))

    dated = F.concat(F.lit('<table><tr><td><a href="/aktuell/datum/'), F.col("match_date").cast("string"), F.lit('">day</a></td></tr>'))
    open_row = F.concat(F.lit("<tr>"), _anchor(F.col("home_team"), k), F.lit("<td>20:00</td>"), _anchor(F.col("away_team"), k), F.lit("</tr>"))
    first = played(F.col("home_team"), F.col("away_team"), F.col("home_score"), F.col("away_score"))
    again = F.when(k % 2 == 0, played(F.col("away_team"), F.col("home_team"), F.col("away_score") + 1, F.col("home_score"))).otherwise("")
    held = m.select(k.alias("page_id"), F.concat(dated, first, open_row, again, F.lit("</table>")).alias("html"))
    return pages.result_rows(held)


@query(
    "src_pages_values",
    """
WITH v AS (SELECT s_suppkey, s_name, floor(abs(s_acctbal)) / 100.0 AS amt FROM supplier)
SELECT s_suppkey AS page_id, CAST(s_suppkey AS VARCHAR) AS club_id, s_name AS name, round(amt * CASE s_suppkey % 3 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 ELSE 1e3 END, 2) AS value_eur FROM v
WHERE amt * CASE s_suppkey % 3 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 ELSE 1e3 END BETWEEN 200000 AND 2000000000""",
)
def src_pages_values(spark, sf_dir):
    s = derived.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    amount = F.floor(F.abs("s_acctbal")) / 100.0
    unit = F.when(key % 3 == 0, "bn").when(key % 3 == 1, "m").otherwise("k")
    row = F.concat(
        F.lit('<html><table class="items"><tr class="odd"><td><a href="/c/startseite/verein/'), key.cast("string"),
        F.lit('/saison_id/2025" title="'), F.col("s_name"), F.lit('">c</a></td><td>€0.01k</td><td>€'), amount.cast("string"), unit,
        F.lit("</td></tr><tr class='none'><td>x</td></tr></table></html>"),
    )
    out = pages.club_values(s.select(key.alias("page_id"), row.alias("html")))
    return out.withColumn("value_eur", F.round("value_eur", 2))


