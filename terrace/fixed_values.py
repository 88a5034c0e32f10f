"""Constants and lookup tables that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: ratings -------------------------------------------------
ELO_START = 1500.0
ELO_K = 40.0
ELO_HOME_ADV = 65.0
ELO_GAP_DAYS = 45
ELO_GAP_PULL = 0.10
BASE_HOME_GOALS = 1.45
BASE_AWAY_GOALS = 1.20
BASELINE_MIN_MATCHES = 200
DC_START = 1.0
DC_K = 0.08
DC_LOW, DC_HIGH = 0.4, 2.5
DC_RHO = -0.10
MAX_GOALS = 8
PI_LAMBDA = 0.035
PI_GAMMA = 0.7
PI_C = 3.0
PI_START = 0.0
PI_CLIP = 4.0
PI_MIN_GAMES = 4
EWMA_ALPHA = 0.3

# --- fixed values: training ------------------------------------------------
CALIB_LOW, CALIB_HIGH = 0.01, 0.99
CALIB_C = (0.1, 0.3, 1.0, 3.0)
CALIB_PRIOR_MIX = (0.0, 0.03, 0.06, 0.10)
VOTE_WEIGHTS = (0.4, 0.35, 0.25)  # boosted trees, forest, logistic
VOTE_GRID = ((0.5, 0.3, 0.2), (0.4, 0.35, 0.25), (0.34, 0.33, 0.33), (0.25, 0.45, 0.3))
SELECT_K_GRID = (None, 50, 35, 20)
TUNING_ROWS = 25_000
RECENCY_HALFLIFE_DAYS = 540
LEARNER_DEFAULTS = {
    "gbt": {"depth": 4, "rounds": 300, "step": 0.05, "min_leaf": 20},
    "forest": {"trees": 400, "depth": 10, "min_leaf": 5, "subset": "sqrt"},
    "logistic": {"c": 0.5, "max_iter": 2000},
}
LEARNER_GRIDS = {
    "gbt": (
        {"depth": 4, "rounds": 300, "step": 0.05, "min_leaf": 20},
        {"depth": 6, "rounds": 250, "step": 0.03, "min_leaf": 30},
        {"depth": 5, "rounds": 400, "step": 0.04, "min_leaf": 15},
    ),
    "forest": (
        {"trees": 300, "depth": 10, "min_leaf": 10, "subset": "sqrt"},
        {"trees": 400, "depth": 10, "min_leaf": 5, "subset": "sqrt"},
        {"trees": 350, "depth": 12, "min_leaf": 8, "subset": "log2"},
    ),
    "logistic": ({"c": 0.2, "max_iter": 2000}, {"c": 1.0, "max_iter": 2000}, {"c": 0.05, "max_iter": 2000}),
}

# --- fixed values: text ----------------------------------------------------
CLUB_DROP_TOKENS = r"\b(fc|afc|cf|sc|cd|ac|sv|ss|as|us|rc|sk|sp|ca|ec|se|cr|club|de|do|the|team)\b"
RATING_DROP_TOKENS = r"\b(fc|afc|cf|sc|cd|ac|sv|ss|as|us|rc|sk|club|the)\b"

# --- fixed values: outcome labels and bands --------------------------------
OUTCOME_LABELS = {-1: "Away Win", 0: "Draw", 1: "Home Win"}
TRACK_BANDS = [(0.0, 0.40), (0.40, 0.50), (0.50, 0.60), (0.60, 0.70), (0.70, 0.80), (0.80, 1.01)]
VALUE_BAND_EUR = (200_000, 2_000_000_000)
STYLE_AXES = ("directness", "pressing", "tempo", "possession")
ODDS_TRIPLES = [("B365H", "B365D", "B365A"), ("PSH", "PSD", "PSA"), ("AvgH", "AvgD", "AvgA"), ("BbAvH", "BbAvD", "BbAvA")]

# --- fixed values: feed columns --------------------------------------------
STAT_COLUMNS = {
    "home_shots": "HS", "away_shots": "AS",
    "home_shots_on_target": "HST", "away_shots_on_target": "AST",
    "home_corners": "HC", "away_corners": "AC",
    "home_fouls": "HF", "away_fouls": "AF",
    "home_yellow": "HY", "away_yellow": "AY",
    "home_red": "HR", "away_red": "AR",
}
NAME_CANON = {"Ham-Kam": "HamKam", "Colon Santa FE": "Colon Santa Fe"}

# --- fixed values: league registry, strongest first ------------------------
# code, name, country, feed code, source, page code, calendar year, live
LEAGUES = [
    ("PL", "Premier League", "England", "eng.1", "fd", None, False, True),
    ("PD", "La Liga", "Spain", "es.1", "fd", None, False, True),
    ("BL1", "Bundesliga", "Germany", "de.1", "fd", None, False, True),
    ("SA", "Serie A", "Italy", "it.1", "fd", None, False, True),
    ("FL1", "Ligue 1", "France", "fr.1", "fd", None, False, True),
    ("PPL", "Primeira Liga", "Portugal", "pt.1", "fd", None, False, True),
    ("DED", "Eredivisie", "Netherlands", "nl.1", "fd", None, False, True),
    ("BEL1", "Belgian Pro League", "Belgium", "be.1", "fd", None, False, False),
    ("BSA", "Brasileirão Série A", "Brazil", "br.1", "fdnew", None, True, True),
    ("TUR1", "Süper Lig", "Turkey", "tr.1", "fd", None, False, False),
    ("ARG1", "Primera División (Arg)", "Argentina", "ar.1", "fdnew", None, True, False),
    ("RUS1", "Russian Premier League", "Russia", "ru.1", "fdnew", None, False, False),
    ("SAU1", "Saudi Pro League", "Saudi Arabia", "sau.1", "tm", "SA1", False, False),
    ("MEX1", "Liga MX", "Mexico", "mx.1", "fdnew", None, False, False),
    ("GRE1", "Super League Greece", "Greece", "gr.1", "fd", None, False, False),
    ("SUI1", "Swiss Super League", "Switzerland", "ch.1", "fdnew", None, False, False),
    ("AUT1", "Austrian Bundesliga", "Austria", "at.1", "fdnew", None, False, False),
    ("SCO1", "Scottish Premiership", "Scotland", "sco.1", "fd", None, False, False),
    ("DEN1", "Danish Superliga", "Denmark", "dk.1", "fdnew", None, False, False),
    ("UKR1", "Ukrainian Premier League", "Ukraine", "ukr.1", "tm", "UKR1", False, False),
    ("CRO1", "SuperSport HNL", "Croatia", "cro.1", "tm", "KR1", False, False),
    ("CZE1", "Chance Liga", "Czechia", "cze.1", "tm", "TS1", False, False),
    ("SRB1", "Super liga Srbije", "Serbia", "srb.1", "tm", "SER1", False, False),
    ("NOR1", "Eliteserien", "Norway", "no.1", "fdnew", None, True, False),
    ("POL1", "Ekstraklasa", "Poland", "pl.1", "fdnew", None, False, False),
    ("SWE1", "Allsvenskan", "Sweden", "se.1", "fdnew", None, True, False),
    ("ROU1", "Liga I", "Romania", "ro.1", "fdnew", None, False, False),
    ("KOR1", "K League 1", "South Korea", "kor.1", "tm", "RSK1", True, False),
    ("JPN1", "J1 League", "Japan", "jp.1", "fdnew", None, True, False),
    ("MLS", "Major League Soccer", "USA", "us.1", "fdnew", None, True, False),
    ("COL1", "Primera A", "Colombia", "col.1", "tm", "COL1", True, False),
    ("QAT1", "Qatar Stars League", "Qatar", "qat.1", "tm", "QSL", False, False),
    ("UAE1", "UAE Pro League", "UAE", "uae.1", "tm", "UAE1", False, False),
    ("ISR1", "Ligat ha'Al", "Israel", "isr.1", "tm", "ISR1", False, False),
    ("CHI1", "Primera División (Chi)", "Chile", "chi.1", "tm", "CLPD", True, False),
    ("EGY1", "Egyptian Premier League", "Egypt", "egy.1", "tm", "EGY1", False, False),
    ("HUN1", "NB I", "Hungary", "hun.1", "tm", "UNG1", False, False),
    ("URU1", "Primera División (Uru)", "Uruguay", "uru.1", "tm", "URU1", True, False),
    ("RSA1", "Betway Premiership", "South Africa", "rsa.1", "tm", "SFA1", False, False),
    ("AUS1", "A-League Men", "Australia", "aus.1", "tm", "AUS1", False, False),
    ("CHN1", "Chinese Super League", "China", "cn.1", "fdnew", None, True, False),
    ("ECU1", "LigaPro Serie A", "Ecuador", "ecu.1", "tm", "EC1N", True, False),
    ("MAR1", "Botola Pro", "Morocco", "mar.1", "tm", "MAR1", False, False),
    ("PAR1", "Primera División (Par)", "Paraguay", "par.1", "tm", "PR1A", True, False),
    ("PER1", "Liga 1", "Peru", "per.1", "tm", "TDeA+TDeC", True, False),
    ("IND1", "Indian Super League", "India", "ind.1", "tm", "IND1", False, False),
    ("FIN1", "Veikkausliiga", "Finland", "fi.1", "fdnew", None, True, False),
    ("IRL1", "League of Ireland", "Ireland", "ie.1", "fdnew", None, True, False),
]
CUPS = [("CL", "UEFA Champions League"), ("EC", "European Championship"), ("WC", "FIFA World Cup")]
WARMUP_LEAGUES = {"eng.2": "ELC", "es.2": "PD2", "de.2": "BL2", "it.2": "SA2", "fr.2": "FL2"}
CONFEDERATION_COUNTRIES = {
    "UEFA": [
        "England", "Spain", "Germany", "Italy", "France", "Portugal", "Netherlands", "Belgium", "Turkey", "Greece",
        "Russia", "Switzerland", "Austria", "Scotland", "Denmark", "Ukraine", "Croatia", "Czechia", "Serbia", "Norway",
        "Poland", "Sweden", "Romania", "Hungary", "Israel",
    ],
    "CONMEBOL": ["Brazil", "Argentina", "Colombia", "Chile", "Uruguay", "Ecuador", "Paraguay", "Peru"],
    "AFC": ["Saudi Arabia", "South Korea", "Japan", "China", "Qatar", "UAE", "India", "Australia"],
    "CAF": ["Egypt", "South Africa", "Morocco"],
    "CONCACAF": ["Mexico", "USA"],
}
CONFEDERATION_LABELS = {
    "UEFA": ("UCL", "UEL"),
    "CONMEBOL": ("Libertadores", "Sudamericana"),
    "AFC": ("AFC CL", ""),
    "CAF": ("CAF CL", ""),
    "CONCACAF": ("CCC", ""),
}
# relegation, top continental, second continental, playoff places
DEFAULT_RULES = (3, 4, 2, 0)
LEAGUE_RULES = {
    "PL": (3, 5, 2, 0), "PD": (3, 5, 2, 0), "BL1": (2, 4, 2, 1), "SA": (3, 4, 2, 0), "FL1": (3, 3, 2, 1),
    "PPL": (3, 2, 3, 0), "DED": (3, 2, 2, 0), "BEL1": (3, 2, 2, 0), "SCO1": (1, 1, 3, 1),
}

# --- fixed values: league -> candidate pool --------------------------------
LEAGUE_VALUE_COMP = {
    "PL": "GB1", "PD": "ES1", "BL1": "L1", "SA": "IT1", "FL1": "FR1", "DED": "NL1", "PPL": "PO1", "BEL1": "BE1",
    "TUR1": "TR1", "GRE1": "GR1", "RUS1": "RU1", "POL1": "PL1", "AUT1": "A1", "SUI1": "C1", "DEN1": "DK1",
    "ROU1": "RO1", "BSA": "BRA1", "SCO1": "SC1", "MEX1": "MEX1", "NOR1": "NO1", "SWE1": "SE1", "JPN1": "JAP1",
    "MLS": "MLS1", "ARG1": "ARG1", "ELC": "GB2", "ELC2": "GB3", "ELC3": "GB4", "PD2": "ES2", "SA2": "IT2",
    "BL2": "L2", "FL2": "FR2",
}
LEAGUE_VALUE_POOL = {
    "ELC": ("GB2", "GB3", "GB4"), "ELC2": ("GB2", "GB3", "GB4"), "ELC3": ("GB2", "GB3", "GB4"),
    "PD2": ("ES2",), "SA2": ("IT2",), "BL2": ("L2",), "FL2": ("FR2",),
}
LEAGUE_RATING_COUNTRY = {
    "PL": "ENG", "ELC": "ENG", "ELC2": "ENG", "ELC3": "ENG", "ENG5": "ENG", "PD": "ESP", "PD2": "ESP", "SA": "ITA",
    "SA2": "ITA", "BL1": "GER", "BL2": "GER", "FL1": "FRA", "FL2": "FRA", "DED": "NED", "PPL": "POR", "BEL1": "BEL",
    "TUR1": "TUR", "GRE1": "GRE", "RUS1": "RUS", "POL1": "POL", "AUT1": "AUT", "SUI1": "SUI", "DEN1": "DEN",
    "ROU1": "ROU", "SCO1": "SCO", "SCO2": "SCO", "SCO3": "SCO", "SCO4": "SCO", "NOR1": "NOR", "SWE1": "SWE",
}


def values_sql(rows: list[tuple], columns: list[str], alias: str = "t", spark: bool = True) -> str:
    """A literal table as SQL; as a LocalRelation its size is known to the optimizer."""

    def lit(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)" if spark else "CAST(NULL AS VARCHAR)"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + (v.replace("\\", "\\\\").replace("'", "\\'") if spark else v.replace("'", "''")) + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {alias}({', '.join(columns)})"


LEAGUE_COLUMNS = ["league_rank", "code", "league_name", "country", "feed_code", "source", "page_code", "calendar_year", "live_api"]


def league_rows() -> list[tuple]:
    return [(i + 1, *row) for i, row in enumerate(LEAGUES)]


def confederation_rows() -> list[tuple]:
    return [
        (country, confed, *CONFEDERATION_LABELS[confed])
        for confed, countries in CONFEDERATION_COUNTRIES.items()
        for country in countries
    ]


CONFEDERATION_COLUMNS = ["country", "confederation", "top_label", "second_label"]
RULE_COLUMNS = ["code", "relegation_slots", "cl_slots", "uel_slots", "playoff_slots"]


def rule_rows() -> list[tuple]:
    return [(code, *slots) for code, slots in LEAGUE_RULES.items()]


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    return spark.sql(values_sql(rows, columns))


def league_dim(spark: SparkSession) -> DataFrame:
    """The registry as a dimension; its size is fixed, so joins may broadcast it."""
    return literal_table(spark, league_rows(), LEAGUE_COLUMNS)


def confederation_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, confederation_rows(), CONFEDERATION_COLUMNS)


def rules_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, rule_rows(), RULE_COLUMNS)
