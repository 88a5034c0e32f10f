"""Hand-verified club name tables, the defaults of the resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.fixed_values import literal_table

# --- fixed values: our name -> value-source name within the same league -----
CLUB_NAMES = {
    "Man City": "Manchester City", "Man United": "Manchester United", "Nott'm Forest": "Nottingham Forest",
    "Wolves": "Wolverhampton Wanderers", "Ath Bilbao": "Athletic Bilbao", "Ath Madrid": "Atlético de Madrid",
    "Espanol": "RCD Espanyol Barcelona", "Ein Frankfurt": "Eintracht Frankfurt", "M'gladbach": "Borussia Mönchengladbach",
    "Verona": "Hellas Verona", "Rennes": "Stade Rennais FC", "For Sittard": "Fortuna Sittardia Combinatie",
    "Sp Lisbon": "Sporting CP", "Aves": "Desportivo Aves (- 2020)", "Club Brugge": "Club Brugge KV",
    "St Truiden": "Sint-Truidense VV", "St. Gilloise": "Union Saint-Gilloise", "Hearts": "Heart of Midlothian FC",
    "BW Linz": "FC Blau-Weiss Linz", "Grasshoppers": "Grasshopper Club Zurich", "Ad. Demirspor": "Adana Demirspor",
    "Bodrumspor": "Bodrum FK", "Buyuksehyr": "Basaksehir FK", "Erzurum BB": "Erzurumspor FK",
    "AEK": "Athlitiki Enosi Konstantinoupoleos", "Aris": "Aris Thessalonikis", "Levadeiakos": "APO Levadiakos Football Club",
    "OFI Crete": "Omilos Filathlon Irakliou FC", "PAOK": "Panthessalonikios Athlitikos Omilos Konstantinoupoliton",
    "Volos NFC": "Volou Neos Podosferikos Syllogos", "CSKA Moscow": "PFK CSKA Moskva", "Dynamo Moscow": "FK Dinamo Moskva",
    "Lokomotiv Moscow": 'Футбольный клуб "Локомотив" Москва', "Spartak Moscow": "FK Spartak Moskva",
    "Pari NN": "FK Nizhny Novgorod", "Yenisey": "Enisey Krasnoyarsk", "Athletico-PR": "Clube Atlético Paranaense",
    "Atletico-MG": "Clube Atlético Mineiro", "Botafogo RJ": "S. A. F. Botafogo", "Flamengo RJ": "Clube de Regatas do Flamengo",
    "Mirassol": "Mirasol Futebol Clube", "Atl. San Luis": "Atlético de San Luis", "Guadalajara Chivas": "Deportivo Guadalajara",
    "GKS Katowice": "GKS GieKSa Katowice Spółka Akcyjna", "Termalica B-B.": "Termalica Bruk-Bet Nieciecza Klub Sportowy",
    "Csikszereda M. Ciuc": "FK Csikszereda Miercurea Ciuc", "Din. Bucuresti": "FC Dinamo 1948",
    "Dinamo Bucuresti": "FC Dinamo 1948", "FC Rapid Bucuresti": "FC Rapid 1923", "Poli Iasi": "ACSM Politehnica Iasi",
    "U Craiova": "Universitatea Craiova", "Univ. Craiova": "Universitatea Craiova", "U. Cluj": "FC Universitatea Cluj",
    "Viitorul Constanta": "FCV Farul Constanta",
}
SECOND_DIVISION_NAMES = {
    "QPR": "Queens Park Rangers", "Sheffield Weds": "Sheffield Wednesday", "Bristol Rvs": "Bristol Rovers",
    "Nurnberg": "1.FC Nuremberg",
}

# --- fixed values: names with no counterpart in the value source -------------
ABSENT_CLUBS = [
    "A. Lustenau", "Admira", "Mattersburg", "St. Polten", "Lausanne Ouchy", "Schaffhausen", "Vaduz", "Xamax",
    "Monarcas", "Veracruz", "America MG", "Atletico GO", "Avai", "Criciuma", "Cuiaba", "Goias", "LKS Lodz", "Leczna",
    "Legnica", "Podbeskidzie", "Ruch Chorzow", "Warta Poznan", "Academica Clinceni", "Astra", "Calarasi",
    "Chindia Targoviste", "Concordia", "FC Voluntari", "Gaz Metan Medias", "Gloria Buzau", "Mioveni", "U Craiova 1948",
    "Rodina Moscow",
]

# --- fixed values: (country, our name) -> rating-source name -----------------
RATING_NAMES = {
    ("ENG", "Nott'm Forest"): "Forest", ("ENG", "Man United"): "Man United", ("ENG", "Wolves"): "Wolves",
    ("ENG", "Sheffield United"): "Sheffield Utd", ("ENG", "West Brom"): "West Brom", ("ESP", "Ath Madrid"): "Atletico",
    ("ESP", "Ath Bilbao"): "Bilbao", ("ESP", "Espanol"): "Espanyol", ("ESP", "Sociedad"): "Sociedad",
    ("ESP", "Vallecano"): "Rayo Vallecano", ("ESP", "Betis"): "Betis", ("ESP", "Celta"): "Celta",
    ("GER", "Ein Frankfurt"): "Frankfurt", ("GER", "M'gladbach"): "Gladbach", ("GER", "Leverkusen"): "Leverkusen",
    ("GER", "Dortmund"): "Dortmund", ("GER", "Bayern Munich"): "Bayern", ("ITA", "Verona"): "Verona",
    ("FRA", "Paris SG"): "Paris SG", ("FRA", "Rennes"): "Rennes", ("POR", "Sp Lisbon"): "Sporting",
    ("NED", "PSV Eindhoven"): "PSV", ("NED", "For Sittard"): "Fortuna Sittard", ("SCO", "Hearts"): "Hearts",
    ("SCO", "Rangers"): "Rangers", ("SCO", "Celtic"): "Celtic",
}

# --- fixed values: folded external name -> our name --------------------------
ALIASES = {
    "fc bayern munchen": "Bayern Munich", "bayern": "Bayern Munich", "sc paderborn 07": "Paderborn", "sc paderborn": "Paderborn",
    "eintracht frankfurt": "Ein Frankfurt", "frankfurt": "Ein Frankfurt", "1. fc koln": "FC Koln", "hamburger sv": "Hamburg",
    "hsv": "Hamburg", "sv werder bremen": "Werder Bremen", "bremen": "Werder Bremen", "fc schalke 04": "Schalke 04",
    "schalke": "Schalke 04", "psv": "PSV Eindhoven", "fortuna sittard": "For Sittard", "sittard": "For Sittard",
    "az": "AZ Alkmaar", "racing club de lens": "Lens", "rc lens": "Lens", "paris saint-germain fc": "Paris SG",
    "psg": "Paris SG", "stade rennais fc 1901": "Rennes", "stade rennais": "Rennes", "angers sco": "Angers",
    "olympique lyonnais": "Lyon", "olympique lyon": "Lyon", "deportivo alaves": "Alaves", "alaves": "Alaves",
    "sevilla fc": "Sevilla", "rayo vallecano de madrid": "Vallecano", "rayo vallecano": "Vallecano",
    "rcd espanyol de barcelona": "Espanol", "espanyol": "Espanol", "rc deportivo la coruna": "La Coruna",
    "deportivo": "La Coruna", "club atletico de madrid": "Ath Madrid", "atleti": "Ath Madrid", "malaga cf": "Malaga",
    "malaga": "Malaga", "real betis balompie": "Betis", "real betis": "Betis", "real sociedad de futbol": "Sociedad",
    "real sociedad": "Sociedad", "athletic club": "Ath Bilbao", "athletic": "Ath Bilbao", "fc barcelona": "Barcelona",
    "barca": "Barcelona", "manchester united fc": "Man United", "manchester united": "Man United",
    "manchester city fc": "Man City", "manchester city": "Man City", "tottenham hotspur fc": "Tottenham",
    "tottenham hotspur": "Tottenham", "newcastle united fc": "Newcastle", "newcastle united": "Newcastle",
    "west ham united fc": "West Ham", "west ham united": "West Ham", "wolverhampton wanderers fc": "Wolves",
    "wolverhampton wanderers": "Wolves", "coventry city fc": "Coventry", "coventry city": "Coventry",
    "hull city afc": "Hull", "hull city": "Hull", "ipswich town fc": "Ipswich", "ipswich town": "Ipswich",
    "nottingham forest fc": "Nott'm Forest", "nottingham": "Nott'm Forest", "leeds united fc": "Leeds",
    "leeds united": "Leeds", "brighton & hove albion fc": "Brighton", "brighton hove": "Brighton", "como 1907": "Como",
    "venezia fc": "Venezia", "sport lisboa e benfica": "Benfica", "sl benfica": "Benfica",
    "sporting clube de portugal": "Sp Lisbon", "sporting cp": "Sp Lisbon", "royale union saint-gilloise": "St. Gilloise",
    "union sg": "St. Gilloise", "fc kbenhavn": "FC Copenhagen", "kbenhavn": "FC Copenhagen", "botafogo fr": "Botafogo RJ",
    "botafogo": "Botafogo RJ", "ca mineiro": "Atletico-MG", "mineiro": "Atletico-MG", "ca paranaense": "Athletico-PR",
    "paranaense": "Athletico-PR", "cr flamengo": "Flamengo RJ", "flamengo": "Flamengo RJ", "cr vasco da gama": "Vasco",
    "vasco da gama": "Vasco", "chapecoense af": "Chapecoense-SC", "chapecoense": "Chapecoense-SC", "clube do remo": "Remo",
    "coritiba fbc": "Coritiba", "cruzeiro ec": "Cruzeiro", "ec bahia": "Bahia", "ec vitoria": "Vitoria",
    "vitoria": "Vitoria", "fluminense fc": "Fluminense", "gremio fbpa": "Gremio", "gremio": "Gremio",
    "mirassol fc": "Mirassol", "rb bragantino": "Bragantino", "sc corinthians paulista": "Corinthians",
    "sc internacional": "Internacional", "se palmeiras": "Palmeiras", "santos fc": "Santos", "sao paulo fc": "Sao Paulo",
    "sao paulo": "Sao Paulo",
}

# --- fixed values: our name -> display name ----------------------------------
DISPLAY_NAMES = {
    "Man City": "Manchester City", "Man United": "Manchester United", "Nott'm Forest": "Nottingham Forest",
    "Wolves": "Wolverhampton", "West Brom": "West Bromwich Albion", "Sheffield Weds": "Sheffield Wednesday",
    "QPR": "Queens Park Rangers", "Bristol Rvs": "Bristol Rovers", "Ath Madrid": "Atlético Madrid",
    "Ath Bilbao": "Athletic Bilbao", "Espanol": "Espanyol", "Vallecano": "Rayo Vallecano",
    "La Coruna": "Deportivo La Coruña", "Sociedad": "Real Sociedad", "Betis": "Real Betis", "Sevilla": "Sevilla",
    "Celta": "Celta Vigo", "M'gladbach": "Borussia Mönchengladbach", "Ein Frankfurt": "Eintracht Frankfurt",
    "FC Koln": "FC Köln", "Werder Bremen": "Werder Bremen", "Nurnberg": "Nürnberg",
    "Fortuna Dusseldorf": "Fortuna Düsseldorf", "Paris SG": "Paris Saint-Germain", "St Etienne": "Saint-Étienne",
    "For Sittard": "Fortuna Sittard", "Sp Lisbon": "Sporting CP", "St Truiden": "Sint-Truiden",
    "St. Gilloise": "Union Saint-Gilloise", "Botafogo RJ": "Botafogo", "Atletico-MG": "Atlético Mineiro",
    "Athletico-PR": "Athletico Paranaense", "Flamengo RJ": "Flamengo", "Vasco": "Vasco da Gama", "Gremio": "Grêmio",
    "Sao Paulo": "São Paulo", "Chapecoense-SC": "Chapecoense",
}


def manual_clubs(spark: SparkSession, second_division: bool = False) -> DataFrame:
    """(team, target) for the value source."""
    names = SECOND_DIVISION_NAMES if second_division else CLUB_NAMES
    return literal_table(spark, list(names.items()), ["team", "target"])


def absent_clubs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(n,) for n in ABSENT_CLUBS], ["team"])


def manual_ratings(spark: SparkSession) -> DataFrame:
    """(block, team, target) for the rating source; the block is the country."""
    return literal_table(spark, [(c, t, n) for (c, t), n in RATING_NAMES.items()], ["block", "team", "target"])


def aliases(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(ALIASES.items()), ["alias", "target"])


def display_names(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(DISPLAY_NAMES.items()), ["team", "display"])
