"""Titles read by the templates: one that fits and one near miss each."""

from pyspark.sql import functions as F

from eventloom.functions.text import list_of
from eventloom.operators.templates import expand_outcomes, parse_contracts

# title, outcome, yes sub title, slug, ticker, end date -> contract key
CASES = [
    ("Will Trump meet with Vladimir Putin before 2026?", None, None, None, None, None, "leader_contact|meet|donald_trump|vladimir_putin|year:2025"),
    ("Will Vladimir Putin meet with Trump in 2025?", "Yes", None, None, None, None, "leader_contact|meet|donald_trump|vladimir_putin|year:2025"),
    ("Will Putin meet with Trump in first 100 days?", None, None, None, None, None, "leader_contact|meet|donald_trump|vladimir_putin|period:first_100_days"),
    ("Who will Trump meet with first?", None, None, None, None, None, ""),
    ("Will Trump visit the Ukraine by March 3?", None, None, None, None, "2025-06-01", "leader_contact|visit|donald_trump|ukraine|by:2025-03-03"),
    ("Yoon out as president before July?", None, None, None, None, "2025-12-31", "office_exit|leave_office|yoon_suk_yeol|before:2025-07-01"),
    ("Maduro out this year?", None, None, None, None, "2025-12-31", "office_exit|leave_office|nicolas_maduro|year:2025"),
    ("Will Powell speak in 2025?", None, None, None, None, None, ""),
    ("Will Zohran Mamdani win the 2025 NYC mayoral election?", None, None, None, None, None, "election|win|zohran_mamdani|nyc_mayor_candidate|year:2025|2025"),
    ("Will Ukraine hold a presidential election in 2025?", None, None, None, None, None, "election|hold_election|ukraine_presidential|year:2025|2025"),
    ("Will Ann Lee win the Irish presidential election?", None, None, None, None, None, "election|win|ann_lee|irish_president"),
    ("Will the Liberal Party win the most seats in the Canadian election?", None, None, None, None, "2025-05-01", "election|win_most_seats|liberal_party|canada_federal|year:2025|2025"),
    ("Who will win the Chilean presidential election?", None, "Jo Kast", None, None, "2025-11-16", "election|win|jo_kast|chile_president|year:2025|2025"),
    ("Will Ann Lee win the chess match?", None, None, None, None, None, ""),
    ("Hawks vs. Celtics", "Hawks", None, "nba-atl-bos-2025-03-24", None, None, "sports_game|win|atlanta_hawks|atlanta_hawks__boston_celtics|nba_game|2025-03-24|2025"),
    ("Dallas vs Houston", None, "Dallas", None, "KXNFLGAME-25SEP07DALHOU-DAL", None, "sports_game|win|dallas_cowboys|dallas_cowboys__houston_texans|nfl_game|2025-09-07|2025"),
    ("Will anyone lead the NBA in scoring?", None, "Luka Doncic", None, None, "2025-04-13", "sports_prop|lead|luka_doncic|nba_scoring_leader|2025"),
    ("Will the Denver Nuggets win the 2025 NBA Finals?", None, None, None, None, None, "sports|win|denver_nuggets|nba_finals|2025"),
    ("Will Denver win the NBA Finals?", None, None, None, "KXNBA-25-DEN", None, "sports|win|denver_nuggets|nba_finals|2025"),
    ("Will Denver draw in the NBA Finals?", None, None, None, None, None, ""),
    ("Will the Fed cut rates 3 times?", None, None, None, "KXRATECUTCOUNT-25DEC31-T3", None, "fed_count|cut|fed_rate_cuts|2025|equal|3"),
    ("Will 4+ Fed rate cuts happen in 2025?", None, None, None, None, None, "fed_count|cut|fed_rate_cuts|2025|at_least|4"),
    ("Will the upper bound of the federal funds rate be above 4.25% following the Fed's Sep 17, 2025 meeting?", None, None, None, None, None, "fed_rate_level|upper_bound|fed_meeting:2025-09-17|above|4.25"),
    ("Fed decreases interest rates by 25 bps after March 2025 meeting?", None, None, None, None, None, "fed_decision|cut|fed_meeting:2025-03|equal|25"),
    ("Fed speaks after March 2025 meeting?", None, None, None, None, None, ""),
    ("Will Bitcoin hit $80k or $100k first?", "$100k", None, None, None, None, "asset_threshold_race|hit_first|bitcoin|100k"),
    ("Will BTC reach $120,000 by December 31, 2025?", None, None, None, None, None, "asset_threshold|threshold|bitcoin|year:2025|above|120000"),
    ("How high will Bitcoin get this year?", None, "$125,000.00 or above", None, "KXBTCMAXY-25-DEC31", None, "asset_threshold|threshold|bitcoin|year:2025|above|125000"),
    ("How high will Bitcoin get this year?", None, "very", None, "KXBTCMAXY-25-DEC31", None, ""),
    ("Largest company in the world by market cap on Dec 31?", "Nvidia", None, None, None, "2025-12-31", "market_leader|lead|nvidia|largest_company_by_market_cap|2025"),
    ("Will China invade Taiwan in 2025?", None, None, None, None, None, "geopolitical_event|invade|china|taiwan|year:2025"),
    ("Russia x Ukraine ceasefire before 2026?", None, None, None, None, None, "geopolitical_event|ceasefire|russia|ukraine|year:2025"),
    ("US recession in 2025?", None, None, None, None, None, "policy_action|start|recession|united_states|year:2025"),
    ("Will there be a depression in 2025?", None, None, None, None, None, ""),
    ("Nobel Peace Prize winner?", "Greta T.", None, None, None, "2025-10-10", "award|win|greta_t|nobel_peace_prize|2025"),
    ("Will Sweden win Eurovision 2025?", None, None, None, None, None, "media|win|sweden|eurovision|2025"),
    ("Will new home sales be above 700,000 in 2025?", None, None, None, None, None, "economic_threshold|threshold|new_home_sales|year:2025|above|700000"),
    ("Will new home sales grow?", None, None, None, None, None, ""),
    (None, None, None, None, None, None, ""),
    ("", "", "", "", "", "", ""),
]


def test_templates(spark):
    names = ["title", "outcome", "sub", "slug", "ticker", "end", "want"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, " + ", ".join(f"{n} string" for n in names))
    c = F.col
    got = {r.i: r for r in parse_contracts(df, title=c("title"), outcome=c("outcome"), yes_sub_title=c("sub"), slug=c("slug"), ticker=c("ticker"), dates=[c("end")]).collect()}
    wrong = [(r.title, r.contract_key, r.want) for r in got.values() if r.contract_key != r.want]
    assert len(got) == len(CASES) and not wrong, wrong
    assert got[0].entity_signature == "leader_contact|meet|donald_trump|vladimir_putin" and got[3].parse_reason == "no supported template"


def test_expand_outcomes(spark):
    rows = [(1, '["Yes", "No"]', '["a", "b"]'), (2, "['Red', 'Blue', 'Green']", '["x", "y"]'), (3, "", None), (4, None, '["t"]'), (5, "broken[", "[]")]
    df = spark.createDataFrame(rows, "id int, outcomes string, tokens string")
    got = [(r.id, r.outcome_index, r.outcome_name, r.token_id, r.synthetic_binary) for r in expand_outcomes(df, list_of(F.col("outcomes")), list_of(F.col("tokens"))).orderBy("id", "outcome_index").collect()]
    assert got == [(1, 0, "Yes", "a", False), (2, 0, "Red", "x", True), (2, 1, "Blue", "y", True), (2, 2, "Green", None, True), (3, None, "", None, False), (4, None, "", "t", False), (5, None, "", None, False)]
