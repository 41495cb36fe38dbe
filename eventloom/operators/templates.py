"""Titles of markets read into contract fields by seventeen templates, as column expressions.

A title is cleaned once; what several templates ask for (deadline, context year, label, people named) is
computed once per row, and the first template that fits gives the row's fields. Nothing is shuffled, and no
row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.plan import computed_once
from eventloom.functions.text import clean_text, join_fields
from eventloom.operators.wide import month_number

FIELDS = ["market_family", "predicate", "subject", "obj", "scope", "deadline", "season", "direction", "threshold"]

# Fixed values from here on: names, phrases and patterns that decide which contracts are the same.
PERSONS = {
    "donald_trump": ["donald trump", "trump"], "vladimir_putin": ["vladimir putin", "putin"],
    "volodymyr_zelenskyy": ["volodymyr zelenskyy", "volodymyr zelensky", "volodomyr zelenskyy", "zelenskyy", "zelensky"], "pope_leo_xiv": ["pope leo xiv", "pope leo"],
    "xi_jinping": ["xi jinping"], "nicolas_maduro": ["nicolas maduro", "maduro"], "yoon_suk_yeol": ["yoon suk yeol", "yoon"], "jerome_powell": ["jerome powell", "powell"],
    "ali_khamenei": ["ali khamenei", "khamenei"], "luiz_inacio_lula_da_silva": ["luiz inacio lula da silva", "luiz inácio lula da silva", "lula"],
}
PLACES = {"usa": "united_states", "u.s.": "united_states", "us": "united_states", "the ukraine": "ukraine", "russian federation": "russia"}
PARTIES = ["democratic party", "republican party", "conservative party", "liberal party", "green party", "new democratic party", "people's party"]
BARE_PARTIES = ["democratic", "republican"]
NBA = """atlanta|hawks boston|celtics brooklyn|nets charlotte|hornets chicago|bulls cleveland|cavaliers dallas|mavericks denver|nuggets detroit|pistons golden_state|warriors houston|rockets
    los_angeles|clippers los_angeles|lakers memphis|grizzlies miami|heat milwaukee|bucks minnesota|timberwolves new_orleans|pelicans new_york|knicks oklahoma_city|thunder orlando|magic
    philadelphia|76ers phoenix|suns portland|trail_blazers san_antonio|spurs utah|jazz washington|wizards"""
BY_NICKNAME = """arizona|cardinals las_vegas|raiders washington|commanders toronto|blue_jays seattle|mariners new_york|mets cleveland|guardians boston|bruins toronto|maple_leafs washington|capitals
    new_york|rangers nashville|predators florida|panthers tampa_bay|lightning vegas|golden_knights"""
BY_CITY = """atlanta|falcons baltimore|ravens buffalo|bills chicago|bears cincinnati|bengals cleveland|browns dallas|cowboys denver|broncos detroit|lions green_bay|packers houston|texans
    kansas_city|chiefs minnesota|vikings philadelphia|eagles pittsburgh|steelers san_francisco|49ers seattle|seahawks tampa_bay|buccaneers tennessee|titans"""
OTHER_TEAMS = {
    "los angeles d": "los_angeles_dodgers", "la dodgers": "los_angeles_dodgers", "new york y": "new_york_yankees", "ny yankees": "new_york_yankees", "indiana": "indiana_pacers", "la clippers": "los_angeles_clippers",
    "los angeles c": "los_angeles_clippers", "los angeles r": "los_angeles_rams", "new york j": "new_york_jets", "andrea kimi antonelli": "kimi_antonelli", "carlos sainz jr": "carlos_sainz", "roma": "as_roma", "ohio st": "ohio_state",
}
NBA_CITIES = {"los angeles c": "los_angeles_clippers", "los angeles l": "los_angeles_lakers", "indiana": "indiana_pacers", "sacramento": "sacramento_kings", "toronto": "toronto_raptors"}
MLB_CITIES = {"los angeles d": "los_angeles_dodgers", "new york y": "new_york_yankees", "new york m": "new_york_mets", "toronto": "toronto_blue_jays", "seattle": "seattle_mariners", "cleveland": "cleveland_guardians"}
OFFICES = [
    (r"will\s+(.+?)\s+win\s+the\s+(?:20\d{2}\s+)?new jersey gubernatorial election", "new_jersey_governor"), (r"will\s+(.+?)\s+win\s+the\s+irish presidential election", "irish_president"),
    (r"will\s+(.+?)\s+win\s+the\s+romanian presidential election", "romanian_president"), (r"will\s+(.+?)\s+be\s+the\s+next president of poland", "poland_president"),
    (r"will\s+(.+?)\s+be\s+the\s+next canadian prime minister", "canadian_prime_minister"), (r"will\s+(.+?)\s+win\s+the\s+canadian prime ministry", "canadian_prime_minister"),
    (r"will\s+(.+?)\s+be\s+appointed as the next florida senator", "florida_senator"), (r"will\s+(.+?)\s+be\s+the first elected speaker of the house", "us_house_speaker_119"),
]
ELECTIONS = {
    "new jersey governor election": "new_jersey_governor", "new jersey gubernatorial election": "new_jersey_governor", "virginia gubernatorial election": "virginia_governor", "wisconsin supreme court seat": "wisconsin_supreme_court",
    "romanian presidential election": "romanian_president", "first round of bolivian presidential election": "bolivia_president_first_round", "first round of the bolivian presidential election": "bolivia_president_first_round",
    "bolivian presidential election": "bolivia_president", "bolivia presidential election": "bolivia_president", "chilean presidential election": "chile_president", "netherlands parliamentary election": "netherlands_parliament",
    "norwegian parliamentary election": "norway_parliament", "portuguese legislative election": "portugal_parliament", "portuguese general election": "portugal_parliament", "albanian parliamentary election": "albania_parliament",
    "canadian house of commons election": "canada_federal", "canadian election": "canada_federal", "argentina election": "argentina_chamber_of_deputies", "democratic presidential nominee": "us_democratic_presidential_nominee",
    "democratic presidential nomination": "us_democratic_presidential_nominee", "democratic primary for mayor of new york city": "nyc_mayor_democratic_primary", "mayor of new york city": "nyc_mayor", "mayor of seattle": "seattle_mayor", "mayor of bucharest": "bucharest_mayor",
}
ELECTION_TITLES = [
    r"will\s+(.+?)\s+win\s+the\s+(.+?(?:election|race|seat))", r"will\s+(.+?)\s+win\s+the\s+(.+?primary\s+for\s+mayor\s+of\s+new york city)", r"will\s+(.+?)\s+win\s+the\s+election\s+for\s+the\s+(.+?)\s+in\s+20\d{2}",
    r"will\s+(.+?)\s+be\s+the\s+(.+?nominee)\s+in\s+20\d{2}", r"will\s+(.+?)\s+win\s+(.+?nomination)\s+in\s+20\d{2}",
]
LEAGUES = [
    ("formula_1_drivers_championship", "formula 1 drivers championship|drivers champion"), ("nba_finals", "nba finals|pro basketball championship"), ("nba_eastern_conference", "eastern conference"), ("nba_western_conference", "western conference"),
    ("mlb_championship", "pro baseball championship|world series|mlb"), ("mlb_american_league", "american league championship"), ("mlb_national_league", "national league championship"), ("premier_league", "premier league"), ("serie_a", "serie a"),
    ("bundesliga", "bundesliga"), ("uefa_europa_league", "europa league"), ("league_worlds", "league worlds"), ("college_football_playoff", "college football playoff national championship"), ("nhl_presidents_trophy", "president.s trophy"), ("la_liga", "la liga"),
    ("march_madness", "march madness|college basketball d1 championship"), ("uefa_champions_league", "champions league"), ("fifa_world_cup", "world cup"), ("nfl_super_bowl", "super bowl|nfl championship"), ("nhl_stanley_cup", "stanley cup|nhl"), ("masters", "masters"),
    ("us_open_golf", "us open championship"), ("the_open_golf", "the open championship"), ("pga_championship", "pga championship"), ("wimbledon_mens", "wimbledon"), ("french_open_mens", "french open men's singles championship"), ("us_open_tennis_mens", "men's us open"),
    ("us_open_tennis_womens", "us open women's tennis"), ("french_open_womens", "french open women's singles championship"), ("ryder_cup", "ryder cup"),
]
LEAGUE_TICKERS = [("march_madness", "^kxmarmad"), ("womens_march_madness", "^kxwmarmad"), ("nfl_super_bowl", "^kxsb-")]
PROPS = [
    ("nba_assists_leader", "lead", r"lead\s+the\s+nba\s+in\s+assists"), ("nba_scoring_leader", "lead", r"lead\s+the\s+nba\s+in\s+scoring"), ("nfl_mvp", "win", r"who\s+will\s+win\s+mvp|nflmvp"), ("mlb_al_mvp", "win", "al mvp"),
    ("mlb_nl_rookie_of_year", "win", "nl rookie"), ("super_bowl_halftime_headliner", "headline", r"headline\s+the\s+pro football championship halftime show"), ("emmy_drama_series", "win", "drama series at the emmy awards"),
]
POLICIES = [
    ("tiktok_ban", "ban", "tiktok (?:be )?banned|tiktok leave the app store"), ("tiktok_sale", "sale_announced", "tiktok sale announced"), ("epstein_documents", "release", "release any documents about epstein"),
    ("recession", "start", r"^(?:will\s+)?(?:(?:us|u\.s\.|united states)\s+)?recession\b|there be a recession"), ("department_of_education", "eliminate", "department of education (?:be )?eliminated|end department of education"),
    ("national_bitcoin_reserve", "create", "national bitcoin reserve|trump create bitcoin reserve"), ("aliens_exist", "confirm", "confirms? (?:that )?aliens exist"),
    ("ufo_files", "release", "(?:release|declassif(?:y|ies)) (?:new )?ufo files"), ("greenland", "acquire", "(?:buy|acquire) greenland|united states acquire any part of greenland"),
]
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?|september|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
YEAR = r"\b(20\d{2})\b"
EXITS = [
    ("resign", r"\bresigns?\b"), ("call_for_impeachment", "call for.*impeach|impeach.*call for"), ("convict_impeachment", "convict.*impeachment|impeachment.*convict"), ("impeached", r"\bbe impeached\b|\bimpeached in\b"),
    ("removed_from_office", "removed from office"), ("leave_office", r"\bout as .*(?:president|fed chair|supreme leader)\b|\bfirst leader out\b|\bout this year\b|\bout in 20\d{2}\b|\bleaves? before\b"), ("reinstated", r"\breinstated as president\b"),
]
LEADERS = [("largest_company_by_market_cap", "largest company in the world by market cap"), ("top_ai_model", "top ai model|best ai at year end|best ai in mar")]
AWARDS = [("nobel_peace_prize", "nobel peace prize"), ("best_picture_oscar", "best picture oscar"), ("top_spotify_artist", "top spotify artist")]
MEDIA = [("top_grossing_movie", "top grossing movie"), ("domestic_opening_weekend", "best domestic opening weekend"), ("eurovision", "eurovision")]
INDICATORS = [("thirty_year_fixed_mortgage_rate", "30[- ]year fixed rate mortgage|mortgage rate"), ("new_home_sales", "new home sales|new u.?s.? home sales")]
RATE_ACTS = [("hold", "no change|maintains rate|hike rates by 0bps"), ("cut", "cut|decreases"), ("hike", "hike|increases")]
ASSETS = r"\b(bitcoin|btc|ethereum|solana|\$trump|official trump)\b"
FED_LEVEL = r"upper bound of the federal funds rate be above\s+(\d+(?:\.\d+)?)%.*?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{1,2}),\s+(20\d{2})"
GAME_SLUG = r"\b(nba|nhl|mlb|nfl|cbb|cfb|cwbb)-[a-z0-9]+-[a-z0-9]+-(20\d{2}-\d{2}-\d{2})\b"
# Fixed values end here.


def _teams(listed: str) -> list[tuple[str, str]]:
    return [tuple(x.replace("_", " ").split("|")) for x in listed.split()]


def _team_aliases() -> dict[str, str]:
    """What stands for a team: its nickname or its city, as the lists above say; a full name is its own slug."""
    full = lambda c, n: f"{c} {n}".replace(" ", "_")
    return PLACES | {c: full(c, n) for c, n in _teams(BY_CITY)} | {n: full(c, n) for c, n in _teams(NBA) + _teams(BY_NICKNAME)} | OTHER_TEAMS


TEAMS = _team_aliases()
NBA_CITIES = {c: f"{c} {n}".replace(" ", "_") for c, n in _teams(NBA) if c not in ("dallas", "los angeles")} | NBA_CITIES
PARTY_NAMES = {f"{the}{p}": p.replace("'", "").replace(" ", "_") for p in PARTIES for the in ("", "the ")} | {f"{the}{p}": f"{p}_party" for p in BARE_PARTIES for the in ("", "the ")}
PERSON_NAMES = {a: n for n, aliases in PERSONS.items() for a in aliases}


def _named(names: dict[str, str], c: Column) -> Column:
    """The name an alias stands for; written as two lists, which become one literal map when the plan is made."""
    return F.map_from_arrays(F.split(F.lit("\n".join(names)), "\n"), F.split(F.lit("\n".join(names.values())), "\n"))[c]


def got(c: Column, pattern: str, group: int = 1) -> Column:
    """What the group of the first match holds; null without a match or with nothing in it."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_of(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern is found."""
    return F.coalesce(*[F.when(c.rlike(p), v) for v, p in rules])


def _slug(t: Column) -> Column:
    """slugify() of a text that is clean already."""
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_|_$", "")


def canonical_alias(c: Column, names: dict[str, str] | None = None) -> Column:
    """The name a cleaned label stands for, or its slug; null where nothing is left."""
    t = F.regexp_replace(c, r"^[ ?.,]+|[ ?.,]+$", "")
    slug = F.nullif(_slug(t), F.lit(""))
    return F.coalesce(_named(names, t), slug) if names else slug


def alias_in_text(c: Column, names: dict[str, str]) -> Column:
    """The name of the longest alias that stands in a cleaned text as whole words."""
    return F.coalesce(*[F.when(c.rlike(rf"\b\Q{a}\E\b"), names[a]) for a in sorted(names, key=len, reverse=True)])


def canonical_team(c: Column, ticker: Column, scope: Column) -> Column:
    """A team's name; cities mean the basketball or baseball team where the scope or the ticker says so."""
    t = F.regexp_replace(c, r"^[ ?.,]+|[ ?.,]+$", "")
    league = lambda x: F.coalesce(scope.startswith(x), F.lit(False)) | ticker.startswith(f"kx{x}")
    return F.coalesce(F.when(league("nba"), _named(NBA_CITIES, t)), F.when(league("mlb"), _named(MLB_CITIES, t)), canonical_alias(t, TEAMS))


def deadline_of(t: Column, year: Column) -> Column:
    """The period a title gives, in one notation; year is the context's, null if unknown. Null where it gives none."""
    day = rf"\b(before|by)\s+{MONTH}\s+(\d{{1,2}})"
    full, short, month = rf"{day},?\s+(20\d{{2}})", rf"{day}\b", rf"\bbefore\s+{MONTH}\b"
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    md = lambda p: F.concat_ws("-", two(month_number(got(t, p, 2))), two(got(t, p, 3)))
    q, y = got(t, full, 1), got(t, full, 4)
    whole = F.when((q == "before") & (md(full) == "01-01"), F.concat(F.lit("year:"), (y.cast("int") - 1).cast("string"))).when((q == "by") & (md(full) == "12-31"), F.concat(F.lit("year:"), y)).otherwise(F.concat(q, F.lit(":"), y, F.lit("-"), md(full)))
    mm = two(month_number(got(t, month)))
    return (
        F.when(t.contains("first 100 days"), "period:first_100_days").when(t.contains("first year"), "period:first_year")
        .when(t.rlike(r"\bbefore\s+20\d{2}\b"), F.concat(F.lit("year:"), (got(t, r"\bbefore\s+(20\d{2})\b").cast("int") - 1).cast("string")))
        .when(t.rlike(r"\bin\s+20\d{2}\b"), F.concat(F.lit("year:"), got(t, r"\bin\s+(20\d{2})\b")))
        .when(t.rlike(full), whole)
        .when(t.rlike(short), F.when(year.isNull(), F.concat(got(t, short, 1), F.lit("_month_day:"), md(short))).otherwise(F.concat(got(t, short, 1), F.lit(":"), year, F.lit("-"), md(short))))
        .when(t.rlike(month), F.when(year.isNull(), F.concat(F.lit("before_month:"), mm)).otherwise(F.concat(F.lit("before:"), year, F.lit("-"), mm, F.lit("-01"))))
    )


def deadline_from_ticker(ticker: Column) -> Column:
    return F.concat(F.lit("year:20"), F.coalesce(got(ticker, r"-(\d{2})-?dec31"), got(ticker, r"-(\d{2})(?:-|$)")))


def context_year(dates: list[Column]) -> Column:
    """The first year 20xx in the dates, in their order."""
    return F.coalesce(*[got(d.cast("string"), YEAR) for d in dates])


def plain_price(c: Column) -> Column:
    """A figure without grouping marks, and without a fraction of nothing but zeros."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"\.0*$", "")


def election_scope(phrase: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(phrase, r"\b20\d{2}\b|\b(?:the|next|following|after)\b", ""), r"\s+", " ")
    p = F.regexp_replace(p, r"^[ ?.,]+|[ ?.,]+$", "")
    return F.coalesce(*[F.when(p.contains(a), v) for a, v in ELECTIONS.items()], F.nullif(_slug(F.replace(p, F.lit(" election"), F.lit(""))), F.lit("")))


def _is(ok: Column, family: str, confidence: float, reason: str, **fields: Column | str | None) -> Column:
    """A template's record where it fits, else null."""
    value = lambda f: F.lit(f) if isinstance(f, str) else F.lit(None).cast("string") if f is None else f
    cols = [F.coalesce(value(fields.get(f) if f != "market_family" else family).cast("string"), F.lit("")).alias(f) for f in FIELDS]
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*cols, F.lit(confidence).alias("parse_confidence"), F.lit(reason).alias("parse_reason")))


def _leader_contact(r: SimpleNamespace) -> Column:
    meet = r.t.contains("meet with")
    ok = ~r.t.rlike(r"\b(first|next)\b") | r.t.rlike(r"\bwill\s+.+\s+(meet with|visit)\b")
    before = alias_in_text(F.when(meet, F.substring_index(r.t, "meet with", 1)).otherwise(F.substring_index(r.t, "visit", 1)), PERSON_NAMES)
    host = alias_in_text(got(r.t, "meet with(.*)$"), PERSON_NAMES)
    who = F.coalesce(before, F.when(~meet & r.t.contains("trump"), "donald_trump"))
    where = canonical_alias(got(r.t, r"\bvisit\s+([a-z.\- ]+?)(?:\s+in\b|\s+before\b|\s+by\b|\?|$)"), PLACES)
    a, b = F.when(meet, F.least(who, host)).otherwise(who), F.when(meet, F.greatest(who, host)).otherwise(where)
    both = who.isNotNull() & F.when(meet, host).otherwise(where).isNotNull()
    return _is((meet | r.t.contains("visit")) & ok & both, "leader_contact", 0.92, "leader contact template", predicate=F.when(meet, "meet").otherwise("visit"), subject=a, obj=b, deadline=r.deadline)


def _office_exit(r: SimpleNamespace) -> Column:
    act = first_of(r.t, EXITS)
    return _is(r.person.isNotNull() & act.isNotNull(), "office_exit", 0.88, "office exit template", predicate=act, subject=r.person, deadline=F.coalesce(r.deadline, F.when(r.t.contains("this year"), F.concat(F.lit("year:"), r.year))))


def _election(r: SimpleNamespace) -> Column:
    season = F.coalesce(r.stated_year, F.replace(r.deadline, F.lit("year:"), F.lit("")))
    nyc = r.t.contains("nyc mayor") | r.t.contains("new york city mayor")
    held, called = r.t.contains("ukraine") & r.t.contains("presidential election"), r.t.contains("ukraine election called")
    party, candidate = got(r.t, r"representative of the (.+?) party"), got(r.t, r"will\s+(.+?)\s+win\s+the\s+20\d{2}\s+nyc mayor")
    scope = F.when(held | called, "ukraine_presidential").when(party.isNotNull(), "nyc_mayor_party_line").otherwise("nyc_mayor_candidate")
    subject = F.when(held | called, F.coalesce(alias_in_text(r.t, PARTY_NAMES), r.person)).otherwise(canonical_alias(F.coalesce(party, candidate, r.sub)))
    ok = (r.t.contains("election") | r.t.contains("mayor race")) & (held | called | nyc)
    return _is(ok, "election", 0.86, "election template", predicate=F.when(held, "hold_election").when(called, "election_called").otherwise("win"), subject=subject, scope=scope, deadline=F.coalesce(r.deadline, F.concat(F.lit("year:"), season)), season=season)


def _candidate_office(r: SimpleNamespace) -> Column:
    nominee = r.t.contains("nominee for the nyc mayorship")
    ministry = r.t.contains("win the canadian prime ministry") & r.outcome.isNotNull()
    subject = F.when(nominee, canonical_alias(r.label)).when(ministry, canonical_alias(r.label, PARTY_NAMES)).otherwise(F.coalesce(*[canonical_alias(got(r.t, p)) for p, _ in OFFICES]))
    scope = F.when(nominee, F.when(r.t.contains("democratic party"), "nyc_mayor_democratic_nominee").otherwise("nyc_mayor_nominee")).when(ministry, "canadian_prime_minister").otherwise(first_of(r.t, [(s, p) for p, s in OFFICES]))
    season = F.coalesce(r.stated_year, F.when(nominee, "2025"))
    return _is(subject.isNotNull() & scope.isNotNull(), "election", 0.84, "candidate office template", predicate=F.when(nominee, "nominee").otherwise("win"), subject=subject, scope=scope, deadline=F.coalesce(r.deadline, F.concat(F.lit("year:"), season)), season=season)


def _election_winner(r: SimpleNamespace) -> Column:
    seats, majority, who = r"will\s+(.+?)\s+win\s+the\s+most seats\s+in\s+the\s+(.+?election)", r"(.+?)\s+win\s+majority\s+in\s+(.+?election)", r"who\s+will\s+win\s+the\s+(.+?election)"
    named = [(p, canonical_alias(got(r.t, p), PARTY_NAMES), election_scope(got(r.t, p, 2))) for p in (seats, *ELECTION_TITLES)]
    asked = r.t.rlike(who) & r.label.isNotNull()
    ministry = r.t.contains("win the canadian prime ministry") & r.label.isNotNull()
    label = canonical_alias(r.label, PARTY_NAMES)
    none = ~reduce(lambda a, b: a | b, [r.t.rlike(p) for p, *_ in named])
    rest = F.when(asked, F.struct(label.alias("s"), election_scope(got(r.t, who)).alias("w"))).when(r.t.rlike(majority), F.struct(canonical_alias(got(r.t, majority), PARTY_NAMES).alias("s"), election_scope(got(r.t, majority, 2)).alias("w")))
    rest = F.coalesce(rest, F.when(ministry, F.struct(label.alias("s"), F.lit("canadian_prime_minister").alias("w"))))
    found = F.coalesce(*[F.when(r.t.rlike(p), F.struct(s.alias("s"), w.alias("w"))) for p, s, w in named], rest)
    act = F.when(r.t.rlike(seats), "win_most_seats").when(none & ~asked & r.t.rlike(majority), "win_majority").otherwise("win")
    season = F.coalesce(r.stated_year, F.replace(r.deadline, F.lit("year:"), F.lit("")), r.year)
    return _is(found["s"].isNotNull() & found["w"].isNotNull(), "election", 0.78, "generic election winner template", predicate=act, subject=found["s"], scope=found["w"], deadline=F.coalesce(r.deadline, F.concat(F.lit("year:"), season)), season=season)


def _sports_game(r: SimpleNamespace) -> Column:
    slug = GAME_SLUG
    nfl = r"kxnflgame-(\d{2})([a-z]{3})(\d{2})"
    scope = F.coalesce(F.concat(got(r.slug, slug), F.lit("_game")), F.when(r.ticker.rlike(nfl), "nfl_game"), F.when(r.t.rlike(r"\b.+?\s+vs\.?\s+.+?\b"), "generic_head_to_head"))
    of_ticker = F.concat_ws("-", F.concat(F.lit("20"), got(r.ticker, nfl)), F.lpad(F.coalesce(month_number(got(r.ticker, nfl, 2)), F.lit(0)).cast("string"), 2, "0"), got(r.ticker, nfl, 3))
    date = F.coalesce(got(r.slug, slug, 2), F.when(r.ticker.rlike(nfl), of_ticker))
    teams, beat = r"(.+?)\s+vs\.?\s+(.+?)(?:\s+\(|\s+-|\?|$)", r"will\s+(.+?)\s+beat\s+(.+?)(?:\s+by\b|\?|$)"
    team = lambda c: canonical_team(c, r.ticker, scope)
    chosen = team(r.label)
    subject = F.coalesce(chosen, team(got(r.t, beat)))
    pair = [F.when(chosen.isNull(), team(got(r.t, beat, g))).otherwise(team(got(r.t, teams, g))) for g in (1, 2)]
    return _is(scope.isNotNull() & subject.isNotNull() & pair[0].isNotNull() & pair[1].isNotNull(), "sports_game", 0.82, "sports game winner template", predicate="win", subject=subject, obj=F.array_join(F.array_sort(F.array(*pair)), "__"), scope=scope, deadline=date, season=F.substring(date, 1, 4))


def _sports_prop(r: SimpleNamespace) -> Column:
    scope, act = first_of(r.t, [(s, p) for s, _, p in PROPS]), first_of(r.t, [(a, p) for _, a, p in PROPS])
    subject = F.coalesce(canonical_team(r.label, r.ticker, F.lit("")), canonical_alias(got(r.t, r"will\s+(.+?)\s+lead\s+the\s+nba")))
    return _is(scope.isNotNull() & subject.isNotNull(), "sports_prop", 0.76, "sports award/prop template", predicate=act, subject=subject, scope=scope, season=F.coalesce(r.stated_year, r.year))


def _sports(r: SimpleNamespace) -> Column:
    act = F.when(r.t.contains("qualify"), "qualify").when(r.t.rlike(r"\bwins?\b|drivers champion"), "win")
    scope = F.coalesce(first_of(r.t, LEAGUES), first_of(r.ticker, LEAGUE_TICKERS))
    team = lambda p, ok=F.lit(True): F.when(ok, canonical_team(got(r.t, p), r.ticker, scope))
    subject = F.coalesce(
        team(r"will\s+(?:the\s+)?(.+?)\s+win\s+the\b"), team(r"will\s+(?:the\s+)?(.+?)\s+be\s+the\s+(?:20\d{2}\s+)?drivers champion", scope == "formula_1_drivers_championship"),
        team(r"^(.+?)\s+wins?\s+the\b", act == "win"), team(r"will\s+(?:the\s+)?(.+?)\s+qualify\b", act == "qualify"), canonical_team(F.coalesce(r.sub, r.outcome), r.ticker, scope),
    )
    season = F.coalesce(r.stated_year, F.concat(F.lit("20"), got(r.ticker, r"-(\d{2})(?:-|$)")))
    return _is(act.isNotNull() & scope.isNotNull(), "sports", 0.86, "sports outcome template", predicate=act, subject=subject, scope=scope, season=season)


def _fed(r: SimpleNamespace) -> Column:
    return r.t.contains("fed") | r.t.contains("federal reserve")


def _fed_count(r: SimpleNamespace) -> Column:
    times, happen = r"fed\s+cut\s+rates?\s+(\d+)\s+times?", r"will\s+(no|\d+\+?)\s+fed\s+rate\s+cuts?\s+happen\s+in\s+20\d{2}"
    said = F.coalesce(got(r.t, times), got(r.t, happen))
    season = F.coalesce(r.stated_year, F.replace(deadline_from_ticker(r.ticker), F.lit("year:"), F.lit("")))
    direction = F.when(got(r.t, times).isNull() & said.endswith("+"), "at_least").otherwise("equal")
    return _is(_fed(r) & said.isNotNull(), "fed_count", 0.82, "fed rate cut count template", predicate="cut", scope=F.when(r.t.contains("emergency"), "fed_emergency_rate_cuts").otherwise("fed_rate_cuts"), season=season, direction=direction, threshold=F.when(said == "no", "0").otherwise(F.regexp_replace(said, r"\+", "")))


def _fed_level(r: SimpleNamespace) -> Column:
    p = FED_LEVEL
    day = F.concat_ws("-", got(r.t, p, 4), F.lpad(month_number(got(r.t, p, 2)).cast("string"), 2, "0"), F.lpad(got(r.t, p, 3), 2, "0"))
    return _is(r.t.rlike(p), "fed_rate_level", 0.8, "fed funds level template", predicate="upper_bound", scope=F.concat(F.lit("fed_meeting:"), day), direction="above", threshold=got(r.t, p))


def _fed_decision(r: SimpleNamespace) -> Column:
    meeting, listed = rf"\b{MONTH}\s+(20\d{{2}})\s+meeting", r"feddecision-(\d{2})([a-z]{3})"
    two = lambda c: F.lpad(F.coalesce(month_number(c), F.lit(0)).cast("string"), 2, "0")
    when = F.when(r.t.rlike(meeting), F.concat(got(r.t, meeting, 2), F.lit("-"), two(got(r.t, meeting)))).when(r.ticker.rlike(listed), F.concat(F.lit("20"), got(r.ticker, listed), F.lit("-"), two(got(r.ticker, listed, 2))))
    act = first_of(r.t, RATE_ACTS)
    direction = F.when(act == "hold", "hold").when(r.t.rlike("[>+]"), "greater_than").otherwise("equal")
    size = F.when(act == "hold", "0").otherwise(got(r.t, r"by\s+(?:>=?)?\s*(\d+)\s*bps"))
    return _is(_fed(r) & when.isNotNull() & act.isNotNull(), "fed_decision", 0.86, "fed decision template", predicate=act, scope=F.concat(F.lit("fed_meeting:"), when), direction=direction, threshold=size)


def _asset(r: SimpleNamespace) -> Column:
    said = got(r.t, ASSETS)
    return F.when(said == "btc", "bitcoin").when(said.isin("$trump", "official trump"), "official_trump").otherwise(said)


def _asset_race(r: SimpleNamespace) -> Column:
    ok = _asset(r).isNotNull() & r.t.rlike(r"hit\s+\$?[\d.]+\s*k?\s+or\s+\$?[\d.]+\s*k?\s+first")
    return _is(ok, "asset_threshold_race", 0.8, "asset threshold race template", predicate="hit_first", subject=_asset(r), threshold=canonical_alias(F.replace(r.outcome, F.lit("$"), F.lit(""))), deadline=r.deadline)


def _asset_threshold(r: SimpleNamespace) -> Column:
    ladder, dip, reach = r"how\s+(high|low)\s+will\s+(?:bitcoin|btc|ethereum|solana)\s+get", r"\bdip\s+to\s+\$?([\d,]+)", r"(?:reach|hit)\s+\$?([\d,]+)"
    on_ladder = r.t.rlike(ladder)
    figure = F.when(on_ladder, got(r.sub, r"\$?([\d,]+(?:\.\d+)?)")).otherwise(F.coalesce(got(r.t, dip), got(r.t, reach)))
    direction = F.when(on_ladder, F.when(got(r.t, ladder) == "high", "above").otherwise("below")).when(r.t.rlike(dip), "below").otherwise("above")
    reason = F.when(on_ladder, "asset threshold ladder template").when(r.t.rlike(dip), "asset below threshold template").otherwise("asset threshold template")
    made = _is(_asset(r).isNotNull() & figure.isNotNull(), "asset_threshold", 0.82, "", predicate="threshold", subject=_asset(r), threshold=plain_price(figure), deadline=F.coalesce(r.deadline, F.when(on_ladder, deadline_from_ticker(r.ticker))), direction=direction)
    return F.when(made.isNotNull(), made.withField("parse_reason", reason))


def _market_leader(r: SimpleNamespace) -> Column:
    scope = first_of(r.t, LEADERS)
    subject = canonical_alias(F.coalesce(r.label, F.when(scope == "top_ai_model", got(r.t, r"will\s+(.+?)\s+have\s+the\s+top ai model")).otherwise(got(r.t, r"will\s+(.+?)\s+be\s+the\s+largest company"))))
    return _is(scope.isNotNull() & subject.isNotNull(), "market_leader", 0.78, "market leader template", predicate="lead", subject=subject, scope=scope, deadline=F.coalesce(r.deadline, deadline_from_ticker(r.ticker)), season=F.coalesce(r.stated_year, r.year))


def _geopolitics(r: SimpleNamespace) -> list[Column]:
    truce = r.t.contains("ceasefire")
    made = lambda ok, c, why, p, s, o: _is(ok, "geopolitical_event", c, f"{why} template", predicate=p, subject=s, obj=o, deadline=r.deadline)
    return [
        made(truce & r.t.contains("ukraine"), 0.8, "ceasefire", "ceasefire", "russia", "ukraine"), made(truce & r.t.rlike(r"israel\s*x\s*hamas"), 0.8, "ceasefire", "ceasefire", "israel", "hamas"),
        made(r.t.rlike("china invades? taiwan"), 0.8, "invasion", "invade", "china", "taiwan"), made(r.t.rlike("trump ends? ukraine war|ends? (?:the )?war in ukraine"), 0.78, "war-end", "end_war", "donald_trump", "ukraine_war"),
        made(r.t.rlike("ukraine agrees? to trump mineral deal"), 0.78, "mineral deal", "agreement", "ukraine", "trump_mineral_deal"),
    ]


def _policy(r: SimpleNamespace) -> list[Column]:
    when = F.coalesce(r.deadline, deadline_of(F.coalesce(r.sub, F.lit("")), r.year), deadline_from_ticker(r.ticker))
    state = got(r.t, r"\b(texas|north carolina)\s+strategic bitcoin reserve act")
    subject, act = first_of(r.t, [(s, p) for s, _, p in POLICIES]), first_of(r.t, [(a, p) for _, a, p in POLICIES])
    return [
        _is(state.isNotNull(), "policy_action", 0.8, "state bitcoin reserve law template", predicate="pass_law", subject="strategic_bitcoin_reserve_act", obj=_slug(state), deadline=when),
        _is(subject.isNotNull(), "policy_action", 0.78, "policy action template", predicate=act, subject=subject, obj="united_states", deadline=when),
    ]


def _award(r: SimpleNamespace) -> Column:
    scope = first_of(r.t, AWARDS)
    subject = F.coalesce(canonical_alias(r.label), canonical_alias(got(r.t, r"will\s+(.+?)\s+win")))
    return _is(scope.isNotNull() & subject.isNotNull(), "award", 0.82, "award winner template", predicate="win", subject=subject, scope=scope, season=F.coalesce(r.stated_year, r.year))


def _media(r: SimpleNamespace) -> Column:
    scope = first_of(r.t, MEDIA)
    named = F.when(scope == "eurovision", got(r.t, r"will\s+(.+?)\s+win\s+eurovision")).when(scope == "domestic_opening_weekend", got(r.t, r"will\s+['\"]?(.+?)['\"]?\s+have\s+the\s+best domestic opening weekend")).otherwise(got(r.t, r"will\s+(.+?)\s+be\s+the\s+top grossing movie"))
    subject = canonical_alias(F.coalesce(r.label, named))
    return _is(scope.isNotNull() & subject.isNotNull(), "media", 0.8, "media winner template", predicate="win", subject=subject, scope=scope, season=F.coalesce(r.stated_year, r.year))


def _economy(r: SimpleNamespace) -> Column:
    scope = first_of(r.t, INDICATORS)
    ok = r.t.rlike(r"\babove\b|\bbelow\b|\breach\b") & scope.isNotNull()
    figure = F.replace(got(r.t, r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*%?"), F.lit(","), F.lit(""))
    return _is(ok, "economic_threshold", 0.84, "economic threshold template", predicate="threshold", scope=scope, deadline=r.deadline, direction=F.when(r.t.contains("above"), "above").when(r.t.contains("below"), "below"), threshold=figure)


#: In the order in which they are tried.
TEMPLATES = [_leader_contact, _office_exit, _election, _candidate_office, _election_winner, _sports_game, _sports_prop, _sports, _fed_count, _fed_level, _fed_decision, _asset_race, _asset_threshold, _market_leader, _geopolitics, _policy, _award, _media, _economy]


def parse_contracts(markets: DataFrame, *, title: Column, outcome: Column, yes_sub_title: Column, slug: Column, ticker: Column, dates: list[Column]) -> DataFrame:
    """Adds the contract fields, contract_key, entity_signature, parse_confidence and parse_reason to every market.

    An outcome of Yes or No names nobody and is passed over. Null texts are empty; a title that no template
    fits has empty fields, confidence 0 and the reason "no supported template". No row is dropped.
    """
    text = lambda c: F.nullif(clean_text(c), F.lit(""))
    named = F.when(~text(outcome).isin("yes", "no"), text(outcome))
    df = computed_once(markets, __t=clean_text(title), __outcome=named, __sub=text(yes_sub_title), __slug=clean_text(slug), __ticker=clean_text(ticker), __year=context_year(dates))
    df = computed_once(df, __deadline=deadline_of(F.col("__t"), F.col("__year")), __person=alias_in_text(F.col("__t"), PERSON_NAMES), __stated_year=got(F.col("__t"), YEAR), __label=F.coalesce("__outcome", "__sub"))
    r = SimpleNamespace(**{n: F.col(f"__{n}") for n in ("t", "outcome", "sub", "slug", "ticker", "year", "deadline", "person", "stated_year", "label")})
    tried: list[Column] = []
    for template in TEMPLATES:
        made = template(r)
        tried += made if isinstance(made, list) else [made]
    nothing = F.struct(*[F.lit("").alias(f) for f in FIELDS], F.lit(0.0).alias("parse_confidence"), F.lit("no supported template").alias("parse_reason"))
    df = computed_once(df, __found=F.coalesce(*tried, nothing))
    field = lambda f: F.col(f"__found.{f}")
    key, signature = join_fields([field(f) for f in FIELDS]), join_fields([field(f) for f in FIELDS if f != "deadline"])
    return df.select(*markets.columns, *[field(f).alias(f) for f in FIELDS], key.alias("contract_key"), signature.alias("entity_signature"), field("parse_confidence").alias("parse_confidence"), field("parse_reason").alias("parse_reason"))


def expand_outcomes(markets: DataFrame, outcomes: Column, tokens: Column) -> DataFrame:
    """One row per outcome as a binary market of its own; Yes/No markets and those without outcomes stay one row.

    Adds outcome_index (null without outcomes), outcome_name, token_id (null where there are fewer tokens) and synthetic_binary.
    """
    df = computed_once(markets, __o=outcomes, __k=tokens)
    lower = F.transform("__o", lambda x: clean_text(x))
    binary = F.coalesce((F.size(lower) == 2) & (F.get(lower, F.lit(0)) == "yes") & (F.get(lower, F.lit(1)) == "no"), F.lit(False))
    one = F.struct(F.when(binary, 0).alias("i"), F.when(binary, "Yes").otherwise("").alias("n"), F.lit(False).alias("b"))
    many = F.transform("__o", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("n"), F.lit(True).alias("b")))
    each = df.withColumn("__e", F.explode(F.when(binary | (F.size("__o") < 1), F.array(one)).otherwise(many)))
    return each.select(*markets.columns, F.col("__e.i").alias("outcome_index"), F.col("__e.n").alias("outcome_name"), F.get("__k", F.coalesce("__e.i", F.lit(0))).alias("token_id"), F.col("__e.b").alias("synthetic_binary"))
