"""Indicator columns, text, date and skill features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from adlake import rules
from adlake.functions import dates, features, text
from adlake.operators import encode, rule_table, terms
from adlake.plans import roles
from adlake.plans.registry import query
from adlake.plans.roles import LISTING, POSTINGS, TODAY

LETTERS = r"\p{L}\p{N}_"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("collapse_rare", """WITH shares AS (
        SELECT role, count(*)::DOUBLE / (SELECT count(*) FROM conversations) AS share
        FROM conversations GROUP BY role)
    SELECT conv_id, turn, CASE WHEN share >= 0.05 THEN c.role ELSE 'other' END AS role
    FROM conversations c JOIN shares s ON c.role = s.role""")
def collapse_rare(t):
    return encode.collapse_rare(t.conversations.select("conv_id", "turn", "role"), ["role"])


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "SELECT o_orderkey AS uid, " + ", ".join(
    f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"level_{v}\"" for v in LEVELS) + " FROM orders")
def one_hot(t):
    ads = roles.postings(t).select("uid", "level")
    values = encode.indicator_values(ads, "level")
    return encode.one_hot(ads, {"level": values})[0].drop("level")


TYPE_WORDS = ["economy", "large", "medium", "promo", "small", "standard"]


@query("multi_hot", "SELECT p_partkey, " + ", ".join(
    f"CAST('{w}' IN (lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS INTEGER)"
    f" AS ind_{w}" for w in TYPE_WORDS) + " FROM part")
def multi_hot(t):
    words = F.split("p_name", " ")
    parts = t.part.select("p_partkey", F.lower("p_type").alias("indtype0"),
                          F.get(words, 0).alias("indtype1"), F.get(words, 1).alias("indtype2"))
    values = encode.indicator_values(parts, "indtype0")
    return encode.multi_hot(parts, ["indtype0", "indtype1", "indtype2"], values, "ind").drop(
        "indtype0", "indtype1", "indtype2")


ROLE_NAMES = {"ECONOMY": "economy class", "small": "little", "bolt": "fastener"}


def _mapped(expression: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_NAMES.items())
    return f"CASE {expression} {cases} ELSE {expression} END"


@query("first_three", "WITH lists AS (SELECT p_partkey, string_split("
       "p_type || '>[' || replace(p_name, ' ', ']>''') || '''', '>') AS l FROM part) SELECT p_partkey, "
       + ", ".join(_mapped(f"regexp_replace(l[{i + 1}], '[\\[\\]'']', '', 'g')") + f" AS jobrole{i}"
                   for i in range(3)) + " FROM lists")
def first_three(t):
    quoted = F.concat(F.replace("p_name", F.lit(" "), F.lit("]>'")), F.lit("'"))
    lists = t.part.select("p_partkey", F.concat("p_type", F.lit(">["), quoted).alias("roles"))
    return encode.first_items(lists, "roles", "jobrole", 3, ROLE_NAMES).drop("roles")


@query("member_flags", f"""WITH {POSTINGS}, p AS (SELECT uid, nullif(level, '5-LOW') AS level FROM postings)
    SELECT uid, CAST(coalesce(level IN ('1-URGENT', '2-HIGH'), false) AS INTEGER) AS exp_management,
        CAST(coalesce(level = '3-MEDIUM', false) AS INTEGER) AS exp_entrylevel FROM p""")
def member_flags(t):
    ads = roles.postings(t).withColumn("level", F.nullif("level", F.lit("5-LOW")))
    return ads.select("uid", features.member_flag(F.col("level"), ["1-URGENT", "2-HIGH"]).alias("exp_management"),
                      features.member_flag(F.col("level"), ["3-MEDIUM"]).alias("exp_entrylevel"))


def amounts(t):
    """Ads with the amount as text: '112,946.26', 'ask' where the level is low, null where
    the ad is gone."""
    return roles.postings(t).select(
        "uid", F.when(F.col("stat") == "NOT FOUND", None)
        .when(F.col("level") == "5-LOW", "ask")
        .otherwise(F.format_number("compensation", 2)).alias("amount"))


AMOUNTS = POSTINGS + """, amounts AS (SELECT uid, CASE WHEN stat = 'NOT FOUND' THEN NULL
    WHEN level = '5-LOW' THEN 'ask' ELSE format('{:,.2f}', compensation) END AS amount FROM postings)"""


@query("compensation", f"""WITH {AMOUNTS}, parsed AS (
        SELECT uid, try_cast(replace(amount, ',', '') AS DOUBLE) AS v FROM amounts)
    SELECT uid, CAST(v IS NOT NULL AS INTEGER) AS has_comp,
        CAST(coalesce(v >= 50000, false) AS INTEGER) AS has_credible_comp,
        CASE WHEN v >= 50000 THEN v END AS comp FROM parsed""")
def compensation(t):
    columns = features.compensation(F.col("amount"), credible_from=50000)
    return amounts(t).select("uid", *[c.alias(n) for n, c in columns.items()])


LADDER = {"diploma": ["license", "licensed"], "bachelors": [r"pf(\.){0,1}ein", "that"],
          "masters": ["les", "la(s){0,1}"], "doctorate": ["und"]}


def whole_word_sql(column: str, words: str) -> str:
    return f"regexp_matches({column}, '(^|[^{LETTERS}])({words})($|[^{LETTERS}])')"


@query("education_ladder", "SELECT doc_id, CASE WHEN source IN ('diploma', 'masters') THEN source "
       + " ".join(f"WHEN {whole_word_sql('lower(text)', '|'.join(v))} THEN '{k}'"
                  for k, v in LADDER.items())
       + " WHEN " + whole_word_sql("lower(text)", "el|los")
       + " THEN 'rn' END AS education FROM (SELECT doc_id, text,"
         " CASE WHEN source = 'src1' THEN 'masters' ELSE source END AS source FROM documents)")
def education_ladder(t):
    coded = F.when(F.col("source") == "src1", "masters").otherwise(F.col("source"))
    level = features.education_level(coded, F.col("text"), LADDER, {"rn": ["el", "los"]})
    return roles.texts(t).select("doc_id", level.alias("education"))


@query("education_rules", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {whole_word_sql('lower(text)', '|'.join(v))} THEN '{k}'" for k, v in LADDER.items()) + " END AS value FROM documents")
def education_rules(t):
    """The same ladder as a table of phrases, joined with the phrases of each text."""
    return rule_table.level_by_rules(t.documents, ["doc_id"], "text", rule_table.rules_of(t.spark, LADDER))


TERM_LEVELS = {"entry": ["small", "economy"], "mid": ["medium", "standard", "eco[a-z]+"],
               "top": ["promo", "stand[a-z]*"]}


@query("term_level_map", "SELECT p_partkey, coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(lower(p_type), '^({'|'.join(v)})($|[^{LETTERS}])') THEN '{k}' END"
    for k, v in reversed(TERM_LEVELS.items())) + ", p_type) AS level FROM part")
def term_level_map(t):
    level = features.last_level(F.lower(F.col("p_type")), TERM_LEVELS)
    return t.part.select("p_partkey", F.coalesce(level, "p_type").alias("level"))


def experience_texts(t):
    size = F.col("p_size").cast("string")
    years = (
        F.when(F.col("p_type") == "STANDARD",
               F.concat(size, F.lit(" to "), (F.col("p_size") + 3).cast("string"), F.lit(" years")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("More than "), size, F.lit(" years")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("Less than "), size, F.lit(" years")))
        .when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit(" years")))
        .otherwise("Not specified")
    )
    jobs = F.when(F.col("p_type") != "LARGE", F.concat(size, F.lit(" open positions"))).otherwise("open")
    return t.part.select("p_partkey", years.alias("experience"), jobs.alias("vacancies"))


@query("experience_range", """SELECT p_partkey,
        CASE p_type WHEN 'STANDARD' THEN p_size WHEN 'PROMO' THEN p_size WHEN 'MEDIUM' THEN 0
            WHEN 'ECONOMY' THEN p_size END AS expmin,
        CASE p_type WHEN 'STANDARD' THEN p_size + 3 WHEN 'PROMO' THEN 30 WHEN 'MEDIUM' THEN p_size
            WHEN 'ECONOMY' THEN p_size END AS expmax FROM part""")
def experience_range(t):
    low, high = features.experience_range(F.col("experience"))
    return experience_texts(t).select("p_partkey", low.alias("expmin"), high.alias("expmax"))


@query("vacancies", """SELECT p_partkey, CASE WHEN p_type <> 'LARGE' THEN p_size ELSE 1 END AS vacancies
    FROM part""")
def vacancies(t):
    return experience_texts(t).select("p_partkey", features.vacancies(F.col("vacancies")).alias("vacancies"))


@query("req_lines", r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS req_num,
        CAST(contains(text, 'License') AS INTEGER) AS req_license FROM documents""")
def req_lines(t):
    return t.documents.select("doc_id", features.requirement_lines(F.col("text"), "\n").alias("req_num"),
                              features.has_text(F.col("text"), "License").alias("req_license"))


PROVINCES = ["NATION_1", "NATION_2"]


@query("province", """WITH places AS (SELECT c_custkey, c_name || ', ' || n_name
        || CASE WHEN n_regionkey > 1 THEN ', ' || r_name ELSE '' END AS a
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, CASE WHEN contains(a, 'ASIA') THEN a ELSE a || ', ASIA' END AS address,
        CASE WHEN regexp_matches(a, '(NATION_1|NATION_2)')
            THEN regexp_extract(a, '(NATION_1|NATION_2)', 1) ELSE 'Other' END AS province FROM places""")
def province(t):
    tail = F.when(F.col("n_regionkey") > 1, F.concat(F.lit(", "), F.col("r_name"))).otherwise("")
    places = roles.places(t).select("c_custkey", F.concat(
        "c_name", F.lit(", "), "n_name", tail).alias("location"))
    return places.select("c_custkey", features.full_address(F.col("location"), "ASIA").alias("address"),
                         features.province(F.col("location"), PROVINCES).alias("province"))


@query("age_years", f"""WITH {POSTINGS} SELECT uid,
    CAST(floor(date_diff('day', postdate, DATE '2001-08-01') / 365) AS INTEGER) AS age FROM postings""")
def age_years(t):
    return roles.postings(t).select("uid", dates.age_years(F.col("postdate"), TODAY).alias("age"))


@query("salary_text", f"""WITH {POSTINGS}, s AS (SELECT uid, CASE WHEN level = '5-LOW'
        THEN '1,000, Negotiable' ELSE format('{{:,.2f}}', compensation) END AS s FROM postings)
    SELECT uid, CASE WHEN contains(s, 'Negotiable') THEN s ELSE replace(s, ',', '') END AS salary FROM s""")
def salary_text(t):
    raw = F.when(F.col("level") == "5-LOW", "1,000, Negotiable").otherwise(F.format_number("compensation", 2))
    return roles.postings(t).select("uid", text.salary_text(raw).alias("salary"))


# Text


@query("slug", r"""SELECT p_partkey, regexp_replace(regexp_replace(
        lower(p_brand || '. ' || p_name || ' + (' || p_type || ')'), '[\s()+?|''.]', '-', 'g'),
        '-+', '-', 'g') AS slug FROM part""")
def slug(t):
    name = F.concat("p_brand", F.lit(". "), "p_name", F.lit(" + ("), "p_type", F.lit(")"))
    return t.part.select("p_partkey", text.slug(name).alias("slug"))


@query("name_count", """SELECT c_custkey, c_name AS name, CAST(floor(abs(c_acctbal)) AS INTEGER) AS n
    FROM customer""")
def name_count(t):
    label = F.concat("c_name", F.lit(" ("), F.format_number(F.floor(F.abs("c_acctbal")), 0), F.lit(")"))
    name, n = text.count_label(F.col("label"))
    return t.customer.select("c_custkey", label.alias("label")).select(
        "c_custkey", name.alias("name"), n.alias("n"))


STRIP = r"'^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'"


@query("clean_description", rf"""SELECT doc_id, replace(regexp_replace(array_to_string(list_transform(
        list_filter(string_split_regex(text, '[\n\t\r]'), lambda x: regexp_matches(x, '[{LETTERS}]')),
        lambda x: regexp_replace(x, {STRIP})), chr(10)), '<!--.*?-->', '', 'g'), chr(160), chr(10))
        AS description FROM documents""")
def clean_description(t):
    return roles.texts(t).select("doc_id", text.clean_description(F.col("text")).alias("description"))


@query("flatten_lines", "SELECT doc_id, translate(text, chr(13) || chr(10), ' >') AS line FROM documents")
def flatten_lines(t):
    return t.documents.select("doc_id", text.flatten_lines(F.col("text")).alias("line"))


@query("list_join_split", f"""WITH {LISTING}
    SELECT uid, category || '>' || level || '>' || stat AS joined, 3::INTEGER AS items,
        category AS first_item, stat AS last_item FROM listing""")
def list_join_split(t):
    joined = roles.listing(t).select("uid", text.join_list(F.array("category", "level", "stat")).alias("joined"))
    items = text.split_list(F.col("joined"))
    return joined.select("uid", "joined", F.size(items).alias("items"), F.get(items, 0).alias("first_item"),
                         F.element_at(items, -1).alias("last_item"))


SYNONYMS = [("that|which", "what"), ("les", "leadership"), ("de la", "dela"), ("der", "leaders")]


def _requirements_sql(column: str) -> str:
    line = rf"""regexp_replace(regexp_replace(x, {STRIP}), '^b[''"]|\\x[0-9a-f]{{2}}|\\', '', 'g')"""
    line = rf"regexp_replace(regexp_replace({line}, '\d', '', 'g'), '\s+', ' ', 'g')"
    line = f"translate({line}, {sql_list([rules.REQUIREMENT_PUNCTUATION])}, '')"
    for words, replacement in SYNONYMS:
        # Neighbouring matches share a separator, so the pattern is run twice.
        for _ in range(2):
            line = (f"regexp_replace({line}, '(^|[^{LETTERS}])({words})($|[^{LETTERS}])',"
                    rf" '\1{replacement}\3', 'g')")
    return f"array_to_string(list_transform(string_split({column}, chr(10)), lambda x: {line}), ' ')"


@query("normalise_requirements", f"SELECT doc_id, {_requirements_sql('lower(text)')} AS requirements FROM documents")
def normalise_requirements(t):
    return roles.texts(t).select("doc_id", text.normalise_requirements(
        F.lower("text"), "\n", SYNONYMS).alias("requirements"))


def tokens(t):
    return roles.texts(t).select("doc_id", text.clean_tokens(F.lower("text")).alias("tokens"))


STOP = sql_list(w for w in rules.ENGLISH_STOP_WORDS + rules.EXTRA_STOP_WORDS if len(w) >= 4)
TOKENS = rf"""tokens AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'),
    lambda w: length(w) >= 4 AND w NOT IN ({STOP})) AS tokens FROM documents)"""


@query("clean_tokens", f"""WITH {TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS cleaned,
    CAST(len(tokens) AS INTEGER) AS n FROM tokens""")
def clean_tokens(t):
    return tokens(t).select("doc_id", F.array_join("tokens", " ").alias("cleaned"), F.size("tokens").alias("n"))


TERMS = """terms AS (SELECT doc_id, term, count(*) AS n FROM (
        SELECT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term),
    top AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS INTEGER)
        AS place, term, n FROM terms)"""
PAIRS = """pairs AS (SELECT doc_id, term, count(*) AS n FROM (
        SELECT doc_id, unnest(list_transform(list_zip(tokens[:-2], tokens[2:]), lambda p: p[1] || ' ' || p[2]))
            AS term FROM tokens) GROUP BY doc_id, term),
    top_pairs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)
        AS INTEGER) AS place, term, n FROM pairs)"""


@query("top_terms", f"WITH {TOKENS}, {TERMS} SELECT * FROM top WHERE place <= 30")
def top_terms(t):
    return terms.top_terms(tokens(t), "doc_id", F.col("tokens"))


@query("top_bigrams", f"WITH {TOKENS}, {PAIRS} SELECT * FROM top_pairs WHERE place <= 30")
def top_bigrams(t):
    return terms.top_bigrams(tokens(t), "doc_id", F.col("tokens"))


SKILLS = {"hard": ["anthe", "ononen", "andthe", "einder"], "soft": ["tionthe", "queles", "license."]}
SKILL_PAIRS = {"hard": ["mit license."], "soft": ["general public", "public license,"]}


def _hits(kind: str) -> str:
    return (f"(SELECT count(*) FROM top WHERE top.doc_id = d.doc_id AND place <= 30"
            f" AND term IN ({sql_list(SKILLS[kind])}))"
            f" + (SELECT count(*) FROM top_pairs p WHERE p.doc_id = d.doc_id AND place <= 30"
            f" AND term IN ({sql_list(SKILL_PAIRS[kind])}))")


@query("skill_tags", f"WITH {TOKENS}, {TERMS}, {PAIRS} SELECT doc_id, "
       + ", ".join(f"CAST({_hits(k)} AS INTEGER) AS {k}_skills" for k in SKILLS) + " FROM documents d")
def skill_tags(t):
    return encode.skill_tags(tokens(t), "tokens", SKILLS, SKILL_PAIRS).drop("tokens")


@query("label_class", f"""WITH {LISTING}
    SELECT uid, CASE level WHEN '1-URGENT' THEN 'publisher' WHEN '2-HIGH' THEN 'occupation'
        WHEN '3-MEDIUM' THEN 'location' WHEN '5-LOW' THEN 'publisher' END AS topic,
        CASE level WHEN '5-LOW' THEN 'Adlake portal' WHEN '4-NOT SPECIFIED' THEN '- ' || category
            ELSE category END AS label FROM listing""")
def label_class(t):
    level = F.col("level")
    label = (F.when(level == "1-URGENT", F.concat("category", F.lit(" Website Jobs")))
             .when(level == "2-HIGH", F.concat("category", F.lit(" Jobs")))
             .when(level == "3-MEDIUM", F.concat(F.lit("Jobs in "), "category"))
             .when(level == "5-LOW", "Adlake portal").otherwise(F.concat(F.lit("- "), "category")))
    topic, name = text.label_class(F.col("label"), own_name="Adlake")
    return roles.listing(t).select("uid", label.alias("label")).select(
        "uid", topic.alias("topic"), name.alias("label"))


@query("regex_capture", r"""SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 1), '') AS lang,
        try_cast(regexp_extract(url, '/(\d+)', 1) AS INTEGER) AS ad_id,
        try_cast(regexp_extract(url, '[?&]page=(\d+)', 1) AS INTEGER) AS page FROM pages""")
def regex_capture(t):
    url = F.col("url")
    return t.pages.select("page_id", text.capture(url, r"/([a-z]{2})/(\d+)").alias("lang"),
                          text.capture_int(url, r"/(\d+)").alias("ad_id"),
                          text.capture_int(url, r"[?&]page=(\d+)").alias("page"))


@query("keep_alnum", """SELECT o_orderkey AS uid, regexp_replace(o_orderpriority, '[^0-9a-zA-Z]+', '', 'g') AS level,
    regexp_replace('[''' || o_orderpriority || ''']', '[\\[\\]'']', '', 'g') AS item FROM orders""")
def keep_alnum(t):
    quoted = F.concat(F.lit("['"), "o_orderpriority", F.lit("']"))
    return t.orders.select(F.col("o_orderkey").alias("uid"), text.keep_alnum(F.col("o_orderpriority")).alias("level"),
                           text.clean_item(quoted).alias("item"))


@query("strip_punct", "SELECT doc_id, replace(trim(lower(text), '.'), ';', '') AS line FROM documents")
def strip_punct(t):
    return t.documents.select("doc_id", text.strip_punct(F.col("text")).alias("line"))


@query("money_digits", f"""WITH {AMOUNTS} SELECT uid,
        try_cast(replace(regexp_extract(amount, '(\\d[\\d,]*)', 1), ',', '') AS BIGINT) AS amount,
        try_cast(regexp_replace(amount, '[^0-9]', '', 'g') AS BIGINT) AS all_digits FROM amounts""")
def money_digits(t):
    return amounts(t).select("uid", text.money_digits(F.col("amount")).alias("amount"),
                             text.money_digits(F.col("amount"), all_digits=True).alias("all_digits"))


@query("location_split", """SELECT c_custkey, r_name AS country,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN n_name END AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def location_split(t):
    place = F.when(F.col("c_mktsegment") != "BUILDING", F.concat("r_name", F.lit(" - "), "n_name")).otherwise(
        F.col("r_name"))
    country, region = text.location_split(F.col("location"))
    return roles.places(t).select("c_custkey", place.alias("location")).select(
        "c_custkey", country.alias("country"), region.alias("region"))


@query("decode_utf8", "SELECT doc_id, text FROM documents")
def decode_utf8(t):
    stored = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return stored.select("doc_id", text.decode_utf8(F.col("bytes")).alias("text"))


@query("arabic_start", r"""SELECT doc_id, regexp_matches(CASE lang WHEN 'fr' THEN chr(1587) WHEN 'de' THEN chr(1611)
        WHEN 'es' THEN ' ' || chr(1587) ELSE '' END || text, '^[\x{0627}-\x{064a}]') AS arabic FROM documents""")
def arabic_start(t):
    # The texts hold no Arabic; some get a first letter in or just outside the range.
    first = (F.when(F.col("lang") == "fr", "\u0633").when(F.col("lang") == "de", "\u064b")
             .when(F.col("lang") == "es", " \u0633").otherwise(""))
    return t.documents.select("doc_id", text.starts_arabic(F.concat(first, "text")).alias("arabic"))


@query("title_label", """SELECT c_custkey, upper(r_name[1]) || lower(r_name[2:]) AS country, c_mktsegment[1]
        || lower(c_mktsegment[2:]) AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE NOT contains(r_name, ' ') UNION ALL
    SELECT c_custkey, 'Middle East', c_mktsegment[1] || lower(c_mktsegment[2:])
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE contains(r_name, ' ')""")
def title_label(t):
    return roles.places(t).select("c_custkey", text.title_label(F.col("r_name")).alias("country"),
                                  text.title_label(F.col("c_mktsegment")).alias("segment"))


# Dates

JANUARY = date(2001, 3, 15)


@query("relative_date", f"""WITH {POSTINGS} SELECT uid, CASE level
        WHEN '1-URGENT' THEN DATE '2001-03-15' WHEN '2-HIGH' THEN DATE '2001-03-14'
        ELSE try_cast(CASE WHEN month(postdate) <= 3 THEN '2001' ELSE '2000' END
            || strftime(postdate, '-%m-%d') AS DATE) END AS posted FROM postings""")
def relative_date(t):
    phrase = (F.when(F.col("level") == "1-URGENT", "Today 12:30")
              .when(F.col("level") == "2-HIGH", "Yesterday 08:15")
              .otherwise(F.date_format("postdate", "d MMM")))
    return roles.postings(t).select("uid", phrase.alias("phrase")).select(
        "uid", dates.relative_date(F.col("phrase"), JANUARY).alias("posted"))


@query("parse_dates", """WITH stamps AS (SELECT o_orderkey AS uid,
        o_orderdate + to_minutes(CAST(o_custkey % 1440 AS INTEGER)) AS ts FROM orders)
    SELECT uid, ts AS clock, ts AS weekday, CAST(ts AS DATE) AS long FROM stamps""")
def parse_dates(t):
    stamps = t.orders.select(F.col("o_orderkey").alias("uid"), F.expr(
        "timestampadd(MINUTE, o_custkey % 1440, o_orderdate)").alias("ts"))
    texts = stamps.select(
        "uid", F.date_format("ts", "HH:mm, d MMMM yyyy").alias("clock"),
        F.date_format("ts", "EEEE, MMMM d, yyyy 'at' h:mma").alias("weekday"),
        F.concat(F.lit("Posted: "), F.date_format("ts", "d MMMM yyyy")).alias("long"))
    return texts.select("uid", dates.clock_date(F.col("clock")).alias("clock"),
                        dates.weekday_date(F.col("weekday")).alias("weekday"),
                        dates.long_date(F.col("long")).alias("long"))


@query("mixed_dates", f"""WITH {POSTINGS}, d AS (
        SELECT *, date_trunc('month', postdate)::DATE AS m FROM postings)
    SELECT uid, CASE level WHEN '1-URGENT' THEN year(postdate)::INTEGER END AS year,
        CASE level WHEN '2-HIGH' THEN m END AS day,
        CASE WHEN level IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN m END AS start,
        CASE level WHEN '3-MEDIUM' THEN (m + INTERVAL 14 MONTH)::DATE
            WHEN '4-NOT SPECIFIED' THEN DATE '2001-08-01' END AS end,
        CASE level WHEN '5-LOW' THEN 'some time ago' END AS other FROM d""")
def mixed_dates(t):
    level, month = F.col("level"), F.date_format("postdate", "MMM yyyy")
    later = F.date_format(F.add_months(F.trunc("postdate", "MM"), 14), "MMM yyyy")
    phrase = (F.when(level == "1-URGENT", F.year("postdate").cast("string"))
              .when(level == "2-HIGH", month)
              .when(level == "3-MEDIUM", F.concat(month, F.lit(" - "), later))
              .when(level == "4-NOT SPECIFIED", F.concat(month, F.lit(" - Present")))
              .otherwise("some time ago"))
    parsed = roles.postings(t).select("uid", "level", phrase.alias("phrase")).select(
        "uid", "level", dates.mixed_date(F.col("phrase"), TODAY).alias("d"))
    return parsed.select("uid", "d.year", "d.day", "d.start", "d.end",
                         F.when(F.col("d.raw").rlike("^some"), F.col("d.raw")).alias("other"))


@query("last_active", f"""WITH {POSTINGS} SELECT uid, CASE level WHEN '1-URGENT' THEN DATE '2001-08-01'
        WHEN '2-HIGH' THEN DATE '2001-07-31' WHEN '3-MEDIUM' THEN DATE '2001-07-25'
        WHEN '5-LOW' THEN postdate END AS last_active FROM postings""")
def last_active(t):
    level = F.col("level")
    phrase = (F.when(level == "1-URGENT", "Last Active: 3 hours ago")
              .when(level == "2-HIGH", "Last Active: Yesterday")
              .when(level == "3-MEDIUM", "Last Active: Last week")
              .when(level == "5-LOW", F.concat(F.lit("Last Active: "), F.date_format("postdate", "d MMMM yyyy")))
              .otherwise("private"))
    return roles.postings(t).select("uid", phrase.alias("phrase")).select(
        "uid", dates.last_active(F.col("phrase"), TODAY).alias("last_active"))


@query("days_posted", """SELECT o_orderkey AS uid, l_linenumber AS line, CAST(l_shipdate AS DATE) AS downloaddate,
        CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days_posted
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_posted(t):
    pages = roles.snapshots(t).select("uid", "line", "downloaddate")
    both = pages.join(roles.postings(t).select("uid", "postdate"), "uid")
    return both.select("uid", "line", "downloaddate", dates.days_between(
        F.col("downloaddate"), F.col("postdate")).alias("days_posted"))


@query("month_start", """SELECT o_orderkey AS uid, date_trunc('month', o_orderdate)::DATE AS month,
        year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m FROM orders""")
def month_start(t):
    return t.orders.select(F.col("o_orderkey").alias("uid"), dates.month_start(F.col("o_orderdate")).alias("month"),
                           F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query("local_stamp", """WITH l AS (SELECT event_id, timezone('Africa/Cairo', timezone('UTC', ts)) AS ts FROM events)
    SELECT event_id, CAST(ts AS DATE) AS downloaddate, strftime(ts, '%H:%M') AS downloadtime FROM l""")
def local_stamp(t):
    day, clock = dates.local_stamp(F.col("ts"), rules.TIME_ZONES["egypt"])
    return t.events.select("event_id", day.alias("downloaddate"), clock.alias("downloadtime"))
