"""Word lists, patterns and field names that the operators take as parameters.

Fixed values: everything below has to hold exactly these entries, in this order, for
the results to be right.
"""

# Education levels, tried in this order; each entry is a regular expression.
EDUCATION_TERMS = {
    "diploma": ["diploma", "high school", "secondary education"],
    "bachelors": [
        "higher education", "baccalaureate", "university", "college",
        "university (graduates|degree)", r"bachelor(s){0,1}", r"b(\.){0,1}[as](\.){0,1}",
        r"b(\.){0,1}sc(\.){0,1}", "college degree", "engineering", "computer science",
    ],
    "masters": ["masters", r"m(\.){0,1}[as](\.){0,1}", r"m(\.){0,1}b(\.){0,1}a(\.){0,1}"],
    "doctorate": ["doctorate", "phd", r"ph(\.){0,1}d(\.){0,1}", "doctor of philosophy", "faculty"],
    "md": [r"m(\.){0,1}d(\.){0,1}", "medical doctor", "medical degree"],
    "rn": [r"r(\.){0,1}n(\.){0,1}", "registered nurse", "nursing degree", "nursing"],
    "jd": [r"j(\.){0,1}d(\.){0,1}", "law degree"],
}

# Punctuation removed from requirement lines.
REQUIREMENT_PUNCTUATION = "\"'-()[];."

# Synonyms in requirement lines: whole-word pattern -> replacement, applied in order.
REQUIREMENT_SYNONYMS = [
    ("bs/ba|university|bachelors|masters", "bachelor"),
    ("leaders", "leadership"),
    ("ms", "microsoft"),
    ("good looking", "good-looking"),
    ("hard working", "hard-working"),
    ("attention to detail", "attention-to-detail"),
]

# Words that say nothing in a requirement section, besides the English stop words.
EXTRA_STOP_WORDS = [
    "experience", "user", "skills", "skill", "ability", "excellent", "years", "year", "relevant",
    "knowledge", "work", "minimum", "time", "command", "field", "degree", "familiar", "must",
    "strong", "good", "preferred", "plus", "able", "least", "using", "understanding",
    "background", "presentable", "candidate", "working", "including", "related", "required",
    "solid", "attention",
]

ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very can will just "
    "should now don't can't won't isn't aren't wasn't weren't haven't hasn't hadn't doesn't didn't "
    "couldn't shouldn't wouldn't mustn't needn't you're you've you'll you'd they're they've they'll "
    "we're we've we'll she's he's it's that's that'll should've i'm i've i'll"
).split()

KEY_WORDS = [
    "emails", "analytics", "analytical", "research", "bachelor", "leadership", "interpersonal",
    "communication", "knowledge", "marketing", "management", "business", "computer", "team",
    "english", "arabic", "presenting", "confident", "travel", "initiative", "writing", "reading",
    "negotiation", "excel", "powerpoint", "flexible", "microsoft", "persuade", "strategic",
]

# Skill tags by kind: single words, then bigrams.
SKILL_WORDS = {
    "hard": ["experience", "knowledge", "degree", "computer", "software", "engineering",
             "science", "language", "excel"],
    "soft": ["communication", "team", "presentation", "negotiation", "leadership",
             "interpersonal"],
}
SKILL_BIGRAMS = {
    "hard": ["microsoft office"],
    "soft": ["problem solving", "work pressure", "time management", "attention detail"],
}

PROVINCES = [
    "Alexandria", "Assuit", "Cairo", "Gharbia", "Giza", "Ismailia", "Kafr Alsheikh", "Matruh",
    "Monufya", "Port Said", "Sharqia", "Qalubia",
]

# Values that set the membership flags of an ad.
MEMBER_FLAGS = {
    "bachelor_degree": ("educationlevel", ["BachelorsDegree", "MastersDegree", "PhD"]),
    "fulltime": ("employtype", ["Full-time"]),
    "exp_management": (
        "experiencelevel",
        ["Management", "Executive/Director", "Senior Executive (President, CEO)"],
    ),
    "exp_entrylevel": ("experiencelevel", ["Entry level"]),
}

# Columns that are turned into indicator columns, and columns that are averaged.
ENCODE_COLUMNS = ["experiencelevel", "employtype", "type", "educationlevel"]
ENCODE_JOB_COLUMNS = [
    "job_type", "gender", "travel_frequency", "languages", "education_level", "career_level",
    "company", "province",
]
AVERAGE_COLUMNS = ["daysposted", "compensation", "i_featured", "i_photo", "pageviews",
                   "phoneavail", "emailavail"]
AVERAGE_JOB_COLUMNS = ["days_posted", "vacancies", "expmin", "expmax", "req_num", "req_bachelors"]

# Resume sections: generic card field -> name in that section.
SECTION_FIELDS = {
    "education": {"date": "date", "subject": "school", "item1": "degree", "item2": "major",
                  "description": "description"},
    "experiences": {"date": "date", "date_start": "date_start", "date_end": "date_end",
                    "subject": "jobtitle", "item1": "company", "item2": "location",
                    "description": "description"},
    "courses": {"date": "date", "subject": "school", "item1": "degree", "item2": "major",
                "description": "description"},
    "certificates": {"date": "date", "subject": "school", "item1": "degree", "item2": "major",
                     "description": "description"},
    "projects": {"date": "date", "subject": "name", "item1": "item1", "item2": "item2",
                 "description": "description"},
}

# Resume texts that are translated: section -> fields ('' for a plain string).
TRANSLATED_FIELDS = {
    "education": ["degree", "description"],
    "skills": [""],
    "languages": ["type"],
    "projects": ["description"],
    "experiences": ["jobtitle", "description"],
    "summary": [""],
}

TIME_ZONES = {
    "algeria": "Africa/Algiers", "egypt": "Africa/Cairo", "jordan": "Asia/Amman",
    "morocco": "Africa/Casablanca", "tunisia": "Africa/Tunis",
}

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]

# Page markup: CSS classes, ids and attributes that mark the parts of a page.
CLASSIFIED_CARD = {
    "photo": "ads__item__photos-holder", "info": "ads__item__info", "paid": "ads__item__paidicon",
    "observed": "ad.observed.list", "title": "ads__item__title", "date": "ads__item__date",
    "no_photo": "jobs-services-thumb.png",
}
CLASSIFIED_PAGE = {
    "live": "pdingleft10 brlefte5", "head": "offerheadinner", "content": "textContent",
    "cell": "col", "views": "pdingtop10", "price": "pricelabel", "user": "user-box",
    "user_name": "user-box__info__name", "user_age": "user-box__info__age",
    "contact": "contactbox", "phone": "contactbox-indent",
}
CLASSIFIED_FIELDS = {
    "Experience Level": "experiencelevel", "Education Level": "educationlevel", "Type": "type",
    "Employment Type": "employtype",
}
SITE_MAP = {"region": "bgef", "subregions": "clr marginbott10", "sector": "topLink",
            "sector_name": "link", "sector_count": "counter"}
BOARD_CARD = {"card": "new-time"}
BOARD_PAGE = {
    "closed": "alert-danger alert-job", "main": "job-main-card", "title": "job-title",
    "company": "job-company-name", "location": "job-company-location",
    "applicants": "applicants-num", "vacancies": "vacancies-num", "stats": "applicants-stat-num",
    "posted": "job-post-date", "summary": "job-summary", "about": "about-job",
    "labels": "labels-wrapper", "requirements": "job-requirements", "industries": "industries",
}
BOARD_FIELDS = ["experience_needed", "career_level", "job_type", "salary", "education_level",
                "gender", "travel_frequency", "languages", "vacancies"]
SUMMARY_CARD = {"list": "jobs_list", "featured": "featured_job", "meta": "meta-desc"}
DETAIL_FIELDS = {
    "Posted date": "postdate", "Location": "location", "Job Type": "jobtype",
    "Company": "company", "Required Experience": "reqexp", "Salary": "salary",
    "Education": "education",
}
RESUME_CARD = {"card": "job-box panel-content", "name": "media-heading"}
RESUME_PAGE = {
    "photo": "biothumb", "no_photo": "img/avatar.png", "header": "profile-header",
    "location": "no-margin", "section": "section-block", "heading": "listing-header",
    "personal": "col-md-6", "date": "date", "subject": "subject", "description": "col-md-10",
    "level": "dates", "language": "lang",
}
