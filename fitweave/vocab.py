"""Word lists, lookup tables and phrases that results depend on.

Everything here is data.  The rules that use it live in ``functions`` and
``operators``.
"""

# --- fixed values: language detection -------------------------------------
LANGUAGE_WORDS = {
    "de": [
        "aber", "als", "auch", "auf", "aus", "bei", "bewerbung", "das", "der", "die", "eine", "einem",
        "einen", "einer", "für", "ihre", "ihren", "ist", "mit", "oder", "sind", "stelle", "und", "unser",
        "unsere", "von", "wir", "werden", "zu",
    ],
    "en": [
        "and", "application", "are", "as", "at", "be", "for", "from", "in", "is", "job", "of", "on", "or",
        "our", "position", "the", "their", "to", "we", "will", "with", "you", "your",
    ],
}

# --- fixed values: matching terms -----------------------------------------
MATCH_STOPWORDS = [
    "and", "the", "with", "for", "from", "und", "der", "die", "das", "mit", "für", "von", "eine",
    "experience", "erfahrung", "kenntnisse", "ability", "along", "advantageous", "developing", "highly",
    "like", "professional", "proficiency", "proven", "significant", "skills", "strong", "such", "track",
    "environments", "field", "roles", "programming", "languages",
]

TERM_CONCEPTS = {
    "predictive_modeling": [
        "forecasting", "prediction", "predictive", "vorhersage", "vorhersagen", "vorhersagealgorithmus",
        "vorhersagealgorithmen", "vorhersagemodell", "vorhersagemodelle", "prädiktiv", "prädiktive",
        "prädiktiver", "prognose", "prognosen", "prognosemodell", "prognosemodelle",
    ],
    "raw_data_analysis": ["eda", "exploratory", "rohdaten", "rohdatenanalyse", "rohdatenaufbereitung"],
    "data_cleaning": ["cleaning", "cleansing", "bereinigung", "datenbereinigung", "rohdatenaufbereitung"],
    "data_quality": ["quality", "qualität", "datenqualität"],
}

TARGET_CONCEPTS = {
    "data_science": ["data science", "data scientist", "datenanalyse", "data analysis", "statistik"],
    "machine_learning": ["machine learning", "mlops", "scikit", "pytorch", "tensorflow"],
    "automation": ["automatisierung", "automation", "workflow", "pipeline"],
    "ai_development": [
        "ki", "ai", "künstliche intelligenz", "artificial intelligence",
        "machine learning", "prototyp", "softwaredevelopment", "softwareentwicklung",
    ],
}

# --- fixed values: scoring -------------------------------------------------
PRIORITY_WEIGHT = {"must": 3, "should": 2, "nice_to_have": 1}
LEVEL_FULFILMENT = {
    "strong_match": 1.0,
    "partial_match": 0.65,
    "transferable": 0.4,
    "gap": 0.0,
    "unknown": 0.0,
}
CONTEXT_WEIGHT = {"professional": 1.0, "project": 0.9, "training": 0.8}
OTHER_CONTEXT_WEIGHT = 0.5
TARGET_LEVEL_RANK = {
    "entry": 0, "junior": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 5,
    "lead": 6, "manager": 6,
}
TARGET_WEIGHT = {
    "role": 10, "activities": 35, "seniority": 20, "industry": 10, "location": 15,
    "work_model": 10, "employment_type": 10,
}

# --- fixed values: section headings ----------------------------------------
ACTIVITY_HEADINGS = [
    "aufgaben", "tätigkeiten", "verantwortung", "verantwortlichkeiten",
    "(?:deine|ihre) rolle", "rolle", "ihr aufgabengebiet", "das erwartet dich",
    "responsibilities", "your role", "what you(?:'|’)ll do", "what you(?:'|’)ll be doing",
    "the role", "in this (?:position|role)", "key responsibilities", "day[- ]to[- ]day",
    "what you need to make a difference",
]
ACTIVITY_OPENERS = [
    "as part of\\b.{0,120}\\byou will", "you will", "you are responsible for",
    "deine aufgaben", "übernehmen sie", "du wirst", "sie werden",
]
REQUIREMENT_HEADINGS = [
    "anforderungen", "qualifikationen", "kompetenz[\\p{L}\\p{N}_]*", "profil",
    "das bringst du mit", "das zeichnet dich aus", "ihr profil", "requirements",
    "qualifications", "what you bring", "your profile", "skills?\\s*[+&]\\s*education",
    "skills?", "education", "what we(?:'|’)re looking for", "about you", "who you are",
    "what you(?:'|’)ll bring", "must[- ]haves?", "skills (?:and|&) experience",
]
BENEFIT_HEADINGS = [
    "benefits?", "vorteile", "wir bieten", "was wir bieten", "unser angebot",
    "das bieten wir", "deine benefits", "ihre benefits", "perks", "fringe benefits",
    "what we offer", "our benefits", "what you get", "employee benefits",
]
OPTIONAL_WORDS = ["von vorteil", "wünschenswert", "idealerweise", "nice to have", "preferred", "plus"]
MUST_WORDS = ["muss", "zwingend", "notwendig", "erforderlich", "required", "must", "mindestens"]
KEYWORD_STOPWORDS = [
    "aber", "auch", "dabei", "eine", "einem", "einen", "einer", "sowie", "über", "oder", "und", "with",
    "your", "you", "the", "and", "for",
]
NUMBER_WORDS = {
    "ein": 1, "eine": 1, "einem": 1, "einen": 1, "zwei": 2, "drei": 3, "vier": 4,
    "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10,
}

# --- fixed values: seniority and role ---------------------------------------
SENIORITY_RULES = [
    ("senior", ["architectural\\s+leadership"]),
    ("lead", ["teamlead", "team lead", "lead(?!\\s+times)", "leiter(?:in)?", "head of"]),
    ("senior", ["senior", "mehrj[aä]hrig"]),
    ("junior", ["junior", "berufseinsteiger", "erste\\s+(?:berufs|praktische\\s+)erfahrungen?"]),
]
OWNERSHIP_WORDS = [
    "eigenverantwortlich", "selbstständig", "independent(?:ly)?", "architecture",
    "architektur", "konzeption", "verantwortung(?:sbereich)?", "ownership",
]
ROLE_LEVELS = [
    "entry[- ]level", "junior", "mid[- ]level", "senior", "staff", "principal", "lead",
    "manager", "head of",
]
ROLE_NOUNS = [
    "engineer", "developer", "scientist", "analyst", "architect", "designer", "manager",
    "consultant", "researcher", "specialist", "officer",
]
ROLE_CONTEXTS = [
    "your role", "the role", "position", "we are looking for", "you will be", "mission",
    "responsibilit(?:y|ies)",
]

# --- fixed values: metadata --------------------------------------------------
PORTALS = [
    ("indeed", "Indeed"),
    ("instaffo", "Instaffo"),
    ("linkedin", "LinkedIn"),
    ("stepstone", "StepStone"),
    ("xing", "XING"),
    ("jobsuche der ba", "Bundesagentur für Arbeit"),
    ("arbeitsagentur", "Bundesagentur für Arbeit"),
]
LEGAL_FORMS = ["GmbH", "UG", "AG", "SE", "KG", "OHG", "GbR", "Ltd\\.?", "Limited", "Inc\\.?",
               "Corporation", "Corp\\.?", "LLC"]
LEGAL_FORMS_LONG = ["GmbH(?:\\s*&\\s*Co\\.\\s*KG)?", *LEGAL_FORMS[1:]]
LOCATION_HEADINGS = ["arbeitsort", "arbeitsorte", "location", "locations"]
LOCATION_FOOTINGS = ["bürostandorte", "standorte", "office locations"]
ADDRESS_HEADINGS = ["job address", "adresse", "anschrift"]
EMPLOYMENT_HEADINGS = ["anstellungsart", "beschäftigungsart", "employment type"]
CONTRACT_HEADINGS = ["befristung", "vertragsdauer", "contract term", "contract duration"]
INFORMATION_HEADINGS = ["informationen", "information", "company information"]
CALLS_TO_ACTION = ["apply", "apply now", "bewerben", "jetzt bewerben", "kontakt", "contact", "info"]
CITY_ONLY = ["berlin", "munich", "münchen", "hamburg", "cologne", "köln"]
PORTAL_CHROME = ["arbeit", "job", "stelle", "stellenangebot"]
REQUIRED_METADATA = ["title", "company", "location", "language"]
CANDIDATE_FIELDS = [
    "title", "company", "location", "work_model", "employment_type", "contract_term", "language",
]
BENEFIT_EVIDENCE = ["work-life balance", "benefit", "leistung", "top-angebot", "wir bieten"]

# --- fixed values: page quality ----------------------------------------------
MINIMUM_TEXT_LENGTH = 500
OCR_METHOD = "mineru"
BLOCK_PAGE_MARKERS = [
    "access denied", "captcha", "verify you are human", "enable javascript", "sign in to continue",
]
JOB_MARKERS = [
    "aufgaben", "anforderungen", "qualifikationen", "dein profil", "ihr profil",
    "was du mitbringst", "was wir bieten", "responsibilities", "requirements",
    "qualifications", "your profile", "what you bring", "what we offer",
]
BLOCK_PAGE_TITLES = ["access denied", "just a moment", "verify you are human", "security check"]
DROPPED_TAGS = ["script", "style", "svg", "noscript", "iframe", "nav", "footer", "header", "form", "aside"]
NOISE_NAMES = [
    "cookie", "consent", "privacy-banner", "navigation", "breadcrumb", "social-share", "newsletter",
]
RELATED_HEADINGS = [
    "related jobs", "similar jobs", "recommended jobs",
    "diese jobs k(?:ö|Ã¶)nnten sie auch interessieren", "weitere stellenangebote",
]
DETAIL_HEADINGS = [
    "aufgaben", "tätigkeiten", "anforderungen", "qualifikationen", "profil",
    "stellenbeschreibung", "what you(?:'|’)ll do", "responsibilities", "requirements",
    "qualifications", "about the role",
]

# --- fixed values: matching predicates ---------------------------------------
SOFT_SKILL_STEMS = [
    "self[- ]?motivat", "independen", "team[- ]?(?:first|orient|player)", "pragmati",
    "mindset", "collaborat", "communicat", "adaptab", "selbstmotiv", "unabhängig",
    "eigenständig", "teamorient", "teamfähig", "pragmatisch", "zusammenarbeit",
    "kommunikation", "lernbereit",
]
ELIGIBILITY_STEMS = [
    "nato", "nationalit", "citizenship", "staatsangeh(?:ö|oe)rig", "arbeitserlaub",
    "arbeitsberechtig", "work (?:permit|authori[sz]ation)", "right to work",
    "aufenthalt(?:serlaub|sberechtig|stitel)", "residence (?:permit|authori[sz]ation)",
]
GERMAN_NATIONALITIES = ["deutsch", "deutsche", "deutscher", "deutschland", "german", "germany"]
NATIONALITY_LABEL = "Staatsangehörigkeit"
NATIONALITY_KEYWORDS = [
    "Nationalität", "Staatsangehörigkeit", "nationality", "citizenship",
]
GERMAN_STATEMENTS = [
    "Deutschland ist NATO-Mitglied; die deutsche Staatsangehörigkeit ist damit eine "
    "NATO-Staatsangehörigkeit.",
    "Als deutsche Person besteht uneingeschränkter Zugang zum deutschen Arbeitsmarkt; für "
    "Aufenthalt und Beschäftigung in Deutschland ist kein Aufenthaltstitel und keine "
    "Arbeitserlaubnis erforderlich.",
]
GERMAN_KEYWORDS = [
    "Deutschland", "Germany", "deutsche Staatsangehörigkeit", "German citizenship", "NATO",
    "NATO-Staatsangehörigkeit", "NATO citizenship", "Arbeitserlaubnis Deutschland",
    "Arbeitsberechtigung Deutschland", "uneingeschränkte Arbeitserlaubnis",
    "work permit Germany", "work authorization Germany", "right to work in Germany",
    "Aufenthaltserlaubnis Deutschland", "Aufenthaltsberechtigung Deutschland",
    "Aufenthaltstitel Deutschland", "residence permit Germany",
    "residence authorization Germany",
]

# --- fixed values: closed vocabularies ----------------------------------------
APPLICATION_STATUSES = [
    "draft", "applied", "followed_up", "interview", "rejected", "offer", "accepted", "withdrawn", "closed",
]
APPLICATION_CHANNELS = ["email", "company_portal", "job_portal", "phone", "personal", "other"]
EVENT_TYPES = ["created", "status_change", "internal_forwarded", "communication", "note"]
STATUS_LABELS = {
    "draft": "Entwurf", "applied": "Beworben", "followed_up": "Nachgefragt",
    "interview": "Vorstellungsgespräch", "rejected": "Abgelehnt", "offer": "Angebot",
    "accepted": "Angenommen", "withdrawn": "Zurückgezogen", "closed": "Geschlossen",
}
CHANNEL_LABELS = {
    "email": "E-Mail", "company_portal": "Arbeitgeberportal", "job_portal": "Jobportal",
    "phone": "Telefon", "personal": "Persönlich", "other": "Sonstiges",
}
LINKEDIN_HOSTS = ["linkedin.com", "www.linkedin.com", "lnkd.in"]

# --- fixed values: marker tables (first hit wins) ------------------------------
EMPLOYMENT_MARKERS = [
    ("working_student", ["werkstudent", "working student"]),
    ("internship", ["praktikum", "internship", "intern"]),
    ("freelance", ["freelance", "freiberuf", "contractor"]),
    ("permanent", ["festanstellung", "unbefrist", "permanent", "full time", "vollzeit"]),
    ("temporary", ["befrist", "temporary", "fixed term"]),
]
EMPLOYMENT_UNKNOWN = ["angestellte r", "angestellter", "employee"]
WORK_MODEL_MARKERS = [
    ("remote", ["remote", "homeoffice", "home office"]),
    ("hybrid", ["hybrid"]),
    ("onsite", ["onsite", "on site", "vor ort", "praesenz"]),
]
SKILL_CATEGORY_MARKERS = [
    ("programming_languages", ["program", "language", "sprache"]),
    ("frameworks_libraries", ["framework", "library", "bibliothek"]),
    ("data_ai_ml", ["data", "daten", "machine", " ai", "ki", "ml"]),
    ("databases", ["database", "datenbank", "sql"]),
    ("cloud_devops", ["cloud", "devops", "deployment", "infra"]),
    ("tools_platforms", ["tool", "platform", "werkzeug"]),
    ("methods", ["method", "prozess", "agile", "scrum"]),
    ("soft_skills", ["soft", "social", "kommunikation", "leadership"]),
    ("domain_knowledge", ["domain", "industry", "fach", "branche"]),
]
SKILL_LEVEL_MARKERS = [
    ("expert", ["native", "mother", "mutter", "c2", "expert"]),
    ("advanced", ["advanced", "fortgeschritten", "fluent", "c1"]),
    ("intermediate", ["intermediate", "mittel", "good", "gut", "b1", "b2"]),
]
ROLE_LEVEL_MARKERS = [
    ("Principal", ["principal"]),
    ("Staff", ["staff"]),
    ("Lead", ["lead", "leiter", "head"]),
    ("Senior", ["senior"]),
    ("Junior", ["junior"]),
    ("Manager", ["manager"]),
]
MONTHS = {
    "jan": 1, "januar": 1, "january": 1, "feb": 2, "februar": 2, "february": 2, "mär": 3,
    "märz": 3, "mrz": 3, "mar": 3, "march": 3, "apr": 4, "april": 4, "mai": 5, "may": 5,
    "jun": 6, "juni": 6, "june": 6, "jul": 7, "juli": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "okt": 10, "oktober": 10, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dez": 12, "dezember": 12, "dec": 12, "december": 12,
}

# --- fixed values: texts shown with a match, per rule (explanation, recommended action) ----
MATCH_TEXTS = {
    "years_unknown": (
        "Für die Skills des Profils sind keine Erfahrungsjahre dokumentiert.",
        "Erfahrungsjahre bei den relevanten Skills ergänzen und manuell prüfen.",
    ),
    "no_terms": (
        "The requirement could not be matched because no usable terms were found.",
        "Review and classify this requirement manually.",
    ),
    "soft_unmatched": (
        "Soft skills cannot be treated as a factual gap solely because no matching profile "
        "keyword was found.",
        "Review references and concrete work examples manually; add a behavioral example only "
        "when it is verifiable.",
    ),
    "unmatched": (
        "No documented profile evidence supports this requirement.",
        "Do not claim this skill; add verified evidence or address the gap.",
    ),
    "soft_incidental": (
        "Only ambiguous wording overlaps were found. Soft skills require a concrete behavioral "
        "example or reference.",
        "Review this criterion manually instead of presenting it as a gap.",
    ),
    "incidental": (
        "Only incidental word overlap was found; no sufficiently relevant profile evidence "
        "supports this requirement.",
        "Do not claim this experience; add a concrete verified profile entry if applicable.",
    ),
    "eligibility": (
        "Documented profile data directly supports this nationality requirement.",
        "Use the cited nationality only for eligibility verification.",
    ),
    "professional": (
        "Documented professional evidence directly supports this requirement.",
        "Use the cited professional evidence and keep the wording factual.",
    ),
    "context_components": (
        "Several components are supported by education or skills, but the requested "
        "professional context is not fully documented.",
        "Claim only the supported components and state the professional gap.",
    ),
    "context_transferable": (
        "Related evidence exists, but no professional or production evidence supports the "
        "required context.",
        "Label this as transferable or project experience, not production experience.",
    ),
    "partial": (
        "The combined profile evidence supports part, but not all, of this requirement.",
        "Describe the supported portion and avoid implying broader experience.",
    ),
    "transferable": (
        "Related evidence exists, but it comes from projects, training, or education rather "
        "than professional experience.",
        "Label this as transferable or project experience, not production experience.",
    ),
}

# --- fixed values: patterns of metadata lines ---------------------------------
INLINE_VALUE_PATTERN = r"(?imu)^[ \t]*(?:>[ \t]*)?(?:NAMES)[ \t]*[:\-–]?[ \t]+(.+?)[ \t]*$"  # NAMES stands for the headings
MAP_LINK_PATTERN = r"(?iu)\[([^\]\r\n]{2,150})\]\(https?://(?:www\.)?google\.[^/\s]+/maps/[^)\r\n]+\)"
HEADER_SEPARATOR_PATTERN = r"\s+[·•|]\s+"
PLACE_MODE_END_PATTERN = r"(?iu)\s*\((?:hybrid|remote|on-?site)\)\s*$"
HEADER_MARK_PATTERN = r"\s[·•|]\s"
TERM_SEPARATOR_PATTERN = r"\s*[,;|]\s*"
PORTAL_TITLE_PATTERN = r"(?m)^#\s+([^#\r\n]+?)\s*$"
PORTAL_COMPANY_PATTERN = r"(?imsu)^##\s+\**(?:Firmendetails|Company details)\**\s*$\s*^#{1,3}\s+([^#\r\n]+?)\s*$"
PORTAL_LOCATION_PATTERN = r"(?imu)^\s*([^\r\n]{2,100}?)\s+Bürostandorte\s*$"
PORTAL_EMPLOYMENT_PATTERN = r"(?imu)^\s*[^A-Za-z\r\n]{0,3}(Vollzeit|Teilzeit|Full[- ]time|Part[- ]time)\b"
BELOW_TITLE_PATTERN = r"^\s*(?:>\s*)?#\s+\S"
COMPANY_SITE_PATTERN = r"(?iu)https?://(?:www\.)?join\.com/"
EMPLOYER_LINE_PATTERN = r"(?imu)^\s*(?:>\s*)?(?:Arbeitgeber|Unternehmen|Company|Employer)\s*:\s*(.+?)\s*$"
COMPANY_PAGE_PATTERN = r"(?imu)^\s*(?:>\s*)?\[([^\]\r\n]+)\]\(https?://[^)\r\n]*/cmp/[^)\r\n]*\)\s*$"
LOGO_LINK_PATTERN = r"(?imu)^\s*\[!\[([^\]\r\n]+?)\]\([^)]*\)\]\([^)]*\)\s*$"
LOGO_END_PATTERN = r"(?iu)\s+logo\s*$"
COMMUTE_PATTERN = r"(?iu)^\d+\s*(?:min(?:ute)?n?|stunden?|hours?)\s+ab\b"
BARE_EMPLOYMENT_PATTERN = r"(?imu)^\s*((?:Teilzeit,\s*)?Vollzeit|Teilzeit|Full[- ]time|Part[- ]time)\s*$"
PUBLISHED_PATTERN = r"(?imu)^\s*(?:>\s*)?(?:Veröffentlichungsdatum|Published)\s*:\s*(.+?)\s*$"
PROSE_COMPANY_PATTERN = r"(?imu)^\s*(?:Die|Bei)\s+([A-ZÄÖÜ][^\r\n.!?]{1,160}?\b(?:FORMS))\b"  # FORMS stands for the legal forms
COMPANY_LINE_PATTERN = r"(?imu)^\s*(?:>\s*)?([^\r\n]{2,180}\b(?:FORMS))\s*$"  # FORMS stands for the legal forms
COMPANY_SITE_LINK_PATTERN = (
    r"(?isu)\[\s*(?:!\[[^\]]*\]\([^)]+\)\s*)*([^\[\]\r\n]{2,200}?)\s*\]"
    r"\(https?://(?:www\.)?join\.com/companies/[^)]+\)"
)

# --- fixed values: patterns of years of experience -----------------------------
NUMBER_PATTERN = r"\d+(?:[.,]\d+)?"
# NUMBER stands for the number pattern, WORDS for the number words
REQUIRED_YEARS_PATTERN = (
    r"(?:mindestens|min\.|at\s+least|minimum|mehr\s+als|over)?\s*"
    r"(NUMBER(?:\s*(?:bis|-|–)\s*NUMBER)?|WORDS)\s*"
    r"(?:jahr(?:e|en)?|years?)\s*(?:of\s+)?(?:berufs?\s*|profession(?:al)?\s+)?"
    r"(?:erfahrung|experience)"
)
YEARS_CONNECTOR_PATTERN = r"(?iu)^\s*(?:with|of|in|and|oder|mit|sowie|für)\s+"
SENIORITY_YEARS_PATTERN = (
    r"(?iu)\b(?:mindestens|mind\.?|at least|minimum|over|mehr als)?\s*(\d+(?:[.,]\d+)?)"
    r"(?:\s*(?:bis|-|–)\s*\d+(?:[.,]\d+)?)?\s*(?:\+|plus)?\s*(?:jahr(?:e|en)?|years?)\s*(?:of\s+)?"
    r"(?:berufs?|professional)?\s*(?:erfahrung|experience)\b"
)
ROLE_PREFIX_PATTERN = (
    r"(?iu)^.*?(?:your role|the role|position|we are looking for|you will be|mission|"
    r"responsibilities)\s*[:\-]?\s*"
)
MATCH_YEARS_PATTERN = (
    r"(?iu)(\d+(?:[.,]\d+)?)\s*(?:\+|plus)?\s*(?:jahr(?:e|en)?|years?)\s*(?:of\s+)?"
    r"(?:berufs?\s*|profession(?:al)?\s+)?(?:erfahrung|experience)"
)
YEARS_TAG_PATTERN = r"^min_years:(\d+(?:[.,]\d+)?)$"
WRITTEN_YEARS_PATTERN = r"(?U)\bJahre:\s*(\d+(?:[.,]\d+)?)"
