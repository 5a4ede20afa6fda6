"""Word lists, thresholds and weights of the goal analysis. They are parameters everywhere; these are the defaults."""

# Words that open a fragment, and demonstratives that need what went before.
DEPENDENT_STARTERS = ("given", "although", "while", "whereas", "since", "unless", "until", "whether", "once", "though", "because", "after", "before", "when", "if", "even", "despite", "notwithstanding", "providing", "assuming", "supposing", "granted", "albeit")
DEMONSTRATIVES = ("this", "these", "those", "such")

# Section types in the order in which they are tried.
SECTIONS = (
    ("environmental", ("environment", "sustainability", "climate", "carbon", "green", "conservation", "biodiversity", "ecosystem", "renewable")),
    ("social", ("community", "social", "health", "wellbeing", "education", "culture", "recreation", "sport", "youth", "elderly", "disability", "indigenous", "aboriginal")),
    ("economic", ("economic", "business", "employment", "jobs", "tourism", "investment", "development", "growth", "enterprise")),
    ("infrastructure", ("infrastructure", "roads", "buildings", "facilities", "transport", "utilities", "maintenance", "construction")),
    ("governance", ("governance", "council", "meeting", "policy", "strategy", "plan", "report", "performance", "audit")),
)

# Markers that make a statement specific.
SPECIFICITY = ("for", "in", "at", "with", "to", "community", "residents", "people", "families", "area", "region", "town", "city")

# Page headers and footers, matched from the start of a line, whatever the case.
HEADER_PATTERNS = (
    r"^\d+$", r"^\d+\s+of\s+\d+$", r"^page\s+\d+$", r"^\d+\s*/\s*\d+$", r"^(?:annual\s+report|report\s+annual)$", r"^\d{4}[-–/]\d{2,4}$", r"^\d{4}\s+annual\s+report$",
    r"^annual\s+report\s+\d{4}$", r"^\d{4}[-–]\d{2}\s+annual\s+report$", r"^financial\s+(?:statements?|summary|report)", r"^service\s+performance\s+indicators?", r"^for\s+the\s+year\s+ended\s+\d+", r"^performance\s+statement",
)

# The thresholds of goals 1 to 17 by mode, and the default.
THRESHOLDS = {
    "sentence_transformer": (0.52, (0.653, 0.564, 0.610, 0.484, 0.631, 0.628, 0.585, 0.443, 0.459, 0.639, 0.158, 0.615, 0.542, 0.602, 0.641, 0.610, 0.036)),
    "sdgbert": (0.8, (0.862, 0.890, 0.800, 0.790, 0.770, 0.916, 0.830, 0.710, 0.630, 0.810, 0.733, 0.860, 0.768, 0.948, 0.944, 0.790, 0.550)),
    "hybrid": (0.75, (0.928, 0.820, 0.840, 0.740, 0.830, 0.945, 0.860, 0.730, 0.691, 0.748, 0.459, 0.738, 0.765, 0.973, 0.869, 0.740, 0.059)),
}

# The second model's weight by goal 1 to 17; the first model has the rest.
MODEL_WEIGHTS = (0.516, 0.527, 0.518, 0.566, 0.499, 0.514, 0.503, 0.728, 0.571, 0.643, 0.638, 0.599, 0.494, 0.526, 0.505, 0.631, 0.689)

# Keywords (found as substrings) that raise a goal's score, and by how much.
BOOSTS = {
    3: (("health", "medical", "wellbeing", "well-being", "caps", "early intervention", "mental health", "healthcare"), 0.20),
    12: (("waste", "recycling", "recycle", "depot", "reuse", "sustainable consumption", "circular economy", "waste management"), 0.20),
    13: (("emissions", "carbon", "climate action", "renewable energy", "solar", "wind power", "greenhouse"), 0.20),
    14: (("marine", "ocean", "fisheries", "coastal", "water pollution", "sea"), 0.20),
    16: (("governance", "transparency", "accountability", "internal review", "business continuity", "audit", "financial statements", "councillor", "ethics", "code of conduct", "anti-corruption", "disclosure"), 0.25),
}

# Weights of goals by section.
SECTION_WEIGHTS = {
    "environment": {6: 1.5, 7: 1.5, 11: 1.3, 12: 1.5, 13: 1.5, 14: 1.4, 15: 1.4},
    "community": {1: 1.2, 2: 1.2, 3: 1.4, 4: 1.4, 5: 1.3, 10: 1.4, 11: 1.3, 16: 1.3, 17: 1.2},
    "economic": {1: 1.2, 8: 1.5, 9: 1.4, 10: 1.2, 12: 1.2, 17: 1.3},
    "infrastructure": {6: 1.3, 7: 1.4, 9: 1.5, 11: 1.5},
    "planning": {9: 1.3, 11: 1.5, 15: 1.2},
    "governance": {10: 1.3, 11: 1.2, 16: 1.5, 17: 1.4},
    "finance": {1: 1.3, 8: 1.3, 10: 1.2, 17: 1.3},
}

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "ave", "blvd", "rd", "inc", "ltd", "corp", "llc", "eg", "ie", "etc", "vol", "vols",
    "pg", "pp", "ed", "eds", "no", "nos", "fig", "figs", "et al",
)

# Words that keep a text from being generic: verbs as whole words, the rest as substrings.
PRIORITY_VERBS = (
    "implement", "deliver", "complete", "construct", "build", "establish", "create", "launch", "initiate", "introduce", "develop", "install",
    "upgrade", "renew", "refurbish", "purchase", "acquire", "commission", "open", "start", "appoint", "award", "grant", "fund",
    "implemented", "delivered", "completed", "constructed", "built", "established", "created", "launched", "initiated", "introduced", "developed", "installed",
    "upgraded", "renewed", "refurbished", "purchased", "acquired", "commissioned", "opened", "started", "appointed", "awarded", "granted", "funded",
)
SPECIFIC_TERMS = (
    "council", "councils", "councillor", "councillors", "shire", "city", "municipality", "local government", "we", "our", "mayor", "lord mayor",
    "library", "libraries", "waste", "recycling", "roads", "childcare", "planning permit", "building permit", "parking", "pool", "sport", "park", "facility", "facilities", "aged care", "community center", "community centre", "wastewater", "sewer", "drainage", "footpath", "street", "playground", "reserve", "hall", "venue", "service",
    "sustainable", "climate", "environment", "community", "health", "education", "infrastructure", "economic", "social", "partnership", "innovation", "biodiversity", "renewable", "waste", "recycling", "wellbeing", "inclusion", "diversity", "accessibility", "conservation",
    "nbn", "telstra", "state government", "federal government", "australian government", "nsw government", "victorian government", "queensland government", "services australia", "centrelink",
)

# Outcomes in figures, whatever the case.
OUTCOMES = (r"\d+\s*(?:percent|%|people|households|residents|jobs|tonnes|units)", r"\$[\d,]+(?:\.\d{2})?", r"(?:increased|decreased|reduced|improved)\s+by\s+\d+")

# Accounts, audits, compliance, personnel and descriptions, matched on lower-cased text; those with a capital I match nothing, as in the original.
NON_ACTIVITY = (
    r'\bthese\s+(past\s+service\s+)?(general\s+purpose\s+)?financial\s+statements?\s+(have\s+been\s+)?(prepared|are)\b',
    r'\bfinancial\s+statements?\s+have\s+been\s+prepared\s+in\s+accordance\s+with\b',
    r'\bnotes\s+to\s+the\s+financial\s+statements\b',
    r'\babout\s+the\s+notes\s+to\s+the\s+financial\s+statements\b',
    r'\bcontingencies?\s*\(continued\)\b',
    r'\baustralian\s+accounting\s+standards?\b',
    r'\bjudgements?\s+and\s+assumptions\s+made\s+by\s+management\b',
    r'\bmaterial\s+misstatements?\s+are\s+considered\s+material\s+if\b',
    r'\ball\s+(assets|liabilities)\s+for\s+which\s+fair\s+value\s+is\s+measured\b',
    r'\bfair\s+value\s+hierarchy\b',
    r'\baccrued\s+liabilities?\s+are\s+(used|assessed|maintained)\b',
    r'\bpast\s+service\s+contributions?\s+are\s+used\b',
    r'\bfunding\s+position\s+for\s+(the\s+)?accrued\s+liabilities\b',
    r'\bdefined\s+benefit\s+(scheme|superannuation|liabilities?)\b',
    r'\bvision\s+super\s+(has\s+advised|advises)\b',
    r'\bactuarial\s+(investigation|assessment|report)\s+(was\s+)?(held|conducted|completed)\b',
    r'\bservice\s+cost\s*\$\d{1,3}(,\d{3})*\.\d{2}\b',
    r'\bindependent\s+auditor["\']?s?\s+report\s+(to\s+the\s+councillors?)\b',
    r'\b(independent\s+)?auditor["\']?s?\s+report\s*[:\-]\s*\bto\s+the\b',
    r'\bconducted\s+my\s+audit\s+in\s+accordance\s+with\s+the\s+audit\s+act\b',
    r'\bbasis\s+(for\s+opinion|of\s+opinion)\s*[:\-]\s*\bI\s+have\s+conducted\b',
    r'\bopinion\s+on\s+the\s+financial\s+statements?\b',
    r'\bmisstatements?\s+are\s+considered\s+material\s+if\b',
    r'\bI\s+communicate\s+with\s+the\s+councillors\s+regarding\b',
    r'\bkey\s+areas\s+of\s+focus\s+for\s+the\s+audit\s+committee\s+during\s+the\s+year\s+were\b',
    r'\bthe\s+planned\s+scope\s+and\s+timing\s+of\s+the\s+audit\b',
    r'\ba\s+risk\s+based\s+four-year\s+strategic\s+internal\s+audit\s+plan\s+is\s+revised\b',
    r'\bcouncil["\']?s?\s+internal\s+audit\s+function\s+provides\b',
    r'\bparliament\s+promotes\s+independence\s+by\s+ensuring\s+the\s+auditor-general\b',
    r'\bin\s+accordance\s+with\s+section\s+\d+[a-z]*\s+(and\s+\d+[a-z]*)?\s+of\s+the\s+\w+\s+act\b',
    r'\bthe\s+\w+\s+act\s+\d{4}\s+(provides|states|requires)\s+(that|for|a)\s+council\b',
    r'\ba\s+council\s+that\s+is\s+a\s+(collecting|development)\s+agency\s+must\b',
    r'\bthe\s+report\s+must\s+be\s+published\s+in\b',
    r'\bsection\s+\d+\s+of\s+the\s+\w+\s+act\s+\d{4}\s+provides\s+for\b',
    r'\bperformance\s+statement\s+certification\b',
    r'\bin\s+my\s+opinion\s*,?\s+the\s+(accompanying\s+)?(performance\s+statement|schedule)\s+is\s+prepared\b',
    r'\bthe\s+report\s+also\s+includes\s+some\s+information\s+that\s+is\s+prescribed\b',
    r'\boperational\s+plan\s*\(\s*combined\s+document\s*\)\s+is\s+designed\s+as\b',
    r'\b(manager|executive|officer)\s+[a-z\s]+\s+(public\s+and\s+environmental\s+health|strategic\s+planning)\s*$',
    r'\bofficers?\s+reporting\s+directly\s+to\b',
    r'\borganisational\s+structure\s+(at|during)\s+(30\s+june|\d{4})\b',
    r'\bsenior\s+officers?\s+reporting\b',
    r'\b(local\s+)?laws?\s+officer\s+(completed|finished)\s+training\b',
    r'\bdirector\s+(of\s+)?(assets|customer|community|engineering)\s+[a-z\s]+director\b',
    r'^the\s+(council|shire|municipality|community|region|area)\s+is\s+(a|located|situated|in)\b',
    r'^there\s+(is|was|were)\s+(no|not)\s+\w+\s+(that|which)\b',
    r'\bthis\s+consultation\s+was\s+the\s+first\s+step\b',
    r'\bcouncil\s+has\s+adopted\s+the\s+principle\s+of\s+[\'"]competitive\s+neutrality[\'"]',
)

# Marks of tables of contents and of disclaimers.
CONTENTS = ("contents", "table of contents", "page", "introduction", "section")
DISCLAIMERS = ("disclaimer", "this report is provided for information", "does not purport to be complete")

# Terms of the goals that raise a statement's relevance.
GOAL_TERMS = (
    "sustainable", "climate", "environment", "community", "health", "education", "infrastructure", "economic", "social", "partnership", "innovation", "biodiversity", "renewable",
    "waste", "recycling", "wellbeing", "inclusion", "diversity", "accessibility", "conservation",
)

# Verbs of ordinary and of weak statements.
STANDARD_VERBS = (
    "improve", "enhance", "expand", "upgrade", "design", "plan", "strategize", "manage", "coordinate", "facilitate", "support", "provide", "engage", "collaborate", "partner",
    "consult", "involve", "promote", "encourage", "enable", "empower", "strengthen", "maintain", "preserve", "protect", "conserve", "monitor", "evaluate", "assess", "prepare",
    "produce", "publish", "release", "communicate", "update", "review", "adopt", "approve", "endorse",
    "improved", "enhanced", "expanded", "designed", "planned", "strategized", "managed", "coordinated", "facilitated", "supported", "provided", "engaged", "collaborated",
    "partnered", "consulted", "involved", "promoted", "encouraged", "enabled", "empowered", "strengthened", "maintained", "preserved", "protected", "conserved", "monitored",
    "evaluated", "assessed", "prepared", "produced", "published", "released", "communicated", "updated", "reviewed", "adopted", "approved", "endorsed",
)
WEAK_VERBS = (
    "was", "were", "is", "are", "been", "be", "being", "had", "has", "have", "consider", "considered", "review", "reviewed", "discuss", "discussed", "note", "noted",
    "acknowledge", "acknowledged", "recognize", "recognized", "identify", "identified", "analyze", "analyzed", "examine", "examined", "reflect", "reflected", "appear",
    "appeared", "seem", "seemed", "remain", "remained", "continue", "continued",
)

# First words that lean on the sentence before: references and continuations. Words that open a fragment lean on it too.
LEANING = (
    "this", "it", "the", "these", "those", "which", "that", "such", "and", "or", "but", "also", "additionally", "furthermore", "moreover", "therefore", "thus", "consequently",
    "as", "with", "however", "further", "similarly", "likewise", "meanwhile", "subsequently", "alternatively", "nevertheless", "nonetheless", "otherwise", "instead", "besides",
    "accordingly",
)

# Words of section titles.
SECTION_TITLES = (
    ("environment", ("environment", "sustainability", "climate", "carbon", "green", "conservation", "biodiversity", "ecosystem", "waste", "recycling")),
    ("community", ("community", "social", "health", "wellbeing", "education", "culture", "recreation", "sport", "youth", "seniors", "disability", "indigenous", "aboriginal", "diversity")),
    ("economic", ("economic", "business", "employment", "jobs", "tourism", "investment", "development", "growth", "enterprise", "commerce")),
    ("infrastructure", ("infrastructure", "roads", "buildings", "facilities", "transport", "utilities", "maintenance", "construction", "engineering", "public works")),
    ("planning", ("planning", "urban design", "zoning", "land use", "housing", "development applications", "building permits", "strategic planning")),
    ("governance", ("governance", "council", "meeting", "policy", "strategy", "performance", "audit", "compliance", "risk", "transparency")),
    ("finance", ("financial", "budget", "revenue", "expenditure", "audit", "accounting", "funding", "grants", "rates", "fees")),
)
