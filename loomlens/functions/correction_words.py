"""Word lists of the nine score corrections, and where each list is used. They are found as substrings of lower-cased texts."""

# Goal 17. Local government, what is no partnership, and what is one.
LOCAL_17 = (
    "council", "shire", "municipality", "shire council", "city council", "municipal", "local government", "councillor", "mayor", "councilor",
    "community hall", "town hall", "local council", "council staff", "council meeting", "council resolution", "council decision",
)
EXCLUDED_17 = (
    "drainage upgrade", "drainage", "road upgrade", "road works", "infrastructure project", "construction", "upgrade completed", "bridge", "road", "transport",
    "infrastructure", "widening", "reinstatement", "land", "quary", "quarry", "financial report", "financial statement", "evaluate", "presentation", "inventories",
    "receivables", "depreciation", "assets", "accounting", "valuation", "capitalised", "contributions plan", "section 7.11", "development contributions",
    "library restoration", "library", "community centre", "community center", "community facility", "community hub", "community program", "community funding",
    "community scheme", "community project", "disability", "inclusion", "participation of people", "accessible", "people with disability", "diverse backgrounds",
    "business continuity", "administration centre", "digital screens", "internal operations", "staff training", "employee", "motor vehicle", "commuting",
    "vehicle provided", "management services", "service delivery", "ongoing support", "strategic plan", "action plan", "compliance", "monitoring", "reviewed",
    "assessed", "reporting period", "estimated", "costs", "subject to",
)
TRUE_17 = (
    "global partnership", "international cooperation", "overseas aid", "foreign aid", "development assistance", "united nations", "un dp",
    "global partnership for sustainable development", "north-south", "south-south cooperation", "technology transfer", "international development", "oda",
    "official development assistance", "multilateral", "bilateral aid", "least developed countries", "ldc", "developing nations", "third world",
    "international organization", "world bank", "asian development bank", "ausaid", "dfat", "international aid", "humanitarian", "overseas development",
    "regional coordination", "strategic alliance", "joint initiative", "in partnership with", "in collaboration with", "partner councils", "constituent councils",
    "on behalf of councils", "inter-council", "multi-stakeholder", "public-private partnership", "funding scheme", "community funding scheme", "joint funding",
    "shared services", "regional partnership", "regional initiative",
)
# What of goal 17 belongs to goals 11, 16, 8, 10 and 9.
TO_11_OF_17 = ("community", "volunteer", "hall", "facility", "road", "bridge", "infrastructure", "transport")
TO_16_OF_17 = ("business continuity", "administration", "internal", "financial", "review", "audit", "statement", "governance", "compliance")
TO_8_OF_17 = ("staff", "training", "employment", "job", "vehicle", "commuting")
TO_10_OF_17 = ("disability", "inclusion", "accessible", "diverse")
TO_9_OF_17 = ("road", "bridge", "infrastructure", "construction")

# Goal 11. Sustainable towns, what is no such thing, and what belongs to goals 3, 1, 8, 3 and 16.
TRUE_11 = (
    "affordable housing", "slum upgrading", "informal settlement", "adequate housing", "housing services", "homelessness", "housing affordability", "housing program",
    "public transport", "sustainable transport", "transport accessibility", "mass transit", "bus rapid transit", "light rail", "metro", "transport system",
    "urban planning", "city planning", "land use", "zoning", "participatory planning", "integrated settlement", "inclusive urbanization", "urban growth",
    "settlement planning", "cultural heritage", "natural heritage", "heritage preservation", "heritage conservation", "historic preservation", "heritage site",
    "disaster risk", "disaster resilience", "emergency management", "flood mitigation", "bushfire", "climate adaptation", "disaster recovery", "air quality",
    "municipal waste", "waste management", "pm2.5", "particulate matter", "waste collection", "controlled disposal", "environmental impact", "urban environment",
    "green space", "public space", "urban park", "playground", "accessible space", "inclusive public space", "open space", "resilient", "sustainable city",
    "sustainable urban", "climate resilient", "net zero", "carbon neutral", "energy efficient", "liveable", "sustainable settlement", "urban sustainability",
)
EXCLUDED_11 = (
    "community service", "community hall", "community centre", "community event", "community festival", "community program", "community group", "volunteer",
    "community volunteer", "community meeting", "community activity", "council meeting", "council decision", "council resolution", "administrative", "business license",
    "rate collection", "council staff", "council operations", "provides services for residents", "provides services for ratepayers",
    "services for residents and ratepayers", "internal review", "business continuity", "management services", "administration centre", "governance framework",
    "transparency", "internal operations", "financial statements", "strong and ethical civic leadership", "civic leadership", "financial report",
    "financial sustainability", "audit", "going concern", "annual report", "financial position", "revenue ratio", "controlled revenue", "revenue and rating plan",
    "rating plan", "rating structure", "information technology", "it systems", "erp system", "database", "software", "technology platform", "strategic plan",
    "corporate plan", "annual plan", "strategic framework", "delivery program", "community hub", "disability inclusion action plan", "diap", "social service",
    "welfare", "aged care", "child care", "disability service", "community care", "social support", "recreational", "sports club", "leisure centre", "gym",
    "fitness program", "sports program",
)
TO_3_OF_11 = ("health", "medical", "hospital", "clinic")
TO_1_OF_11 = ("welfare", "social service", "support service")
TO_8_OF_11 = ("employment", "job", "workforce", "training")
PLAY_OF_11 = ("recreational", "sport", "fitness", "leisure")
TO_16_OF_11 = ("internal review", "business continuity", "governance", "transparency", "administration", "financial statements")
# Goal 11's other requirements.
ACTION_11 = (
    "implement", "deliver", "complete", "construct", "build", "establish", "create", "develop", "install", "upgrade", "provide", "manage", "maintain", "operate", "run",
    "funded", "completed", "delivered", "established", "created",
)
TOWN_11 = ("community", "city", "urban", "town", "municipal", "settlement")

# Goal 14. Roads, works, places by the sea, words of the coast, verbs of works, marks of a location, and what is marine.
ROADS_14 = (
    "road", "street", "ave", "avenue", "drive", "way", "lane", "place", "highway", "motorway", "freeway", "boulevard", "circuit", "court", "parade", "crescent", "close",
    "trail", "track", "route", "improvements", "upgrade", "maintenance", "construction", "works", "project", "redevelopment", "widening", "resurfacing", "path", "pathway",
)
WORKS_14 = (
    "road", "street", "bridge", "pathway", "footpath", "cycleway", "drainage", "sewer", "water main", "pipe", "culvert", "construction", "upgrade", "improvement",
    "redevelopment", "maintenance", "repair", "resurface", "widening", "extension", "parking", "car park", "traffic", "transport", "bus stop", "walkway", "boardwalk",
    "promenade", "esplanade",
)
PLACES_14 = (
    "byron bay", "byron", "brunswick heads", "brunswick", "ballina", "coffs harbour", "coffs", "port macquarie", "port stephens", "newcastle", "wollongong", "shellharbour",
    "sutherland", "cronulla", "bondi", "coogee", "manly", "dee why", "narrabeen", "terrigal", "the entrance", "batemans bay", "merimbula", "eden", "yamba", "woolgoolga",
    "sawtell", "nambucca", "macleay", "hastings", "tweed heads", "cabarita", "kingscliff", "pottsville", "lennox head", "evans head", "geelong", "torquay", "lorne",
    "apollo bay", "queenscliff", "sorrento", "mornington", "frankston", "warrnambool", "phillip island", "wilsons promontory", "lakes entrance", "sale", "gold coast",
    "sunshine coast", "noosa", "maroochydore", "caloundra", "hervey bay", "gladstone", "rockhampton", "townsville", "cairns", "glenelg", "victor harbor", "port lincoln",
    "whyalla", "fremantle", "perth", "mandurah", "bunbury", "geraldton", "hobart", "launceston", "devonport", "burnie", "heads", "point", "bay", "beach", "cove", "haven",
)
COAST_14 = ("beach", "coast", "coastal", "bay", "harbour", "harbor", "head", "heads", "point", "cove", "haven")
VERBS_14 = ("improve", "upgrade", "construct", "build", "repair", "maintain", "redevelop", "widen", "extend")
WHERE_14 = ("at", "in", "near", "of", "for")
TRUE_14 = (
    "marine conservation", "marine protected area", "marine park", "marine sanctuary", "marine reserve", "marine biodiversity", "ocean conservation", "marine ecosystem",
    "coral reef", "seagrass", "mangrove", "saltmarsh", "wetland restoration", "estuary restoration", "marine pollution", "ocean pollution", "marine debris",
    "coastal water quality", "estuarine water quality", "stormwater discharge", "marine water quality", "sustainable fishing", "fisheries management",
    "fishing sustainability", "marine resources", "aquaculture", "oyster", "prawn fishery", "recreational fishing management", "commercial fishing", "coastal protection",
    "coastal erosion", "coastal management", "coastal hazard", "sea level rise", "coastal adaptation", "beach nourishment", "dune restoration", "foreshore protection",
    "marine monitoring", "coastal monitoring", "water quality monitoring", "marine biodiversity survey", "marine health", "ocean health", "international waters",
    "marine biodiversity beyond", "intertidal", "subtidal", "pelagic", "benthic", "rocky reef", "kelp forest", "sponge garden", "sea floor",
)

# Goal 4, education.
TRUE_4 = (
    "school", "education", "learning", "teaching", "curriculum", "student", "teacher", "classroom", "kindergarten", "preschool", "university", "college", "training program",
    "vocational", "literacy", "scholarship", "enrollment", "graduation",
)
EXCLUDED_4 = (
    "arts", "art gallery", "cultural event", "museum", "exhibition", "performance", "concert", "festival", "theatre", "theater", "sports", "rugby", "football", "cricket",
    "athletics", "player", "former player", "representative", "league", "game", "match", "soccer", "sporting", "recreation club", "youth week", "youth engagement",
    "migrant community", "community support", "community group", "community program", "parent support", "parenting", "family support group", "councillor", "council meeting",
    "governance", "committee chair", "advocacy", "policy", "advocate", "playground", "construction", "infrastructure project", "facility upgrade", "capital works",
    "building project", "asset management", "wildflower garden", "environmental education", "nature program", "biodiversity", "conservation program",
)

# Goal 6, water.
TRUE_6 = (
    "drinking water", "water supply", "water quality", "sanitation", "wastewater treatment", "sewage", "sewer", "water treatment", "water infrastructure", "water service",
    "potable water", "water management", "water resource", "dam", "reservoir", "groundwater", "surface water", "water conservation", "rainwater harvesting",
    "water recycling", "grey water",
)
EXCLUDED_6 = (
    "culvert", "constructed culvert", "drainage infrastructure", "stormwater drain", "stormwater drainag", "drainage upgrade", "road drainage", "drainage system",
    "drainage works", "construction of", "construction project", "civil works", "road works", "bridge construction", "footpath construction", "infrastructure upgrade",
    "infrastructure works", "asset renewal",
)
TO_11_OF_6 = ("culvert", "drainage", "stormwater", "road", "bridge", "footpath", "infrastructure")

# Goal 8, the economy.
TRUE_8 = (
    "employment", "jobs", "workforce", "economic development", "tourism", "business support", "industry", "trade", "local economy", "job creation", "skills development",
    "workplace", "training program", "employment services",
)
EXCLUDED_8 = (
    "financial statement", "audit fees", "depreciation", "financial liability", "carrying amount", "impairment", "valuation", "fair value", "cost index", "commissions",
    "licencing", "ticket sales", "revenue", "grants program", "event grants", "funding to community", "going concern", "financial report", "financial position",
    "financial sustainability", "controlled revenue", "revenue ratio", "annual report", "internal control", "governance", "councillor", "council", "deliver actions",
    "action plan", "strategic plan", "business plan", "corporate", "strategic framework", "delivery program", "workplace health and safety", "whs obligations",
    "safety management", "workplace safety", "safety obligations", "staff recruitment", "staff housing", "people culture", "systems", "reserve fund", "housing reserve",
    "learning and participation", "library branches", "library services", "educational institution", "student placement", "kindergarten", "early learning",
    "early childhood education", "social enterprise", "community partnership", "partner with social", "skills development and training", "training opportunities",
    "vocational training", "workforce development program",
)

# Goal 10, inequality.
TRUE_10 = (
    "inequality", "disability", "inclusion", "diversity", "accessible", "marginalized", "vulnerable", "disadvantaged", "social inclusion", "equal opportunity",
    "discrimination", "minority", "refugee", "people with disability", "access for all", "inclusive", "disability inclusion action plan", "diap", "accessibility plan",
)
EXCLUDED_10 = (
    "liquidity", "depreciation", "asset value", "fair value", "financial liability", "carrying amount", "impairment", "cost index", "valuation", "benchmark",
    "financial statements", "target", "ratio", "percentage", "heritage", "cultural heritage", "history", "historical", "historical society", "museum", "archives",
    "cultural event", "history & heritage", "indigenous", "reconciliation",
)

# Goal 12, consumption.
TRUE_12 = (
    "waste", "recycling", "recycle", "sustainable consumption", "circular economy", "waste management", "composting", "landfill", "reuse", "reduce", "waste reduction",
    "waste diversion", "green procurement", "sustainable production", "zero waste", "waste collection", "waste disposal", "recyclable",
)
EXCLUDED_12 = (
    "fair value", "depreciation", "valuation", "asset value", "cost index", "carrying amount", "impairment", "revaluation", "financial statements", "accounting", "audit",
    "balance sheet", "inventories", "receivables", "capitalised", "amortisation", "financial report", "financial position", "cash flow", "auditors' report",
    "auditor's report", "internal audit", "quality assurance", "kpi monitoring", "monitoring of agreed kpis", "audit committee", "external audit", "audit report",
    "authorised for issue", "independent accounting", "benchmark", "ratio", "percentage", "measurement", "service delivery", "management services", "annual report",
    "business plan", "corporate", "strategic plan", "environmental sustainability", "social and economic needs", "environmental, social", "sustainability framework",
)

# Goal 16, institutions.
TRUE_16 = (
    "governance", "transparency", "accountability", "audit committee", "risk management", "internal audit", "code of conduct", "ethics", "anti-corruption", "disclosure",
    "compliance", "regulatory", "councillor", "elected member", "council meeting", "council resolution", "public participation", "community engagement", "stakeholder",
    "policy development", "strategic planning", "business continuity", "fraud prevention", "whistleblower", "conflict of interest",
)
EXCLUDED_16 = (
    "condition survey", "road survey", "footpath survey", "infrastructure condition", "asset condition", "asset management", "road maintenance", "footpath maintenance",
    "bridge maintenance", "infrastructure inspection", "asset inspection", "procurement dashboard", "procurement activity", "tender activity", "procurement process",
    "purchasing", "supply chain", "market approach", "fair value measurement", "valuation method", "financial indicator", "financial metrics", "ratio analysis",
    "carrying amount", "impairment test", "depreciation", "administrative support", "general administration", "office management", "clerical",
)
TO_11_OF_16 = ("road", "footpath", "bridge", "infrastructure", "asset", "facility", "building")
TO_12_OF_16 = ("procurement", "tender", "purchasing", "supply")
