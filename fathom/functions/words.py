"""Word lists of the text operators. Every operator takes its lists as parameters; these are the defaults."""

# Results depend on exactly these words.

STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "as", "by", "from", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "this", "that", "these", "those", "it", "its", "he", "she", "they",
    "we", "you", "i", "me", "him", "her", "us", "them", "my", "your", "his", "their", "our", "not", "no", "nor", "so",
    "yet", "both", "either", "if", "then", "than", "when", "where", "how", "what", "which", "who", "all", "each",
    "every", "any", "some", "such", "said", "also", "about", "after", "before", "into", "up", "out", "more", "most",
    "just", "over", "new", "per", "its", "s", "t", "re", "ve", "ll", "d",
]

KEYWORD_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "as", "by", "from", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "this", "that", "these", "those", "it", "its", "he", "she", "they",
    "we", "you", "i", "me", "him", "her", "us", "them", "my", "your", "his", "their", "our", "not", "no", "nor", "so",
    "yet", "both", "either", "if", "then", "than", "when", "where", "how", "what", "which", "who", "all", "each",
    "every", "any", "some", "such", "said", "also", "about", "after", "before", "into", "more", "most", "just",
    "over", "new", "per", "s", "t", "re", "ve", "ll", "d", "said", "says", "say",
]

BASE_POSITIVE = [
    "able", "abundance", "accurate", "achieve", "adequate", "advance", "advantageous", "ambitious", "assurance",
    "attractive", "best", "better", "breakthrough", "bright", "broad", "capability", "certainty", "clarity",
    "commitment", "competitive", "confident", "consistent", "credible", "decisive", "dedicated", "deliver",
    "dependable", "desirable", "distinguished", "dominant", "durable", "effective", "efficient", "enable", "enhance",
    "exceptional", "expansive", "experienced", "favorable", "feasible", "flourish", "foremost", "gain", "growing",
    "genuine", "highest", "improved", "innovative", "integrity", "leading", "merit", "notable", "optimal",
    "outstanding", "positive", "powerful", "profitability", "progress", "proven", "quality", "reliable", "resilience",
    "resolve", "robust", "secure", "significant", "skilled", "stable", "steadfast", "strength", "strong", "success",
    "sufficient", "superior", "sustainable", "trusted", "valuable", "viable",
]

BASE_NEGATIVE = [
    "abandon", "abnormal", "accused", "adversely", "alarming", "allege", "allegations", "bankrupt", "bankruptcy",
    "barrier", "breach", "burden", "cease", "challenge", "challenged", "closing", "collapse", "complaint", "concern",
    "constrained", "contamination", "corruption", "crisis", "cutback", "danger", "declining", "default", "deficiency",
    "deficit", "delay", "difficult", "diminished", "disappointment", "disputed", "disruption", "doubt", "downfall",
    "downgrade", "dysfunction", "erode", "excessive", "failed", "failure", "fallout", "faulty", "flawed", "fraud",
    "fraudulent", "guilty", "halt", "harmful", "harm", "idle", "impair", "impairment", "improper", "inaccurate",
    "incident", "insufficient", "irregular", "inadequate", "lack", "layoff", "liability", "litigation", "loss",
    "losses", "miss", "negligence", "obstacle", "outage", "overestimate", "overvalued", "penalty", "poor", "problem",
    "reduced", "rejected", "restriction", "sanction", "scandal", "shortfall", "shortage", "slow", "struggling",
    "suffering", "suspend", "tension", "threat", "troubled", "unable", "uncertain", "unfavorable", "unstable",
    "unusual", "violation", "warning", "weaken", "worsen",
]

MARKET_POSITIVE = [
    "tightening", "tight", "disrupted", "disruption", "outage", "conflict", "sanctions", "sanctioned", "hurricane",
    "attack", "attacked", "shortage", "shortages", "constrained", "constrain", "curtailed", "curtailment", "cuts",
    "cut", "rally", "rallied", "soar", "soared", "surge", "surged", "spike", "spiked", "rebound", "rebounded",
    "recover", "recovery", "war", "warfare", "unrest", "escalation", "escalated", "geopolitical", "threat", "threats",
    "threatened", "restricted", "restriction", "blockade", "blockaded", "refinery outage", "pipeline explosion",
    "tanker attack", "stranded", "supply risk", "supply shock",
]

MARKET_NEGATIVE = [
    "oversupply", "oversupplied", "glut", "surplus", "ample", "excess", "excessive supply", "weakened", "slump",
    "slumped", "plunge", "plunged", "bearish", "slowdown", "recession", "recessionary", "abundant", "easing", "ease",
    "builds", "build", "increase production", "ramp up", "ramping", "inventory build", "stockpile build",
    "demand weakness", "weak demand", "slowing demand", "softening", "overshooting", "gluts",
]

CONTEXT_WORDS = [
    "oil", "crude", "wti", "brent", "petroleum", "energy", "barrel", "barrels", "opec", "refinery", "gasoline",
    "diesel", "fuel", "lng", "natural gas",
]

RISE_WORDS = [
    "rise", "rises", "rising", "rose", "surge", "surges", "surging", "surged", "soar", "soars", "soaring", "soared",
    "jump", "jumps", "jumping", "jumped", "climb", "climbs", "climbing", "climbed", "rally", "rallies", "rallied",
    "gain", "gains", "gaining", "gained", "increase", "increases", "increased", "upturn", "rebound", "rebounds",
    "rebounding", "rebounded", "spike", "spikes", "spiked", "higher", "high", "record", "boost", "boosted",
    "strengthen", "strengthens", "strengthened", "tighten", "tightens", "tightened",
]

FALL_WORDS = [
    "fall", "falls", "falling", "fell", "drop", "drops", "dropping", "dropped", "decline", "declines", "declining",
    "declined", "plunge", "plunges", "plunging", "plunged", "slump", "slumps", "slumped", "tumble", "tumbles",
    "tumbled", "slide", "slides", "sliding", "slid", "decrease", "decreases", "decreased", "lower", "low", "collapse",
    "collapses", "collapsed", "weaken", "weakens", "weakened", "ease", "eases", "eased",
]

TOPIC_KEYWORDS = {
    "opec_production": [
        "opec", "opec+", "opec plus", "production cut", "production cuts", "output cut", "output cuts", "quota",
        "compliance", "saudi arabia", "saudi output", "saudi production", "riyadh", "vienna meeting", "opec meeting",
        "opec decision", "barrel target", "voluntary cut", "production agreement", "production deal", "uae output",
        "kuwait output", "iraq output",
    ],
    "us_production": [
        "shale", "permian", "bakken", "eagle ford", "marcellus", "haynesville", "rig count", "baker hughes",
        "u.s. production", "us production", "american production", "domestic output", "u.s. output", "us output",
        "eia production", "eia output", "u.s. shale", "us shale", "fracking", "frac", "wellbore", "drilling activity",
        "completion activity",
    ],
    "oil_inventories": [
        "inventory", "inventories", "stockpile", "stockpiles", "crude stocks", "crude stockpile", "eia crude",
        "api crude", "cushing", "storage capacity", "storage levels", "oil reserves", "commercial inventory",
        "commercial stocks", "gasoline stocks", "distillate stocks", "draw", "build", "inventory build",
        "inventory draw", "storage draw",
    ],
    "oil_demand": [
        "demand", "consumption", "iea outlook", "iea forecast", "china demand", "asian demand", "global demand",
        "oil consumption", "fuel demand", "gasoline demand", "jet fuel demand", "diesel demand", "aviation demand",
        "economic growth", "gdp growth", "iea report", "demand forecast", "demand outlook", "demand growth",
        "demand slowdown", "demand weakness",
    ],
    "financial_factors": [
        "fed", "federal reserve", "interest rate", "interest rates", "rate hike", "rate cut", "dollar", "us dollar",
        "usd", "inflation", "cpi", "deflation", "monetary policy", "quantitative easing", "yield", "treasury", "bond",
        "recession", "gdp", "hedge fund", "speculative", "futures", "contango", "backwardation", "options",
        "derivatives",
    ],
    "extreme_weather": [
        "hurricane", "tropical storm", "cyclone", "typhoon", "gulf of mexico storm", "winter storm", "freeze",
        "freezing", "cold snap", "polar vortex", "flood", "flooding", "wildfire", "wildfire risk",
        "weather disruption", "severe weather", "extreme weather", "force majeure", "power outage", "pipeline freeze",
    ],
    "pandemics": [
        "covid", "coronavirus", "pandemic", "lockdown", "quarantine", "outbreak", "virus", "epidemic", "WHO",
        "disease", "travel ban", "mobility restriction", "economic shutdown", "demand collapse", "demand destruction",
    ],
    "geopolitical_conflicts": [
        "war", "warfare", "conflict", "military", "airstrike", "missile", "attack", "attacked", "drone strike",
        "sanctions", "sanctioned", "iran", "russia", "ukraine", "middle east", "strait of hormuz", "hormuz",
        "red sea", "houthi", "houthis", "israel", "gaza", "venezuela sanctions", "iran nuclear", "tanker attack",
        "pipeline attack", "refinery attack", "oil facility", "geopolitical", "geopolitical risk",
        "geopolitical tension",
    ],
}

SITE_TERMS = [
    "oil", "crude", "crude oil", "wti", "brent", "petroleum", "oil and gas", "fuel price", "energy products",
]

DRIVER_TERMS = [
    "opec", "opec+", "production", "output cut", "output cuts", "drilling", "rig count", "refinery",
    "refinery outage", "shutdown", "pipeline", "supply disruption", "supply disruptions", "inventory", "inventories",
    "stockpile", "stockpiles", "storage", "exports", "imports", "shipping", "us shipping", "tanker", "tankers",
    "trade flows", "energy policies", "energy policy", "carbon market", "carbon emissions", "emissions",
    "climate change", "energy bill", "national defense", "energy", "pain at the pumps", "commodity markets",
    "gasoline demand", "jet fuel demand", "fuel prices", "war", "conflict", "sanctions", "iran", "russia", "ukraine",
    "middle east", "hormuz", "kuwait", "venezuela", "libya",
]

SITE_TOPICS = {
    "supply": [
        "opec", "opec+", "production", "output cut", "drilling", "rig count", "supply disruption",
        "supply disruptions",
    ],
    "inventory": [
        "inventory", "inventories", "stockpile", "stockpiles", "storage",
    ],
    "refining": [
        "refinery", "refinery outage", "shutdown",
    ],
    "flows": [
        "exports", "imports", "shipping", "us shipping", "tanker", "tankers", "pipeline",
    ],
    "policy": [
        "energy policies", "energy policy", "energy bill", "national defense",
    ],
    "climate": [
        "carbon market", "carbon emissions", "emissions", "climate change",
    ],
    "markets": [
        "commodity markets", "fuel price", "fuel prices", "pain at the pumps",
    ],
    "geopolitics": [
        "war", "conflict", "sanctions", "iran", "russia", "ukraine", "middle east", "strait of hormuz",
    ],
}

DECISION_TERMS = ["production cut", "production increase", "quota", "agreement", "deal"]

BLOCKED_TERMS = [
    "solar", "wind power", "hydroelectric", "tidal energy", "biofuels",
]
