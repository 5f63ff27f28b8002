"""Rule registry, thresholds and scoring constants. Everything in this file is a FIXED VALUE."""

# ---- fixed values: rule thresholds ---------------------------------------------------------
DECODE_DEPTH_MIN = 2
TLD_RISK_MIN = 0.9
TYPOSQUAT_DISTANCE = 1

# ---- fixed values: lure patterns of session-relay kits -------------------------------------
AITM_PATTERNS = [
    "m365[-_]?login", "office365[-_]?secure", "microsoft[-_]?online", "outlook[-_]?security",
    "azure[-_]?ad[-_]?login", "sso[-_]?mail", "webmail[-_]?login", "okta[-_]?verify",
    "duo[-_]?security", "gmail[-_]?signin", "apple[-_]?id[-_]?signin",
]

HIGH_RISK, SUSPICIOUS, CLEAN = "HIGH_RISK", "SUSPICIOUS", "CLEAN"
LAYER1_VERDICTS = [HIGH_RISK, SUSPICIOUS, CLEAN]

# ---- fixed values: rule name, severity, technique ids, description; registry order matters --
RULES = [
    ("ip_url", HIGH_RISK, ["T1071.001"], "URL uses raw IP address instead of domain name"),
    ("idn_punycode", HIGH_RISK, ["T1036.007"], "URL contains Punycode (xn--) — IDN homograph attack"),
    ("multi_encoded", HIGH_RISK, ["T1027.001"], "URL encoded 2+ times (multi-layer obfuscation)"),
    ("aitm_pattern", HIGH_RISK, ["T1557"], "URL matches known AiTM phishing kit pattern"),
    ("brand_spoof_sus_tld", HIGH_RISK, ["T1583.001", "T1566.002"],
     "Brand name in path AND URL on suspicious TLD"),
    ("ip_with_login", HIGH_RISK, ["T1071.001", "T1566.002"], "IP-based URL with login/auth keywords"),
    ("embedded_credentials", SUSPICIOUS, ["T1566.002"],
     "URL contains @ character (credential embedding pattern)"),
    ("typosquat", HIGH_RISK, ["T1566.002"], "Domain Levenshtein distance == 1 from known brand"),
]
RULE_NAMES = [r[0] for r in RULES]

# ---- fixed values: ensemble and hybrid scoring ---------------------------------------------
BOOST_WEIGHT, FOREST_WEIGHT = 0.5001, 0.4999
DECISION = 0.5
TRUSTED_LIMIT, TRUSTED_SCORE = 0.3, 0.15
ESCALATION_FLOOR = 0.55
AGREEMENT_BONUS = 0.05

# Severity levels from the highest, with the lowest score of each.
SEVERITY = [("CRITICAL", 0.90), ("HIGH", 0.70), ("MEDIUM", 0.40), ("LOW", 0.20), ("SAFE", None)]
VERDICTS = [name for name, _ in SEVERITY]
DETECTED_VERDICTS = ["CRITICAL", "HIGH", "MEDIUM"]

# ---- fixed values: model settings ----------------------------------------------------------
SEED = 42
BOOST_PARAMS = {"maxIter": 300, "maxDepth": 8, "stepSize": 0.1}
FOREST_PARAMS = {"numTrees": 300, "maxDepth": 20, "featureSubsetStrategy": "sqrt"}
BOOST_GRID = {"maxIter": [100, 200, 300, 500], "maxDepth": [4, 6, 8, 10], "stepSize": [0.05, 0.1, 0.2]}
FOREST_GRID = {"numTrees": [100, 200, 300, 500], "maxDepth": [10, 15, 20, 30],
               "featureSubsetStrategy": ["sqrt", "log2", "0.5"]}

# ---- fixed values: mutation material -------------------------------------------------------
BENIGN_SUBDOMAINS = ["www", "secure", "login", "account", "support", "portal"]
BENIGN_PATHS = ["/legal", "/privacy", "/terms", "/about", "/help"]
REMOVED_KEYWORDS = ["login", "verify", "account", "secure", "update", "confirm", "auth"]
KEYWORD_REPLACEMENT = "page"
COMBINED_SKIP = 0.4
MUTATIONS = ["subdomain_padding", "https_laundering", "path_dilution", "keyword_removal", "combined"]
