"""Word lists and lookup tables used by the URL features.

Everything in this file is a FIXED VALUE: the feature columns are defined by these exact entries.
"""

# ---- fixed values: URL shortening services -------------------------------------------------
SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do",
    "mcaf.ee", "short.link", "shorturl.at", "rebrand.ly", "tiny.cc", "cutt.ly", "s.id", "rb.gy",
    "soo.gd", "t.ly", "lnkd.in",
]

# ---- fixed values: words that lure a user into a login or payment form ---------------------
LOGIN_KEYWORDS = [
    "login", "signin", "sign-in", "log-in", "logon", "auth", "authenticate", "authentication",
    "account", "accounts", "profile", "user", "customer",
    "verify", "verification", "confirm", "confirmation", "validate", "validation", "authorize",
    "secure", "security", "safety", "protected",
    "banking", "payment", "wallet", "billing", "invoice",
    "update", "reset", "password", "unlock",
    "paypal", "amazon", "apple", "microsoft", "office365", "google", "facebook", "instagram",
    "netflix",
    "selamat", "akaun", "perbankan", "pengesahan", "kemaskini", "kata", "laluan", "masuk", "semak",
    "sahkan", "tuntutan", "hadiah", "wang", "bayaran", "kredit",
]

# ---- fixed values: brands looked for in path, query and fragment ---------------------------
SPOOFED_BRANDS = [
    "paypal", "apple", "amazon", "microsoft", "google", "facebook", "instagram", "netflix", "ebay",
    "linkedin", "twitter", "whatsapp", "wellsfargo", "chase", "bankofamerica", "citi", "hsbc",
    "maybank", "cimb", "publicbank", "office365", "outlook", "gmail", "yahoo", "dropbox", "adobe",
    "github", "spotify", "steam",
]

# ---- fixed values: brands a look-alike domain is compared with -----------------------------
TOP_BRANDS = [
    "paypal", "apple", "amazon", "microsoft", "google", "facebook", "instagram", "netflix", "ebay",
    "linkedin", "twitter", "whatsapp", "youtube", "wikipedia", "reddit", "wellsfargo", "chase",
    "bankofamerica", "citi", "hsbc", "maybank", "cimb", "publicbank", "rhb", "ambank", "office365",
    "outlook", "gmail", "yahoo", "dropbox", "adobe", "github", "spotify", "steam", "discord",
    "tiktok", "snapchat", "pinterest", "tumblr", "twitch", "venmo", "cashapp", "zelle", "stripe",
    "shopify", "walmart", "target", "bestbuy", "costco", "fedex", "ups", "usps", "dhl", "icloud",
    "onedrive", "googledrive", "mega", "box", "zoom", "teams", "slack", "webex", "meet", "lazada",
    "shopee", "grab", "foodpanda", "tngdigital", "maxis", "celcom", "digi", "unifi", "astro",
    "sunway", "taylors", "monash", "inti", "help", "binance", "coinbase", "kraken", "bybit", "okx",
]

# Distance reported when a URL has no domain label at all.
NO_LABEL_DISTANCE = 99

# ---- fixed values: risk by domain ending ---------------------------------------------------
TLD_RISK = {
    "cf": 1.0, "ml": 1.0, "gq": 1.0, "cfd": 1.0, "icu": 1.0, "page": 1.0,
    "top": 0.99, "site": 0.99, "ga": 0.99, "link": 0.99, "gd": 0.99, "fun": 0.98, "dev": 0.98,
    "xyz": 0.98, "tk": 0.98, "ly": 0.98, "app": 0.97, "cloud": 0.97, "my.id": 0.97,
    "ru": 0.77, "su": 0.75, "pw": 0.70, "work": 0.65, "click": 0.65, "download": 0.65,
    "review": 0.60, "club": 0.88, "cn": 0.85,
    "com": 0.40, "net": 0.43, "co": 0.45, "io": 0.91,
    "org": 0.12, "info": 0.20, "biz": 0.25, "me": 0.79, "tv": 0.15,
    "uk": 0.05, "de": 0.05, "fr": 0.05, "it": 0.05, "nl": 0.05, "es": 0.05, "ca": 0.05, "au": 0.05,
    "jp": 0.05, "kr": 0.05, "br": 0.05, "mx": 0.05, "my": 0.05, "sg": 0.05, "th": 0.05, "id": 0.05,
    "edu": 0.0, "gov": 0.0, "mil": 0.0, "co.uk": 0.0, "com.au": 0.0, "com.my": 0.0, "org.uk": 0.0,
    "com.br": 0.0, "co.jp": 0.0,
}
DEFAULT_TLD_RISK = 0.5

# ---- fixed values: public second-level registries -----------------------------------------
SECOND_LEVEL_SUFFIXES = [
    "ac.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "plc.uk", "sch.uk", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "co.in", "ac.in", "edu.in", "firm.in", "gen.in", "gov.in", "ind.in", "net.in", "org.in", "edu.my", "gov.my", "name.my",
    "net.my", "org.my", "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg", "co.id", "ac.id", "go.id", "or.id", "sch.id",
    "web.id", "co.th", "ac.th", "go.th", "in.th", "or.th", "ac.jp", "ad.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp",
    "or.jp", "co.kr", "ac.kr", "go.kr", "or.kr", "re.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw",
    "edu.tw", "gov.tw", "org.tw", "com.hk", "edu.hk", "gov.hk", "org.hk", "edu.br", "gov.br", "net.br", "org.br", "com.mx",
    "edu.mx", "gob.mx", "org.mx", "com.ar", "gob.ar", "org.ar", "com.tr", "edu.tr", "gov.tr", "org.tr", "co.za", "ac.za",
    "gov.za", "org.za", "co.nz", "ac.nz", "govt.nz", "org.nz", "co.il", "ac.il", "gov.il", "org.il", "com.ph", "gov.ph",
    "com.vn", "edu.vn", "gov.vn", "com.pk", "gov.pk", "com.ng", "gov.ng", "com.eg", "com.sa", "com.ua", "gov.ua", "com.pl",
]

# ---- fixed values: hosts whose model score is capped ---------------------------------------
TRUSTED_DOMAINS = [
    "maybank2u.com.my", "cimbclicks.com.my", "rhbonlinebanking.com.my", "pbebank.com", "hlb.com.my",
    "ambank.com.my", "myeg.com.my", "hasil.gov.my", "bnm.gov.my", "grab.com", "shopee.com.my",
    "lazada.com.my", "airasia.com", "malaysiaairlines.com", "google.com", "microsoft.com",
    "apple.com", "github.com", "python.org", "stackoverflow.com", "wikipedia.org", "youtube.com",
    "linkedin.com", "twitter.com", "facebook.com", "amazon.com", "paypal.com", "netflix.com",
    "spotify.com", "sunway.edu.my",
]

# ---- fixed values: feature column order and display groups ---------------------------------
FEATURE_GROUPS = {
    "structural": [
        "url_length", "qty_dot", "qty_hyphen", "qty_slash", "qty_at", "qty_question", "qty_equal",
        "qty_percent", "domain_length", "tld_length",
    ],
    "statistical": [
        "url_entropy", "domain_entropy", "digit_ratio", "alpha_ratio", "char_continuation_rate",
    ],
    "content": [
        "has_https", "has_shortener", "has_login_keyword", "is_ip", "brand_in_path_not_domain",
    ],
    "advanced": [
        "recursive_decode_depth", "idn_homograph_flag", "levenshtein_min", "tld_risk_score",
    ],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]

# Class means a labelled corpus is compared with (phishing, legitimate).
EXPECTED_MEANS = {
    "url_length": (46.24, 27.23),
    "digit_ratio": (0.0636, 0.0020),
    "has_https": (0.4874, 1.0000),
}
