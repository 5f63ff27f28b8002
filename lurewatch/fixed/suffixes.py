"""Public suffix rules beyond plain endings. Everything in this file is a FIXED VALUE."""

# ---- fixed values: wildcard rules, their exceptions, and a rule of many labels -----------------
WILDCARD_SUFFIXES = [
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.sch.uk",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp",
    "s3.dualstack.us-east-1.amazonaws.com",
]
