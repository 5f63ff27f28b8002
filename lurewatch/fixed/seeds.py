"""Seed URL tables. Everything in this file is a FIXED VALUE: plain strings, never fetched."""

# ---- fixed values: curated legitimate URLs added to a training pool (label 0) ---------------
# One entry pointing at a project's own source page is not shipped; add more with
# ``augment_train(pool, curated)``, which takes any table of URLs.
CURATED_LEGITIMATE = [
    # documentation
    "https://docs.python.org/3/library/urllib.parse.html",
    "https://docs.python.org/3/tutorial/introduction.html",
    "https://docs.python.org/3/reference/expressions.html",
    "https://docs.microsoft.com/en-us/azure/active-directory/",
    "https://docs.microsoft.com/en-us/dotnet/csharp/",
    "https://developer.mozilla.org/en-US/docs/Web/HTTP/",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript/",
    "https://developer.mozilla.org/en-US/docs/Learn/HTML/",
    "https://reactjs.org/docs/getting-started.html",
    "https://vuejs.org/v2/guide/installation.html",
    "https://angular.io/guide/architecture",
    "https://flask.palletsprojects.com/en/2.3.x/quickstart/",
    "https://django-rest-framework.org/api-guide/views/",
    "https://scikit-learn.org/stable/modules/ensemble.html",
    "https://pandas.pydata.org/docs/reference/api/pandas.DataFrame.html",
    "https://numpy.org/doc/stable/reference/generated/numpy.array.html",
    "https://kubernetes.io/docs/concepts/workloads/pods/",
    "https://docs.docker.com/engine/reference/commandline/run/",
    "https://docs.aws.amazon.com/s3/index.html",
    "https://cloud.google.com/storage/docs/creating-buckets",
    # code hosting
    "https://github.com/scikit-learn/scikit-learn/blob/main/README.md",
    "https://github.com/pandas-dev/pandas/issues/12345",
    "https://github.com/tensorflow/tensorflow/tree/master/tensorflow",
    "https://github.com/django/django/blob/main/django/core/",
    "https://github.com/torvalds/linux/blob/master/README",
    "https://github.com/microsoft/vscode/releases/latest",
    "https://raw.githubusercontent.com/numpy/numpy/main/README.md",
    # questions and forums
    "https://stackoverflow.com/questions/12345678/how-to-parse-urls",
    "https://stackoverflow.com/questions/11227809/why-is-processing-sorted",
    "https://stackoverflow.com/questions/6470428/catch-multiple-exceptions",
    "https://stackoverflow.com/questions/1984325/explaining-pythons-list",
    "https://superuser.com/questions/123456/how-to-disable-auto-update",
    "https://askubuntu.com/questions/12345/how-to-install-python3",
    "https://reddit.com/r/learnpython/comments/abc123/how_do_i_learn/",
    "https://www.reddit.com/r/MachineLearning/comments/def456/",
    # news
    "https://www.bbc.com/news/technology-12345678",
    "https://www.bbc.com/news/world-us-canada-67890123",
    "https://www.reuters.com/technology/artificial-intelligence/2024/01/",
    "https://techcrunch.com/2024/01/15/openai-releases-new-model/",
    "https://arstechnica.com/security/2024/01/phishing-attacks-increase/",
    "https://www.theverge.com/2024/1/15/12345678/apple-vision-pro-review",
    "https://www.wired.com/story/best-password-managers-2024/",
    "https://www.thestar.com.my/tech/tech-news/2024/01/malaysia-digital",
    "https://www.malaymail.com/news/malaysia/2024/01/15/digital-economy",
    # shops
    "https://www.amazon.com/gp/product/B08N5WRWNW/ref=ppx_yo_dt_b_asin",
    "https://www.amazon.com/s?k=laptop+stand&ref=nb_sb_noss",
    "https://www.ebay.com/itm/123456789012?hash=item1234abcd",
    "https://www.lazada.com.my/products/laptop-stand-i12345-s67890.html",
    "https://www.shopee.com.my/product/12345/67890123",
    "https://www.walmart.com/ip/product-name/123456789",
    "https://www.bestbuy.com/site/laptops/all-laptops/pcmcat138500050001.c",
    "https://store.steampowered.com/app/1091500/Cyberpunk_2077/",
    "https://www.apple.com/shop/buy-iphone/iphone-15/6.1-inch-display",
    # real login pages
    "https://accounts.google.com/signin/v2/identifier?flowName=GlifWebSignIn",
    "https://login.microsoftonline.com/common/oauth2/v2.0/authorize",
    "https://www.facebook.com/login/?next=https%3A%2F%2Fwww.facebook.com",
    "https://github.com/login?return_to=%2Fjoin",
    "https://id.atlassian.com/login?continue=https%3A%2F%2Fjira.atlassian",
    "https://auth.openai.com/authorize?client_id=app&redirect_uri=https",
    "https://app.slack.com/signin/find-workspaces",
    "https://www.linkedin.com/login?fromSignIn=true&trk=guest_homepage",
    "https://secure.paypal.com/signin?returnUri=https%3A%2F%2Fwww.paypal.com",
    "https://www.twitter.com/i/flow/login",
    "https://www.instagram.com/accounts/login/?source=auth_switcher",
    "https://appleid.apple.com/auth/authorize?client_id=com.apple.icloud",
    "https://myaccount.google.com/security-checkup/1",
    "https://account.microsoft.com/account/Account?refd=account.microsoft",
    "https://www.maybank2u.com.my/maybank2u/malaysia/login",
    "https://www.cimbclicks.com.my/clicks/entreLogin.do",
    # plain http
    "http://neverssl.com/",
    "http://www.example.com/",
    "http://info.cern.ch/hypertext/WWW/TheProject.html",
    "http://www.iana.org/domains/reserved",
    "http://textfiles.com/computers/",
    "http://www.gutenberg.org/browse/recent/last1",
    "http://archive.org/about/",
    # regional sites
    "https://www.maybank.com/en/personal/eservices/online-banking.page",
    "https://www.cimb.com.my/en/personal/banking/accounts/savings.html",
    "https://www.rhbgroup.com/personal/deposits/savings-accounts/",
    "https://www.publicbank.com.my/contents/pbonline/",
    "https://www.bnm.gov.my/interest-rate",
    "https://www.hasil.gov.my/income-tax/individual/",
    "https://www.msc.com.my/en/vessels-and-schedules/",
    "https://www.grab.com/my/transport/",
    "https://food.grab.com/my/en/restaurants",
    "https://shopee.com.my/universal-link/shop/12345678/",
    "https://www.lazada.com.my/catalog/?q=laptop+stand",
    "https://www.airasia.com/flights/search?originCode=KUL&destinationCode=SIN",
    "https://www.malaysiaairlines.com/my/en/book/book-a-flight.html",
    "https://www.sunway.edu.my/university/academics/undergraduate-courses/",
    "https://intl.taylors.edu.my/programmes/degree-programmes/",
    # government
    "https://www.gov.my/en/topik/perkhidmatan-awam",
    "https://www.irs.gov/filing/e-file-options",
    "https://www.gov.uk/apply-for-a-uk-passport/overview",
    "https://www.usa.gov/benefits",
    "https://www.mygov.in/schemes-of-pm/",
    # research
    "https://arxiv.org/abs/2401.12345",
    "https://arxiv.org/pdf/2310.01234.pdf",
    "https://www.researchgate.net/publication/12345678",
    "https://scholar.google.com/scholar?q=phishing+detection+machine+learning",
    "https://ieeexplore.ieee.org/document/12345678",
    "https://sunway.edu.my/research/publications",
    # cloud consoles
    "https://console.cloud.google.com/storage/browser",
    "https://portal.azure.com/#blade/Microsoft_AAD_IAM/ActiveDirectoryMenuBlade",
    "https://app.hubspot.com/contacts/12345/contacts/list/view/all/",
    "https://analytics.google.com/analytics/web/#/report/",
    "https://dashboard.stripe.com/payments",
    "https://app.supabase.com/project/default/editor",
    # long query strings
    "https://www.google.com/search?q=phishing+detection+machine+learning&hl=en",
    "https://www.youtube.com/results?search_query=machine+learning+tutorial",
    "https://www.amazon.com/s?k=python+programming&i=stripbooks&rh=n:283155",
    "https://www.booking.com/searchresults.html?ss=Kuala+Lumpur&checkin=2024-03-01",
    "https://www.google.com/maps/search/restaurants+near+me/@3.1390,101.6869,14z",
    # regional banking logins; two of them occur above too and are kept
    "https://www.maybank2u.com.my/maybank2u/malaysia/login",
    "https://www.maybank2u.com.my/home.do",
    "https://www.cimbclicks.com.my/clicks/entreLogin.do",
    "https://www.rhbonlinebanking.com.my/retailing/login.do",
    "https://www.pbebank.com/Personal-Banking.aspx",
    "https://ibanking.hlb.com.my/hlb/",
    "https://www.ambank.com.my/eng/personal-banking.html",
    "https://www.myeg.com.my/",
    "https://mytax.hasil.gov.my/",
    "https://www.bnm.gov.my/",
]

# ---- fixed values: synthetic attack URLs that mutations start from --------------------------
ATTACK_SEEDS = [
    "http://paypal-secure-login.evil.tk/account/verify?id=12345",
    "http://m365-update.suspicious.cf/auth/login",
    "http://192.168.1.1/admin/login",
    "http://banking-update.secure-login.ml/confirm",
    "http://appleid-locked.tk/verify/account?ref=email",
    "http://microsoft-365-login.gq/signin",
    "http://secure-bank-update.xyz/customer/login",
    "http://paypa1.com/login/verify",
    "http://wellsfarg0.com/account/secure",
    "http://cimb-clicks-login.evil.tk/user/verify",
    "http://maybank-secure.cf/login/confirm?id=999",
    "http://grab-support-update.ml/account/verify",
    "http://netflix-billing-update.gq/payment/confirm",
    "http://amazon-prize-claim.tk/gifts/redeem?ref=123",
    "http://steamcommunity-trade.evil.xyz/tradeoffer/new",
    "http://instagram-verify.gq/accounts/verify",
    "http://whatsapp-prize.cf/claim/winner?id=abc",
    "http://dropbox-secure.ml/signin/verify",
    "http://office365-update.gq/auth/mfa/login",
    "http://hsbc-online-banking.tk/login/secure",
]

# ---- fixed values: URLs that tempt a model into a biased answer (url, expected, note) --------
BIAS_URLS = [
    ("https://docs.python.org/3/library/urllib.parse.html", "LEGIT", "Long path, many slashes, legit"),
    ("https://www.stackoverflow.com/questions/12345678/how-to-parse-urls-in-python", "LEGIT", "Long path, legit"),
    ("http://neverssl.com/", "LEGIT", "HTTP only (no HTTPS), legitimate site"),
    ("http://www.example.com/login", "LEGIT", "HTTP + login keyword, should still be legit"),
    ("https://accounts.google.com/signin/v2/identifier?flowName=GlifWebSignIn", "LEGIT",
     "Real Google signin URL — many params"),
    ("https://www.amazon.com/gp/cart/view.html?ref_=nav_cart", "LEGIT", "Real Amazon URL with path"),
    ("https://paypal-secure-login.evil.tk/account/verify?id=12345", "PHISHING", "Classic phishing"),
    ("https://www.paypa1.com/login", "PHISHING", "Typosquat phishing"),
    ("http://192.168.1.1/admin/login", "PHISHING", "IP-based phishing"),
    ("https://secure-bank-update.xyz/customer/login?ref=email", "PHISHING", "Keyword-heavy phishing"),
    ("https://bit.ly/3xK9pQz", "PHISHING", "URL shortener (hides destination)"),
]

# ---- fixed values: specimen gallery (category, label, url) ----------------------------------
SPECIMENS = [
    ("✅ Legitimate (control group)", "Google", "https://www.google.com"),
    ("✅ Legitimate (control group)", "Maybank2u login", "https://www.maybank2u.com.my/login"),
    ("✅ Legitimate (control group)", "Python docs (long path)",
     "https://docs.python.org/3/library/urllib.parse.html"),
    ("🎭 Typosquatting", "paypa1.com", "https://paypa1.com/login/verify"),
    ("🎭 Typosquatting", "wellsfarg0.com", "https://wellsfarg0.com/account/secure"),
    ("🪝 Brand spoof + suspicious TLD", "PayPal on .tk",
     "https://paypal-secure-login.evil.tk/account/verify?id=12345"),
    ("🪝 Brand spoof + suspicious TLD", "CIMB on .tk", "https://cimb-clicks-login.evil.tk/user/verify"),
    ("🎣 AiTM / M365 kit", "m365 login (.tk)", "https://m365-login.suspicious.tk/auth"),
    ("🎣 AiTM / M365 kit", "office365 MFA (.gq)", "https://office365-update.gq/auth/mfa/login"),
    ("🌐 IP-based host", "Raw IP + login", "http://192.168.1.1/admin/login"),
    ("🔤 IDN homograph", "xn-- punycode PayPal", "https://xn--pypal-4ve.com/login"),
    ("🔒 HTTPS-laundered", "Phishing with valid HTTPS", "https://secure-bank-update.xyz/customer/login"),
]
