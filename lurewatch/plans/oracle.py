"""Check SQL for the registered queries, written independently for another SQL engine (DuckDB).

``PIECES`` are common table expressions by name with the names they build on; ``sql`` collects the
ones a statement needs.
"""

from __future__ import annotations

import re
from functools import cache

from lurewatch.fixed import rules as RU, seeds, texts, words
from lurewatch.fixed.suffixes import WILDCARD_SUFFIXES
from lurewatch.sources.specimens import EDGE_URLS, SUFFIX_URLS

PIECES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def sql(final: str) -> str:
    """Prefix ``final`` with every piece it mentions, directly or through another piece."""
    needed: list[str] = []

    def collect(text: str) -> None:
        for name in PIECES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                collect(PIECES[name])
                if name not in needed:
                    needed.append(name)

    collect(final)
    return "WITH " + ",\n".join(f"{n} AS ({PIECES[n]})" for n in needed) + "\n" + final if needed else final


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ",".join(q(v) for v in values) + "]"


def pct(a: str, b: str, d: int) -> str:
    return rnd(f"({a}*100.0::DOUBLE/{b})", d)


def rnd(x: str, d: int) -> str:
    """Half-up rounding of the shortest decimal form of a double; plain ``round`` scales the binary value and
    errs on near ties."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)),{d}) AS DOUBLE)"


# ---- inputs ---------------------------------------------------------------------------------

PIECES["corpus"] = """WITH kinds AS (SELECT * FROM (VALUES
  (0,'benign'),(1,'benign_dup'),(2,'encoded_once'),(3,'trusted_login'),(4,'ip_url'),(5,'idn_punycode'),
  (6,'multi_encoded'),(7,'aitm_pattern'),(8,'brand_spoof_sus_tld'),(9,'ip_with_login'),
  (10,'embedded_credentials'),(11,'typosquat')) AS t(kind_id, kind))
SELECT CAST(p.page_id*12+k.kind_id AS BIGINT) AS url_id, k.kind AS kind, CASE WHEN k.kind_id<=3 THEN 0 ELSE 1 END AS label,
 CASE k.kind
  WHEN 'benign' THEN p.url WHEN 'benign_dup' THEN p.url
  WHEN 'encoded_once' THEN p.url || '%2Fx'
  WHEN 'trusted_login' THEN 'https://www.maybank2u.com.my/login?p=' || CAST(p.page_id AS VARCHAR)
  WHEN 'ip_url' THEN 'http://' || CAST(p.page_id % 223 + 1 AS VARCHAR) || '.' || CAST(p.page_id % 251 AS VARCHAR) || '.7.9/x'
  WHEN 'idn_punycode' THEN replace(p.url,'://','://xn--')
  WHEN 'multi_encoded' THEN p.url || '%25252Fx'
  WHEN 'aitm_pattern' THEN replace(p.url,'://','://m365-login.')
  WHEN 'brand_spoof_sus_tld' THEN 'http://evil' || CAST(p.page_id AS VARCHAR) || '.tk/paypal/index'
  WHEN 'ip_with_login' THEN 'http://10.0.' || CAST(p.page_id % 251 AS VARCHAR) || '.1/login'
  WHEN 'embedded_credentials' THEN replace(p.url,'://','://legit.com@')
  ELSE 'https://paypa1.com/p/' || CAST(p.page_id AS VARCHAR) END AS url
FROM pages p, kinds k"""


def _edge_literal(u: str | None) -> str:
    out = q(u)
    for char, code in (("\t", 9), ("\n", 10)):
        out = out.replace(char, f"' || chr({code}) || '")
    return out


PIECES["edges"] = (
    f"SELECT CAST(p.page_id*{len(EDGE_URLS)}+e.i AS BIGINT) AS url_id, replace(e.u, '{{}}', CAST(p.page_id AS VARCHAR)) AS url "
    "FROM pages p, (VALUES " + ",".join(f"({i},{_edge_literal(u)})" for i, u in enumerate(EDGE_URLS)) + ") e(i,u)")


# ---- features -------------------------------------------------------------------------------

_RUNS = r"[a-zA-Z\p{L}]+|[0-9\p{Nd}²³¹⁰⁴-⁹₀-₉]+|[^a-zA-Z\p{L}0-9\p{Nd}²³¹⁰⁴-⁹₀-₉]+"


def _parts(src: str) -> str:
    return rf"""
SELECT *, substr(before, length(rawpath)+2) AS query,
  CASE WHEN contains(rawpath,';') AND scheme IN ('','ftp','hdl','prospero','http','https','shttp','rtsp','rtsps','rtspu','sip','sips','mms','sftp','tel')
       THEN regexp_replace(rawpath, ';[^/]*$', '') ELSE rawpath END AS path
FROM (SELECT *, split_part(before,'?',1) AS rawpath, substr(rest, length(before)+2) AS fragment,
        CASE WHEN valid THEN split_part(netloc,':',1) ELSE '' END AS host,
        CASE WHEN regexp_matches(pre, '^[\x00-\x20]*[a-zA-Z]') THEN lower(regexp_replace(split_part(pre,':',1), '[\x00-\x20]+', '', 'g')) ELSE '' END AS scheme
 FROM (SELECT *, contains(netloc,'[') = contains(netloc,']') AS valid, split_part(rest,'#',1) AS before
  FROM (SELECT *, substr(cl, length(pre)+1) AS rest,
          CASE WHEN contains(pre,'//') THEN substr(pre, strpos(pre,'//')+2) ELSE '' END AS netloc
   FROM (SELECT *, regexp_extract(cl, '^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?') AS pre
    FROM (SELECT *, coalesce(url,'') AS u, translate(coalesce(url,''), chr(9)||chr(10)||chr(13), '') AS cl FROM {src})))))"""


def _decode(depth: int = 10) -> str:
    """u0..u10, each the decoding of the one before."""
    inner = "SELECT *, u AS u0 FROM {src}"
    for i in range(1, depth + 1):
        inner = f"SELECT *, url_decode(u{i-1}) AS u{i} FROM ({inner})"
    return inner


def _count(ch: str) -> str:
    return f"CAST(len(u)-len(replace(u,'{ch}','')) AS INTEGER)"


_TLD = "MAP {" + ",".join(f"'{k}':{v}::DOUBLE" for k, v in words.TLD_RISK.items()) + "}"


def _features(src: str) -> str:
    counts = ", ".join(f"{_count(c)} AS {n}" for n, c in (
        ("qty_dot", "."), ("qty_hyphen", "-"), ("qty_slash", "/"), ("qty_at", "@"), ("qty_question", "?"),
        ("qty_equal", "="), ("qty_percent", "%")))
    return rf"""
SELECT * EXCLUDE (cl,pre,rest,netloc,valid,before,rawpath,fragment,host,scheme,query,path,hnw,lhost,labels,llabels,hlabels,domain,u0,u1,u2,u3,u4,u5,u6,u7,u8,u9,u10,n,digits,letters,u),
  lhost AS thost, CAST(n AS INTEGER) AS url_length, {counts},
  CAST(CASE WHEN len(hlabels)>=2 THEN len(hlabels[-2]) ELSE len(hnw) END AS INTEGER) AS domain_length,
  CAST(CASE WHEN len(labels)>=2 THEN len(labels[-1]) ELSE 0 END AS INTEGER) AS tld_length,
  CASE WHEN n=0 THEN 0.0::DOUBLE ELSE round(list_aggregate(string_split(u,''),'entropy'),4) END AS url_entropy,
  CASE WHEN hnw='' THEN 0.0::DOUBLE ELSE round(list_aggregate(string_split(hnw,''),'entropy'),4) END AS domain_entropy,
  CASE WHEN n=0 THEN 0.0::DOUBLE ELSE round(digits::DOUBLE/n,4) END AS digit_ratio,
  CASE WHEN n=0 THEN 0.0::DOUBLE ELSE round(letters::DOUBLE/n,4) END AS alpha_ratio,
  CASE WHEN n<2 THEN 0.0::DOUBLE ELSE round((len(regexp_extract_all(u,'{_RUNS}'))-1)::DOUBLE/n,4) END AS char_continuation_rate,
  CAST(starts_with(lower(u),'https://') AS INTEGER) AS has_https, NOT valid AS broken,
  CAST(CASE WHEN starts_with(lhost,'www.') THEN substr(lhost,5) ELSE lhost END IN ({",".join(map(q, words.SHORTENERS))}) AS INTEGER) AS has_shortener,
  CAST(regexp_matches(lower(u), '{"|".join(words.LOGIN_KEYWORDS)}') AS INTEGER) AS has_login_keyword,
  CAST(valid AND (regexp_matches(hnw,'^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') OR regexp_matches(hnw,'^(0x[0-9a-fA-F]+\.){{3}}0x[0-9a-fA-F]+$')
     OR contains(netloc,'[')) AS INTEGER) AS is_ip,
  CAST(valid AND len(list_filter({lst(words.SPOOFED_BRANDS)}, lambda b: contains(lower(path||query||fragment), b) AND NOT contains(lower(netloc), b)))>0 AS INTEGER) AS brand_in_path_not_domain,
  CAST({"+".join(f"(u{i}<>u{i-1})::INTEGER" for i in range(1, 11))} AS INTEGER) AS recursive_decode_depth,
  CAST(contains(lhost,'xn--') AS INTEGER) AS idn_homograph_flag,
  CAST(CASE WHEN u='' THEN 0 WHEN domain='' THEN 99 ELSE list_min(list_transform({lst(words.TOP_BRANDS)}, lambda b: levenshtein(domain,b))) END AS INTEGER) AS levenshtein_min,
  CASE WHEN u='' THEN 0.0::DOUBLE WHEN len(llabels)<2 THEN 0.5::DOUBLE ELSE coalesce(
     CASE WHEN len(llabels)>=3 THEN {_TLD}[llabels[-2]||'.'||llabels[-1]] END, {_TLD}[llabels[-1]], 0.5::DOUBLE) END AS tld_risk_score
FROM (SELECT *, CASE WHEN len(string_split(lnw,'.'))>=2 THEN string_split(lnw,'.')[-2] ELSE lnw END AS domain
      FROM (SELECT *, string_split(host,'.') AS labels, string_split(lhost,'.') AS llabels, string_split(hnw,'.') AS hlabels,
               CASE WHEN starts_with(lhost,'www.') THEN substr(lhost,5) ELSE lhost END AS lnw
            FROM (SELECT *, lower(host) AS lhost, CASE WHEN starts_with(host,'www.') THEN substr(host,5) ELSE host END AS hnw,
                     length(u) AS n, length(regexp_replace(u,'[^0-9\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+','','g')) AS digits,
                     length(regexp_replace(u,'[^a-zA-Z\p{{L}}]+','','g')) AS letters
                  FROM ({_decode().replace("{src}", f"({_parts(src)})")}))))"""


def _hits(src: str) -> str:
    arr = "list_filter([" + ",".join(f"CASE WHEN hit_{r[0]} THEN '{r[0]}' END" for r in RU.RULES) + "], lambda x: x IS NOT NULL)"
    # list_distinct does not keep order, so a technique is kept where its first position is its own
    tech = ("list_filter(list_concat(" + ",".join(
        f"CASE WHEN hit_{n} THEN {lst(t)} ELSE [] END" for n, _, t, _ in RU.RULES) + "), lambda x: x IS NOT NULL)")
    high = " OR ".join(f"hit_{r[0]}" for r in RU.RULES if r[1] == "HIGH_RISK")
    return f"""
SELECT *, CASE WHEN {high} THEN 'HIGH_RISK' WHEN len(rules)>0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS layer1_verdict,
  list_filter(tech0, lambda x, i: list_position(tech0, x) = i) AS techniques
FROM (SELECT *, {arr} AS rules, {tech} AS tech0
FROM (SELECT *, is_ip=1 AS hit_ip_url, idn_homograph_flag=1 AS hit_idn_punycode, recursive_decode_depth>=2 AS hit_multi_encoded,
  regexp_matches(coalesce(url,''), '(?i){"|".join(RU.AITM_PATTERNS)}') AS hit_aitm_pattern,
  brand_in_path_not_domain=1 AND tld_risk_score>=0.9 AS hit_brand_spoof_sus_tld,
  is_ip=1 AND has_login_keyword=1 AS hit_ip_with_login, qty_at>=1 AS hit_embedded_credentials, levenshtein_min=1 AS hit_typosquat
FROM {src}))"""


def _surr(src: str) -> str:
    return f"""SELECT *, 0.5001::DOUBLE*p1+0.4999::DOUBLE*p2 AS layer2 FROM (SELECT *, ((url_id*7919)%1000)::DOUBLE/1000.0::DOUBLE AS p1,
  ((url_id*104729)%1000)::DOUBLE/1000.0::DOUBLE AS p2, ((url_id*15485863)%1000)::DOUBLE/1000.0::DOUBLE AS p3 FROM {src})"""


def _trusted_expr(h: str) -> str:
    return f"len(list_filter({lst(words.TRUSTED_DOMAINS)}, lambda d: {h}=d OR ends_with({h}, '.'||d)))>0"


def _severity(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s}>={t} THEN '{n}'" for n, t in RU.SEVERITY[:-1]) + " ELSE 'SAFE' END"


def _scored(src: str) -> str:
    """``src`` has rule columns and layer2."""
    rule_texts = "array_to_string(list_filter([" + ",".join(
        f"CASE WHEN hit_{n} THEN {q(d + ' (' + ', '.join(t) + ')')} END" for n, _, t, d in RU.RULES) + "], lambda x: x IS NOT NULL), '; ')"
    three = "printf('%.3f', layer2)"
    rl = "array_to_string(rules, ', ')"

    def fmt(template, *args):
        pieces = template.split("%s")
        out = q(pieces[0])
        for a, p in zip(args, pieces[1:]):
            out += f" || {a} || {q(p)}"
        return out

    return f"""
SELECT *, CASE WHEN blank THEN {q(texts.EMPTY_URL_TEXT)} WHEN high THEN {fmt(texts.BYPASS_TEXT, rule_texts)}
   WHEN escalated THEN {fmt(texts.ESCALATED_TEXT, rl, three, "verdict")}
   ELSE {fmt(texts.SCORE_TEXT, three)} || CASE WHEN susp THEN ' ' || {fmt(texts.AGREEMENT_TEXT, rl)} ELSE '' END
     || CASE WHEN verdict='SAFE' THEN {q(' ' + texts.SAFE_TEXT)} ELSE '' END END AS explanation
FROM (SELECT *, {_severity('final_score')} AS verdict, {rnd("final_score", 4)} AS score, {rnd("final_score*10", 1)} AS cvss,
   CASE WHEN blank THEN 0.0::DOUBLE WHEN NOT high THEN {rnd("layer2", 4)} END AS layer2_score,
   susp AND NOT blank AND layer2<0.5 AS escalated
 FROM (SELECT *, CASE WHEN blank THEN 0.0::DOUBLE WHEN high THEN 1.0::DOUBLE WHEN susp AND layer2<0.5 THEN greatest(layer2,0.55::DOUBLE)
     WHEN susp THEN least(layer2+0.05::DOUBLE,1.0::DOUBLE) WHEN trusted AND layer2>0.3 THEN 0.15::DOUBLE ELSE layer2 END AS final_score
  FROM (SELECT s.*, layer1_verdict='SUSPICIOUS' AS susp, regexp_matches(coalesce(s.url,''), '^\\s*$') AS blank,
        layer1_verdict='HIGH_RISK' AND NOT regexp_matches(coalesce(s.url,''), '^\\s*$') AS high, {_trusted_expr('s.thost')} AS trusted
     FROM ({src}) s)))"""


PIECES["feat"] = _features("corpus").replace("FROM corpus", "FROM corpus")
PIECES["hits"] = _hits("feat")
PIECES["surr"] = _surr("corpus")
PIECES["scored"] = _scored(_surr("hits"))
PIECES["edgefeat"] = _features("edges")
PIECES["edgehits"] = _hits("edgefeat")
PIECES["edgescored"] = _scored(_surr("edgehits"))

# ---- preparation ----------------------------------------------------------------------------

PIECES["dedup"] = "SELECT url_id,kind,label,url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY url_id) AS rn FROM corpus) WHERE rn=1"


def _split(src: str, salt: str, held: str, kept: str) -> str:
    return f"""SELECT r.* EXCLUDE (hr), CASE WHEN hr<=quota THEN '{held}' ELSE '{kept}' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url_id||'|{salt}|42')) AS hr FROM {src}) r
JOIN (SELECT label, c - base - CASE WHEN row_number() OVER (ORDER BY share-base DESC, label) <= keep - sum(base) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT *, floor(share) AS base FROM (SELECT label, c, keep, c*keep::DOUBLE/n AS share
        FROM (SELECT label, c, n, n-ceil(n*0.2::DOUBLE) AS keep FROM (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM {src} GROUP BY label))))) quotas
  ON r.label=quotas.label"""


PIECES["split2"] = _split("dedup", "split", "test", "train")
PIECES["trainpool"] = "SELECT * EXCLUDE (split) FROM split2 WHERE split='train'"
PIECES["split3"] = _split("trainpool", "validation", "validation", "train") + " UNION ALL BY NAME SELECT * FROM split2 WHERE split='test'"
PIECES["splitfeat"] = _features("split2")
PIECES["dedhits"] = _hits(f"({_features('dedup')})")

# ---- predictions ----------------------------------------------------------------------------

_MODELS = {"logistic": "p3", "boosted": "p1", "forest": "p2", "ensemble": "layer2"}


def _long(src: str, models: dict[str, str], keep: str) -> str:
    rows = ",".join(f"{{'model':'{m}','proba':{c}}}" for m, c in models.items())
    return (f"SELECT {keep}, x.model AS model, x.proba AS proba, (x.proba>=0.5)::INTEGER AS pred "
            f"FROM (SELECT {keep}, unnest([{rows}]) AS x FROM ({src}))")


PIECES["pred3"] = _long(_surr("split3"), _MODELS, "url_id,split,label")
PIECES["randbase"] = """SELECT url_id,label,'random' AS model, draw::DOUBLE AS proba, draw AS pred FROM (SELECT url_id,label,
  (('0x'||substr(md5(url_id||'|baseline|42'),1,8))::BIGINT/4294967296.0::DOUBLE < (SELECT avg(label::DOUBLE) FROM split2 WHERE split='train'))::INTEGER AS draw
  FROM split2 WHERE split='test')"""
PIECES["testpred"] = (_long(_surr("split2"), _MODELS, "url_id,label,split") .replace("SELECT url_id,label,split, x.model", "SELECT url_id,label, x.model")
                      + " WHERE split='test' UNION ALL SELECT * FROM randbase")


def _confusion(src: str, by: str) -> str:
    return f"""SELECT {by}, count_if(label=0 AND pred=0)::BIGINT AS tn, count_if(label=0 AND pred=1)::BIGINT AS fp,
  count_if(label=1 AND pred=0)::BIGINT AS fn, count_if(label=1 AND pred=1)::BIGINT AS tp FROM {src} GROUP BY {by}"""


def _metrics(src: str, by: str, d: int = 4) -> str:
    share = lambda a, b: f"CASE WHEN {b}=0 THEN 0.0::DOUBLE ELSE round(({a})::DOUBLE/({b}),{d}) END"
    mcc = "sqrt((tp+fp)::DOUBLE)*sqrt((tp+fn)::DOUBLE)*sqrt((tn+fp)::DOUBLE)*sqrt((tn+fn)::DOUBLE)"
    return f"""SELECT {by}, {share('tp+tn', '(tp+tn+fp+fn)')} AS accuracy, {share('tp', '(tp+fp)')} AS "precision",
  {share('tp', '(tp+fn)')} AS recall, {share('2*tp', '(2*tp+fp+fn)')} AS f1,
  {share('tp::DOUBLE*tn-fp::DOUBLE*fn', '(' + mcc + ')')} AS mcc FROM ({_confusion(src, by)})"""


def _auc(src: str, by: str) -> str:
    """Rank formula: mean rank of the positives, ties averaged."""
    return f"""SELECT {by}, CASE WHEN p*n=0 THEN 0.0::DOUBLE ELSE round((r - p*(p+1)/2.0::DOUBLE)/(p::DOUBLE*n),4) END AS roc_auc FROM (
  SELECT {by}, sum(CASE WHEN label=1 THEN rk+(ties-1)/2.0::DOUBLE ELSE 0 END) AS r, count_if(label=1) AS p, count_if(label=0) AS n FROM (
    SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY proba) AS rk, count(*) OVER (PARTITION BY {by}, proba) AS ties FROM {src})
  GROUP BY {by})"""


def _full(src: str, by: str) -> str:
    return f"SELECT m.*, roc_auc FROM ({_metrics(src, by)}) m JOIN ({_auc(src, by)}) a USING ({by})"


def _roc(src: str) -> str:
    return f"""SELECT model, proba AS threshold, round(fp::DOUBLE/n,6) AS fpr, round(tp::DOUBLE/p,6) AS tpr FROM (
 SELECT DISTINCT model, proba, sum(1-label) OVER (PARTITION BY model ORDER BY proba DESC) AS fp, sum(label) OVER (PARTITION BY model ORDER BY proba DESC) AS tp,
  sum(1-label) OVER (PARTITION BY model) AS n, sum(label) OVER (PARTITION BY model) AS p FROM {src})"""


_VEC = ",".join(words.FEATURES)
PIECES["vec"] = f"SELECT {_VEC}, count_if(split='train')::BIGINT AS n_train, count_if(split='test')::BIGINT AS n_test FROM splitfeat GROUP BY {_VEC}"
PIECES["leak"] = f"""SELECT *, {pct('leaked_test_rows', 'test_rows', 1)} AS leaked_test_pct,
  train_rows-distinct_train_vectors AS train_duplicate_rows, test_rows-distinct_test_vectors AS test_duplicate_rows,
  {pct('(train_rows-distinct_train_vectors)', 'train_rows', 1)} AS train_duplicate_pct,
  {pct('(test_rows-distinct_test_vectors)', 'test_rows', 1)} AS test_duplicate_pct FROM (
  SELECT (SELECT count(*) FROM splitfeat WHERE split='train') AS train_rows, (SELECT count(*) FROM splitfeat WHERE split='test') AS test_rows,
   (SELECT count(*) FROM (SELECT DISTINCT {_VEC} FROM splitfeat WHERE split='train')) AS distinct_train_vectors,
   (SELECT count(*) FROM (SELECT DISTINCT {_VEC} FROM splitfeat WHERE split='test')) AS distinct_test_vectors,
   (SELECT count(*) FROM splitfeat WHERE split='test' AND ({_VEC}) IN (SELECT ({_VEC}) FROM splitfeat WHERE split='train')) AS leaked_test_rows)"""
PIECES["freerows"] = f"SELECT * FROM splitfeat WHERE split='test' AND ({_VEC}) NOT IN (SELECT ({_VEC}) FROM splitfeat WHERE split='train')"
PIECES["freepred"] = _long(_surr("freerows"), {m: c for m, c in _MODELS.items() if m != "logistic"}, "url_id,label")

# ---- host parts -----------------------------------------------------------------------------

_SUFFIX = lst([*words.TLD_RISK, *words.SECOND_LEVEL_SUFFIXES, *WILDCARD_SUFFIXES])
_LONGEST = 5  # labels of the longest rule


def _host_parts(src: str) -> str:
    return f"""SELECT * EXCLUDE (h,ip,labels,n,size,rest,cl,pre,netloc,valid,before,rawpath,fragment,host,scheme,query,path,u),
  array_to_string(labels[n-size+1:n],'.') AS tld,
  CAST(CASE WHEN ip THEN length(h) WHEN n-size>=1 THEN length(labels[n-size]) ELSE 0 END AS INTEGER) AS reg_domain_length,
  CAST(CASE WHEN ip OR n-size<1 THEN 0 ELSE n-size-1 END AS INTEGER) AS subdomain_count,
  CAST((NOT ip AND n-size>1) AS INTEGER) AS has_subdomain
FROM (SELECT *, CASE WHEN ip THEN 0 ELSE coalesce(
   list_max([k - 1 FOR k IN range(1, {_LONGEST + 1}) IF k<=n AND list_contains({_SUFFIX}, '!'||array_to_string(labels[n-k+1:n],'.'))]),
   list_max([k FOR k IN range(1, {_LONGEST + 2}) IF k<=n AND (list_contains({_SUFFIX}, array_to_string(labels[n-k+1:n],'.'))
     OR k>1 AND list_contains({_SUFFIX}, '*.'||array_to_string(labels[n-k+2:n],'.')))]), (n>=2)::INT) END AS size
 FROM (SELECT *, string_split(h,'.') AS labels, len(string_split(h,'.')) AS n, h='' OR regexp_matches(h,'^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AS ip
  FROM (SELECT *, regexp_replace(split_part(lower(regexp_replace(netloc,'^.*@','')),':',1),'\\.$','') AS h FROM ({_parts(src)}))))"""


PIECES["hosts"] = _host_parts("corpus")
PIECES["suffixurls"] = (
    f"SELECT CAST(p.page_id*{len(SUFFIX_URLS)}+e.i AS BIGINT) AS url_id, replace(e.u, '{{}}', CAST(p.page_id AS VARCHAR)) AS url "
    "FROM pages p, (VALUES " + ",".join(f"({i},'{u}')" for i, u in enumerate(SUFFIX_URLS)) + ") e(i,u)")

# ---- mutations ------------------------------------------------------------------------------


def _int(salt: str) -> str:
    return f"('0x'||substr(md5(url_id||'|{salt}|42'),1,8))::BIGINT"


def _pad(salt: str) -> str:
    return f"{lst(RU.BENIGN_SUBDOMAINS)}[{_int(salt)}%6+1]||'.'||CASE WHEN starts_with(netloc,'www.') THEN substr(netloc,5) ELSE netloc END"


def _dilute(path: str, salt: str) -> str:
    d, p = f"({_int(salt)}%20)", lst(RU.BENIGN_PATHS)
    return f"rtrim({path},'/')||'/'||{p}[{d}//4+1]||'/'||{p}[({d}//4+1+{d}%4)%5+1]"


def _clean_path(path: str) -> str:
    for w in RU.REMOVED_KEYWORDS:
        path = f"replace({path},'{w}','page')"
    return path


def _join(scheme="scheme", netloc="netloc", path="path") -> str:
    return (f"{scheme}||'://'||{netloc}||CASE WHEN {path}<>'' AND NOT starts_with({path},'/') THEN '/' ELSE '' END||{path}"
            "||CASE WHEN query<>'' THEN '?'||query ELSE '' END||CASE WHEN fragment<>'' THEN '#'||fragment ELSE '' END")


def _mutated(src: str) -> str:
    coin = lambda n: f"{_int('combined-' + n)}/4294967296.0::DOUBLE>0.4"
    return f"""SELECT * EXCLUDE (hc,pc0,pc), {_join(netloc='(' + _pad('subdomain') + ')')} AS subdomain_padding, {_join(scheme="'https'")} AS https_laundering,
  {_join(path='(' + _dilute('path', 'path') + ')')} AS path_dilution, {_join(path='(' + _clean_path('path') + ')')} AS keyword_removal,
  {_join(netloc='hc', path='pc')} AS combined
FROM (SELECT *, CASE WHEN {coin('keyword')} THEN {_clean_path('pc0')} ELSE pc0 END AS pc
 FROM (SELECT *, CASE WHEN {coin('subdomain')} THEN {_pad('combined-sub')} ELSE netloc END AS hc,
   CASE WHEN {coin('path')} THEN {_dilute('path', 'combined-pair')} ELSE path END AS pc0 FROM ({_parts(src)})))"""


PIECES["mutated"] = _mutated("corpus")
_MUT = lst(RU.MUTATIONS)


def _unpivot_mut(src: str) -> str:
    rows = ",".join(f"{{'mutation':'{m}','mutated_url':{m}}}" for m in RU.MUTATIONS)
    return f"SELECT url_id, url, x.mutation AS mutation, x.mutated_url AS mutated_url FROM (SELECT url_id, url, unnest([{rows}]) AS x FROM {src})"


def _values(rows, columns: str) -> str:
    return "(VALUES " + ",".join("(" + ",".join(str(c) if isinstance(c, int) else q(c) for c in r) + ")" for r in rows) + f") v({columns})"


PIECES["attacks"] = ("SELECT url_id, url FROM corpus WHERE label=1 UNION ALL SELECT * FROM "
                     + _values([(10 ** 12 + i, u) for i, u in enumerate(seeds.ATTACK_SEEDS)], "url_id,url"))
PIECES["attackhits"] = _hits(f"({_features('attacks')})")
PIECES["attackvariants"] = _unpivot_mut(f"({_mutated('attacks')})")
PIECES["varhits"] = _hits("(" + _features("(SELECT url_id, mutation, url AS original_url, mutated_url AS url FROM attackvariants)") + ")")


def _vscore(shift: str) -> str:
    return (f"0.5001::DOUBLE*(((url_id*7919+{shift})%1000)::DOUBLE/1000.0::DOUBLE)"
            f"+0.4999::DOUBLE*(((url_id*104729+{shift})%1000)::DOUBLE/1000.0::DOUBLE)")


PIECES["advers"] = f"""SELECT v.url_id, original_url, v.url AS mutated_url, mutation, {rnd("s0", 4)} AS score_before, {rnd("s1", 4)} AS score_after,
  {rnd("s0-s1", 4)} AS score_drop, b.layer1_verdict AS heuristic_before, v.layer1_verdict AS heuristic_after,
  (b.layer1_verdict='HIGH_RISK' OR s0>=0.5) AS detected_before, (v.layer1_verdict='HIGH_RISK' OR s1>=0.5) AS detected_after,
  (b.layer1_verdict='HIGH_RISK' OR s0>=0.5) AND NOT (v.layer1_verdict='HIGH_RISK' OR s1>=0.5) AS evaded
FROM (SELECT *, {_vscore(f'(list_position({_MUT}, mutation)*131)')} AS s1 FROM varhits) v
JOIN (SELECT url_id, layer1_verdict, {_vscore('0')} AS s0 FROM attackhits) b ON v.url_id=b.url_id"""

# ---- hold-out and specimens -----------------------------------------------------------------

PIECES["holdsrc"] = "SELECT url_id, url FROM corpus UNION ALL SELECT -1-url_id, url FROM edges"
PIECES["holdhits"] = f"SELECT * REPLACE (abs(layer2) AS layer2) FROM ({_surr('(' + _hits('(' + _features('holdsrc') + ')') + ')')})"
PIECES["holdscored"] = _scored("SELECT * FROM holdhits")
PIECES["holdout"] = f"""SELECT s.url_id, substr(s.url,1,150) AS url, CASE WHEN e THEN 'ERROR' ELSE verdict END AS verdict,
  CASE WHEN NOT e THEN score END AS score, CASE WHEN NOT e THEN cvss END AS cvss, CASE WHEN e THEN 'ERROR' ELSE layer1_verdict END AS layer1,
  CASE WHEN NOT e THEN layer2_score END AS layer2_score, escalated AND NOT e AS escalated,
  CASE WHEN e THEN '' ELSE array_to_string(techniques,',') END AS mitre,
  CASE WHEN e THEN 'unbalanced_brackets' ELSE array_to_string(rules,',') END AS rules
FROM (SELECT *, broken AS e FROM holdscored) s"""
def _hold_rows(src: str) -> str:
    groups = ([("rows", "total", "true", "total"), ("rows", "valid", "verdict<>'ERROR'", "total"), ("rows", "errors", "verdict='ERROR'", "total")]
              + [("verdict", v, f"verdict='{v}'", "total") for v in RU.VERDICTS]
              + [("detection", "detected", "verdict IN ('CRITICAL','HIGH','MEDIUM')", "valid"),
                 ("detection", "missed", "verdict IN ('LOW','SAFE')", "valid"), ("detection", "escalated", "escalated", "valid")]
              + [("layer1", v, f"layer1='{v}'", "total") for v in ("HIGH_RISK", "SUSPICIOUS", "CLEAN", "ERROR")])
    whole = {"total": "(SELECT count(*) FROM h)", "valid": "(SELECT count(*) FROM h WHERE verdict<>'ERROR')"}
    return f"WITH h AS ({src}) " + " UNION ALL ".join(
        f"SELECT '{s}' AS section, '{i}' AS item, count(*)::BIGINT AS n, round(count(*)*100.0::DOUBLE/{whole[w]},2) AS pct FROM h WHERE {c}"
        for s, i, c, w in groups)


PIECES["specsrc"] = ("SELECT url_id, kind AS category, url FROM corpus UNION ALL SELECT * FROM "
                     + _values([(2 * 10 ** 12 + i, c, u) for i, (c, _, u) in enumerate(seeds.SPECIMENS)], "url_id,category,url"))
PIECES["specscored"] = _scored(_surr("(" + _hits("(" + _features("specsrc") + ")") + ")"))
PIECES["biassrc"] = ("SELECT url_id, url, CASE WHEN label=1 THEN 'PHISHING' ELSE 'LEGIT' END AS expected FROM corpus UNION ALL SELECT * FROM "
                     + _values([(10 ** 12 + i, u, e) for i, (u, e, _) in enumerate(seeds.BIAS_URLS)], "url_id,url,expected"))
PIECES["augsrc"] = ("SELECT url_id, url, label, false AS augmented FROM split2 WHERE split='train' UNION ALL SELECT NULL, url, 0, true FROM "
                    + _values([(u,) for u in seeds.CURATED_LEGITIMATE], "url"))
PIECES["augfeat"] = _features("augsrc")
PIECES["clicks"] = """SELECT e.event_id, e.ts, s.url, s.verdict, s.score FROM events e
  JOIN scored s ON s.url_id = e.event_id % (SELECT count(*) FROM corpus)"""

# ---- statements -----------------------------------------------------------------------------

O = ORACLES
F24 = ", ".join(words.FEATURES)
O["src_csv_urls"] = sql("SELECT url, 1-label AS source_label FROM corpus")
O["src_csv_wide"] = sql("SELECT * FROM corpus")
O["src_feed"] = sql("SELECT url FROM corpus UNION ALL SELECT url FROM corpus")
O["splits_roundtrip"] = sql("SELECT url_id, url, label, split FROM split2")
_M = ["accuracy", "precision", "recall", "f1", "mcc"]


def _rows(src: str, section: str, item: str, names) -> str:
    return " UNION ALL ".join(f"""SELECT '{section}' AS section, {item} AS item, '{n}' AS metric, "{n}"::DOUBLE AS value FROM {src}""" for n in names)


PIECES["testmetrics"] = _metrics("testpred", "model")
PIECES["testconf"] = _confusion("testpred", "model")
PIECES["scoredhold"] = _hold_rows("SELECT verdict, layer1_verdict AS layer1, escalated FROM scored")
O["report_roundtrip"] = sql(f"SELECT * FROM ({_rows('testmetrics', 'metrics', 'model', _M)}) WHERE item='ensemble'")
O["results_summary"] = sql(" UNION ALL ".join([
    _rows("testmetrics", "metrics", "model", _M), _rows("testconf", "confusion", "model", ["tn", "fp", "fn", "tp"]),
    _rows("leak", "leakage", "'all'", ["train_rows", "test_rows", "leaked_test_rows"]),
    "SELECT section, item, 'n', n::DOUBLE FROM scoredhold"]))

O["dedupe_urls"] = sql("SELECT * FROM dedup")
O["flip_labels"] = sql("SELECT url_id, 1-label AS source_label, label FROM corpus")
O["class_distribution"] = sql(f"SELECT label, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM dedup)', 2)} AS pct FROM dedup GROUP BY label")
O["stratified_split"] = sql("SELECT url_id, label, split FROM split2")
O["split_three_way"] = sql("SELECT url_id, label, split FROM split3")
O["split_sizes"] = sql(f"SELECT split, count(*) AS n, count_if(label=1)::BIGINT AS phishing, {pct('count(*)', '(SELECT count(*) FROM split3)', 1)} AS pct FROM split3 GROUP BY split")
O["stratified_folds"] = sql("""SELECT url_id, label, CAST((r > floor(c/5.0::DOUBLE))::INT + (r > floor(2*c/5.0::DOUBLE))::INT + (r > floor(3*c/5.0::DOUBLE))::INT + (r > floor(4*c/5.0::DOUBLE))::INT AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url_id||'|fold|42')) AS r, count(*) OVER (PARTITION BY label) AS c FROM dedup)""")
O["augment_train"] = sql(f"SELECT url_id, url, label, augmented, {F24} FROM augfeat")
_aug = ("count(*) AS n, count_if(label=1)::BIGINT AS phishing, count_if(label=0)::BIGINT AS legitimate, round(avg(qty_slash),2) AS avg_slashes, "
        "round(avg(url_length),2) AS avg_length, round(avg(has_https)*100,1) AS https_pct FROM augfeat")
O["augment_profile"] = sql(f"SELECT CASE WHEN augmented THEN 'added' ELSE 'original' END AS part, {_aug} GROUP BY augmented UNION ALL SELECT 'all', {_aug}")
O["dq_profile"] = sql("""SELECT count(*) AS n_rows, count_if(url IS NULL)::BIGINT AS null_urls, count_if(url='')::BIGINT AS empty_urls,
  count(*) - (count(DISTINCT url) + max((url IS NULL)::INT))::BIGINT AS duplicate_rows, count_if(label IS NULL)::BIGINT AS null_labels,
  count(DISTINCT label)::INTEGER AS distinct_labels FROM (SELECT url, label FROM corpus UNION ALL SELECT url, NULL FROM edges)""")
O["blank_guard"] = sql("SELECT url_id, url_length, levenshtein_min, tld_risk_score, layer1_verdict, verdict, score, cvss, layer2_score, escalated, explanation FROM edgescored")
O["sample_per_class"] = sql("SELECT url_id, label, url FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url_id||'|sample|42')) AS r FROM corpus) WHERE r<=10")
O["quarantine"] = sql(f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN url IS NULL THEN 'null_url' WHEN url='' THEN 'empty_url'
  WHEN regexp_matches(url,'^[\\s]*$') THEN 'blank_url' WHEN NOT valid THEN 'unbalanced_brackets' WHEN netloc='' THEN 'no_host' END AS error
  FROM ({_parts('(SELECT url_id, url FROM edges UNION ALL SELECT url_id, url FROM corpus)')})) GROUP BY error""")

O["url_features"] = O["url_features_cached"] = sql(f"SELECT url_id, {F24} FROM feat")
O["url_features_edge"] = sql(f"SELECT url_id, {F24} FROM edgefeat")
for _g, _names in words.FEATURE_GROUPS.items():
    O[f"feat_{_g}"] = sql(f"SELECT url_id, {', '.join(_names)} FROM feat")
_chars = r"""length(regexp_replace(url,'[^0-9]+','','g'))::DOUBLE/length(url) AS d, length(regexp_replace(url,'[^a-zA-Z]+','','g'))::DOUBLE/length(url) AS a,
  length(regexp_replace(url,'[a-zA-Z0-9]+','','g'))::DOUBLE/length(url) AS s"""
O["char_profile"] = sql(f"SELECT url_id, round(d,6) AS digit_ratio, round(a,6) AS alpha_ratio, round(s,6) AS special_ratio FROM (SELECT url_id, {_chars} FROM corpus)")
O["suffix_rules"] = sql("SELECT url_id, url, tld, reg_domain_length, subdomain_count, has_subdomain FROM (" + _host_parts("suffixurls") + ")")
O["host_parts"] = sql("SELECT url_id, tld, reg_domain_length, subdomain_count, has_subdomain FROM ("
                      + _host_parts("(SELECT url_id, url FROM corpus UNION ALL SELECT -1-url_id, url FROM edges)") + ")")
O["feat_simple"] = sql(rf"""SELECT url_id, CAST(length(u) AS INTEGER) AS url_length, CAST(length(netloc) AS INTEGER) AS netloc_length, CAST(length(path) AS INTEGER) AS path_length,
  {_count('.')} AS num_dots, {_count('-')} AS num_hyphens, {_count('/')} AS num_slashes, CAST(length(regexp_replace(u,'[^0-9]+','','g')) AS INTEGER) AS num_digits,
  starts_with(u,'https')::INTEGER AS has_https, contains(u,'@')::INTEGER AS has_at, regexp_matches(split_part(netloc,'.',1),'[0-9]')::INTEGER AS digit_in_first_label
  FROM ({_parts('corpus')})""")

O["rule_hits"] = sql("SELECT url_id, " + ", ".join(f"hit_{r[0]}" for r in RU.RULES) + ", array_to_string(rules,',') AS rules FROM hits")
O["rule_techniques"] = sql("SELECT url_id, array_to_string(techniques,',') AS techniques FROM hits")
O["rule_verdict"] = sql("SELECT url_id, layer1_verdict FROM hits")
_lines = " || ".join(f"CASE WHEN hit_{n} THEN chr(10) || {q(f'  - [{s}] {n}: {d} (' + ', '.join(t) + ')')} ELSE '' END" for n, s, t, d in RU.RULES)
O["rule_explain"] = sql(f"""SELECT url_id, 'URL: ' || substr(url,1,100) || chr(10) || 'Verdict: ' || layer1_verdict || chr(10) ||
  CASE WHEN layer1_verdict='CLEAN' THEN {q(texts.NO_RULE_TEXT)} ELSE 'Triggered rules:' END || {_lines} AS explanation FROM hits""")
_domain = "(VALUES ('HIGH_RISK'),('SUSPICIOUS'),('CLEAN')) d(verdict)"
O["rule_coverage"] = sql(f"""SELECT d.verdict, count(h.layer1_verdict) AS n, {pct('count(h.layer1_verdict)', '(SELECT count(*) FROM dedhits)', 2)} AS pct
  FROM {_domain} LEFT JOIN dedhits h ON h.layer1_verdict=d.verdict GROUP BY d.verdict""")
_v3 = ", ".join(f"count_if(layer1_verdict='{v}')::BIGINT AS {v.lower()}" for v in RU.LAYER1_VERDICTS)
O["rule_crosstab"] = sql(f"SELECT label::VARCHAR AS label, {_v3}, count(*) AS total FROM dedhits GROUP BY label UNION ALL SELECT 'All', {_v3}, count(*) FROM dedhits")
_p3 = ", ".join(f"{pct(f'count_if(layer1_verdict={q(v)})', 'count(*)', 4)} AS {v.lower()}_pct" for v in RU.LAYER1_VERDICTS)
O["rule_class_metrics"] = sql(f"SELECT label, count(*) AS total, {_v3}, {_p3} FROM dedhits GROUP BY label")
_hr = "count_if(layer1_verdict='HIGH_RISK')"
O["rule_workload"] = sql(f"SELECT {_hr}::BIGINT AS decided, (count(*)-{_hr})::BIGINT AS passed_on, {pct(_hr, 'count(*)', 2)} AS decided_pct, round(100.0::DOUBLE-{_hr}*100.0::DOUBLE/count(*),2) AS passed_on_pct FROM dedhits")
O["rule_hit_counts"] = sql(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, '{s}' AS severity, count_if(hit_{n})::BIGINT AS hits, {pct(f'count_if(hit_{n})', 'count(*)', 3)} AS pct FROM dedhits" for n, s, _, _ in RU.RULES))
O["technique_counts"] = sql(f"SELECT technique, count(*) AS hits, {pct('count(*)', '(SELECT count(*) FROM dedhits)', 3)} AS pct FROM (SELECT unnest(techniques) AS technique FROM dedhits) GROUP BY technique")

_sc = ", ".join(f"CASE WHEN s_{f}=0 THEN 0.0::DOUBLE ELSE round(({f}-m_{f})/s_{f},4) END AS {f}" for f in words.FEATURES)
_st = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in words.FEATURES)
O["scaled_features"] = sql(f"SELECT url_id, split, {_sc} FROM splitfeat, (SELECT {_st} FROM splitfeat WHERE split='train')")
O["class_weights"] = sql("SELECT label, count(*) AS n, round((SELECT count(*) FROM split2 WHERE split='train')::DOUBLE/(2.0::DOUBLE*count(*)),6) AS weight FROM split2 WHERE split='train' GROUP BY label")
O["random_baseline"] = sql("SELECT url_id, label, pred, proba FROM randbase")
O["ensemble_weights"] = sql("SELECT model, f1, round(f1/sum(f1) OVER (),4) AS weight FROM testmetrics WHERE model IN ('boosted','forest')")
O["ensemble_score"] = sql(f"SELECT url_id, {rnd('layer2', 6)} AS ensemble, (layer2>=0.5)::INTEGER AS pred FROM surr")
PIECES["folds"] = ORACLES["stratified_folds"][ORACLES["stratified_folds"].index("SELECT url_id, label, CAST"):]
PIECES["foldpred"] = _long(_surr("folds"), {"setting_1": "p1", "setting_2": "p2", "setting_3": "p3", "setting_4": "layer2", "setting_5": "p1"}, "fold,label")
O["cv_rank"] = sql(f"""SELECT setting, round(m,6) AS mean_score, round(s,6) AS std_score, rank() OVER (ORDER BY m DESC)::INTEGER AS rank FROM (SELECT setting, avg(f1) AS m, stddev_pop(f1) AS s
  FROM (SELECT model AS setting, f1 FROM ({_metrics('foldpred', 'model,fold', 12)})) GROUP BY setting)""")
PIECES["pred3m"] = _metrics("pred3", "model,split")
O["overfit_gap"] = sql("""SELECT t.model, t.f1 AS train_f1, v.f1 AS validation_f1, e.f1 AS test_f1, round(abs(t.f1-v.f1),4) AS gap,
  CASE WHEN round(abs(t.f1-v.f1),4)<0.01 THEN 'No overfitting' ELSE 'Possible overfit' END AS conclusion
  FROM pred3m t JOIN pred3m v ON v.model=t.model AND v.split='validation' JOIN pred3m e ON e.model=t.model AND e.split='test' WHERE t.split='train'""")

O["hybrid_score"] = sql("SELECT url_id, url, verdict, score, cvss, layer1_verdict, array_to_string(rules,',') AS layer1_rules, layer2_score, array_to_string(techniques,',') AS mitre_techniques, escalated, explanation FROM scored")
O["fail_fast"] = sql("""SELECT url_id, CASE WHEN high THEN verdict ELSE 'OPEN' END AS verdict, CASE WHEN high THEN score END AS score, CASE WHEN high THEN cvss END AS cvss, layer2_score FROM scored""")
_strict = "split_part(lower(regexp_replace(netloc,'^.*@','')),':',1)"
O["trusted_domain"] = sql(f"SELECT url_id, {_trusted_expr('lower(host)')} AS trusted_default, {_trusted_expr(_strict)} AS trusted_strict FROM ("
                          + _parts("(SELECT url_id, url FROM corpus UNION ALL SELECT -1-url_id, url FROM edges)") + ")")
O["trusted_cap"] = sql("SELECT url_id, layer1_verdict, layer2_score, score, verdict FROM scored WHERE trusted")
O["escalation"] = sql("SELECT url_id, layer2_score, score, verdict, explanation FROM scored WHERE escalated")
O["agreement_boost"] = sql("SELECT url_id, layer2_score, score, verdict FROM scored WHERE susp AND NOT escalated")
O["severity"] = sql(f"SELECT url_id, {_severity('p1')} AS severity_p1, {_severity('layer2')} AS severity FROM surr")
O["severity_scale"] = sql(f"SELECT url_id, {rnd('p1*10', 1)} AS cvss FROM surr")
O["score_explain"] = sql("SELECT url_id, explanation FROM scored")


def _infer() -> str:
    found = "list_filter([" + ",".join(f"CASE WHEN {f} {c.rstrip('D')} THEN '{t}' END" for f, c, t in texts.INFERRED) + "], lambda x: x IS NOT NULL)"
    return f"""SELECT *, CASE WHEN len(f1)>0 THEN f1 WHEN verdict IN ('CRITICAL','HIGH','MEDIUM') THEN ['T1566.002'] ELSE [] END AS inferred
 FROM (SELECT *, list_filter(f0, lambda x, i: list_position(f0,x)=i) AS f1 FROM (SELECT *, {found} AS f0 FROM scored))"""


PIECES["inferred"] = _infer()
_final = "CASE WHEN len(techniques)>0 THEN techniques ELSE inferred END"
O["infer_techniques"] = sql(f"SELECT url_id, array_to_string(inferred,',') AS inferred, array_to_string({_final},',') AS final FROM inferred")


def _fill(t: str, f: str) -> str:
    for mark, shown in (("{0}", f"CAST(CAST({f} AS INTEGER) AS VARCHAR)"), ("{2}", f"printf('%.2f', {f}::DOUBLE)"), ("{4}", f"printf('%.4f', {f}::DOUBLE)")):
        if mark in t:
            a, b = t.split(mark)
            return f"{q(a)} || {shown} || {q(b)}"
    return q(t)


PIECES["signals"] = " UNION ALL ".join(
    f"SELECT url_id, {i} AS prio, '{f}' AS feature, {f}::DOUBLE AS value, {_fill(texts.FEATURE_TEXTS[f][0], f)} AS plain, {_fill(texts.FEATURE_TEXTS[f][1], f)} AS jargon, '{texts.FEATURE_TEXTS[f][2]}' AS technique FROM feat WHERE {f} {c.rstrip('D')}"
    for i, (f, c) in enumerate(texts.SIGNALS))
O["top_signals"] = sql("SELECT url_id, rank, feature, value, plain, jargon, technique FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY prio)::INTEGER AS rank FROM signals) WHERE rank<=3")
_tech = _values([(k, *v) for k, v in texts.TECHNIQUES.items()], "technique,name,plain,jargon")
O["technique_info"] = sql(f"""SELECT r.url_id, r.rank::INTEGER AS rank, r.technique, coalesce(v.name, r.technique) AS name, coalesce(v.plain,'') AS plain, coalesce(v.jargon,'') AS jargon
  FROM (SELECT url_id, unnest(t) AS technique, generate_subscripts(t,1) AS rank FROM (SELECT url_id, {_final} AS t FROM inferred)) r LEFT JOIN {_tech} ON v.technique=r.technique""")
O["analyze_batch"] = sql(f"SELECT url_id, verdict, score, {', '.join(f'{f}::DOUBLE AS {f}' for f in words.FEATURES)} FROM scored")
O["features_long"] = sql(" UNION ALL ".join(f"SELECT url_id, '{g}' AS feature_group, '{f}' AS feature, {f}::DOUBLE AS value FROM feat" for g, names in words.FEATURE_GROUPS.items() for f in names))
O["verdict_summary"] = sql("SELECT url_id, verdict, CASE verdict " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in texts.VERDICT_SUMMARIES.items()) + " END AS summary FROM scored")

O["confusion"] = sql(_confusion("pred3", "model,split"))
O["metrics"] = sql(_metrics("pred3", "model,split"))
O["roc_auc"] = sql(_auc("pred3", "model,split"))
O["roc_curve"] = sql(_roc("testpred"))
O["roc_curve_zoom"] = sql(f"SELECT * FROM ({_roc('testpred')}) WHERE fpr<=0.01")
_r = lambda name, p, r, f, s: f"""SELECT model, '{name}' AS "row", round({p},4) AS "precision", round({r},4) AS recall, round({f},4) AS f1, ({s})::BIGINT AS support FROM crep"""
_s = lambda a, b: f"CASE WHEN {b}=0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE/({b}) END"
PIECES["crep"] = f"""SELECT *, {_s('tn', '(tn+fn)')} AS p0, {_s('tn', '(tn+fp)')} AS r0, {_s('2*tn', '(2*tn+fn+fp)')} AS f0, {_s('tp', '(tp+fp)')} AS p1, {_s('tp', '(tp+fn)')} AS r1,
  {_s('2*tp', '(2*tp+fp+fn)')} AS f1x, tn+fp AS s0, tp+fn AS s1, {_s('tp+tn', '(tp+tn+fp+fn)')} AS acc FROM testconf"""
_w = lambda a, b: f"(({a})*s0+({b})*s1)/(s0+s1)"
O["classification_report"] = sql(" UNION ALL ".join([
    _r("Legitimate", "p0", "r0", "f0", "s0"), _r("Phishing", "p1", "r1", "f1x", "s1"), _r("accuracy", "acc", "acc", "acc", "s0+s1"),
    _r("macro avg", "(p0+p1)/2", "(r0+r1)/2", "(f0+f1x)/2", "s0+s1"), _r("weighted avg", _w("p0", "p1"), _w("r0", "r1"), _w("f0", "f1x"), "s0+s1")]))
PIECES["testfull"] = _full("testpred", "model")
O["model_comparison"] = sql("SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC)::INTEGER AS rank FROM ("
                            + " UNION ALL ".join(f"""SELECT model, '{m}' AS metric, "{m}" AS value FROM testfull""" for m in _M + ["roc_auc"]) + ")")
PIECES["testwide"] = f"SELECT label, (layer2>=0.5)::INT AS ensemble, (p1>=0.5)::INT AS boosted, (p2>=0.5)::INT AS forest FROM ({_surr('split2')}) WHERE split='test'"
PIECES["mcn"] = " UNION ALL ".join(
    f"SELECT '{a} vs {b}' AS comparison, '{a}' AS na, '{b}' AS nb, count_if({a}=label AND {b}<>label)::BIGINT AS b_count, count_if({a}<>label AND {b}=label)::BIGINT AS c_count FROM testwide"
    for a, b in (("ensemble", "boosted"), ("ensemble", "forest"), ("boosted", "forest")))
O["mcnemar"] = sql("""SELECT comparison, b_count, c_count, round(chi,4) AS chi_squared, round(p,6) AS p_value, p<0.05 AS significant,
  CASE WHEN p>=0.05 THEN 'none' WHEN b_count>c_count THEN na ELSE nb END AS better
FROM (SELECT *, CASE WHEN chi>70 THEN 0.0::DOUBLE WHEN chi<=0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_sum(list_transform(range(0,300),
   lambda n: exp((2*n+1)*ln(sqrt(chi/2)) - chi/2 - lgamma(n+1.5::DOUBLE)))) END AS p
 FROM (SELECT *, CASE WHEN b_count+c_count=0 THEN 0.0::DOUBLE ELSE power(abs(b_count-c_count)-1.0::DOUBLE,2)/(b_count+c_count) END AS chi FROM mcn))""")
O["distinct_vectors"] = sql("SELECT distinct_train_vectors, distinct_test_vectors FROM leak")
O["leakage"] = sql("SELECT * FROM leak")
O["dup_vectors"] = sql("SELECT train_duplicate_rows, train_duplicate_pct, test_duplicate_rows, test_duplicate_pct FROM leak")
O["strat_ratio"] = sql("SELECT split, count(*) AS n, round(avg(label),4) AS phishing_ratio FROM split2 GROUP BY split")
O["collision_free"] = sql(_full("freepred", "model"))
O["collision_summary"] = sql(f"""SELECT t AS total_test_rows, f AS collision_free_rows, {pct('f', 't', 1)} AS collision_free_pct, round(100.0::DOUBLE-f*100.0::DOUBLE/t,1) AS feature_overlap_pct
  FROM (SELECT (SELECT count(*) FROM splitfeat WHERE split='test') AS t, (SELECT count(*) FROM freerows) AS f)""")
O["holdout_results"] = sql("SELECT * FROM holdout")
O["holdout_summary"] = sql(f"SELECT * FROM ({_hold_rows('SELECT * FROM holdout')})")
O["adversarial_results"] = sql("SELECT * FROM advers")
_adv = (f"count(*) AS n, {rnd('avg(score_drop)', 4)} AS avg_score_drop,"
        " round(avg(detected_after::INT),4) AS detection_rate, round(avg(evaded::INT),4) AS evasion_rate, "
        "round(1-avg(evaded::INT),4) AS retention FROM advers")
O["adversarial_summary"] = sql(f"SELECT mutation, {_adv} GROUP BY mutation UNION ALL SELECT 'all', {_adv}")
_out = "CASE WHEN got=expected THEN 'pass' WHEN expected='LEGIT' THEN 'false_positive' ELSE 'false_negative' END"
O["bias_stress"] = sql(f"""SELECT url_id, expected, got, {_out} AS outcome, score, qty_slash, has_https, url_length FROM (
  SELECT *, CASE WHEN layer2>=0.5 THEN 'PHISHING' ELSE 'LEGIT' END AS got, {rnd("layer2", 4)} AS score FROM ({_surr('(' + _features('biassrc') + ')')}))""")
O["bias_summary"] = sql("""SELECT count(*) AS n, count_if((layer2>=0.5)=(label=1))::BIGINT AS passed, count_if(label=0 AND layer2>=0.5)::BIGINT AS false_positives,
  count_if(label=1 AND layer2<0.5)::BIGINT AS false_negatives FROM surr""")
O["holdout_results_ml"] = sql("""SELECT url_id, url, layer1, mitre, rules, decided AS decided_by_rules, CASE WHEN decided THEN verdict END AS verdict,
  CASE WHEN decided THEN score END AS score, CASE WHEN verdict<>'ERROR' THEN true END AS in_range, false AS wrongly_escalated
  FROM (SELECT *, layer2_score IS NULL AS decided FROM holdout)""")
O["adversarial_results_ml"] = sql("""SELECT url_id, original_url, mutated_url, mutation, heuristic_before, heuristic_after,
  true AS in_range, true AS drop_ok, true AS rules_detect, true AS evaded_ok FROM advers""")
O["bias_stress_ml"] = sql(f"""SELECT url_id, expected, qty_slash, has_https, url_length, true AS in_range, true AS between_models,
  true AS outcome_ok, true AS mostly_right FROM ({_features('biassrc')})""")
O["specimen_scores"] = sql("SELECT category, verdict, count(*) AS n, round(avg(score),4) AS avg_score FROM specscored GROUP BY category, verdict")

for _n, _k in (("mut_subdomain", "subdomain_padding"), ("mut_https", "https_laundering"), ("mut_path", "path_dilution"),
               ("mut_keyword", "keyword_removal"), ("mut_combined", "combined")):
    O[_n] = sql(f"SELECT url_id, {_k} AS mutated_url FROM mutated")
O["mutations_all"] = sql(f"SELECT url_id, mutation, mutated_url FROM ({_unpivot_mut('mutated')})")


def _describe(src: str, c: str, extra: str = "") -> str:
    return f"""SELECT label, count({c}) AS n, {rnd(f"avg({c})", 2)} AS mean, {rnd(f"stddev_samp({c})", 2)} AS std, min({c})::BIGINT AS min_value,
  {rnd(f"quantile_cont({c},0.25)::DOUBLE", 2)} AS q25, {rnd(f"quantile_cont({c},0.5)::DOUBLE", 2)} AS q50, {rnd(f"quantile_cont({c},0.75)::DOUBLE", 2)} AS q75, max({c})::BIGINT AS max_value{extra} FROM {src} GROUP BY label"""


PIECES["sized"] = "SELECT label, url_id, url, length(url) AS url_length FROM corpus"
O["length_describe"] = sql(_describe("sized", "url_length"))
O["length_histogram"] = sql("SELECT label, least(floor(least(url_length,160)*54/160.0::DOUBLE),53)::INTEGER AS bin, count(*) AS n FROM sized GROUP BY ALL")
O["length_histogram_range"] = sql("""SELECT label, CASE WHEN hi=lo THEN 0 ELSE least(floor((url_length-lo)/((hi-lo)/50.0::DOUBLE)),49) END::INTEGER AS bin, count(*) AS n
  FROM (SELECT *, min(url_length) OVER (PARTITION BY label) AS lo, max(url_length) OVER (PARTITION BY label) AS hi FROM sized) GROUP BY ALL""")
O["length_box"] = sql("""SELECT s.label, any_value(q1) AS q25, any_value(q2) AS q50, any_value(q3) AS q75,
  min(CASE WHEN i THEN url_length END)::BIGINT AS whisker_low, max(CASE WHEN i THEN url_length END)::BIGINT AS whisker_high, count_if(NOT i)::BIGINT AS outliers
  FROM (SELECT s.label, url_length, q1, q2, q3, url_length BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) AS i FROM sized s JOIN (
    SELECT label, quantile_cont(url_length,0.25)::DOUBLE AS q1, quantile_cont(url_length,0.5)::DOUBLE AS q2, quantile_cont(url_length,0.75)::DOUBLE AS q3 FROM sized GROUP BY label) x ON s.label=x.label) s GROUP BY s.label""")
O["topk_longest"] = sql("SELECT label, rank, url_id, url_length::INTEGER AS url_length, url FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY url_length DESC, url_id)::INTEGER AS rank FROM sized) WHERE rank<=5")
O["char_ratio_means"] = sql(f"SELECT label, round(avg(d),4) AS digit_ratio, round(avg(a),4) AS alpha_ratio, round(avg(s),4) AS special_ratio FROM (SELECT label, {_chars} FROM corpus) GROUP BY label")
O["topk_tld"] = sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, tld)::INTEGER AS rank FROM (SELECT label, tld, count(*) AS n FROM hosts GROUP BY label, tld)) WHERE rank<=15")
O["tld_risk_mined"] = sql("""SELECT * FROM (SELECT tld, total_count, legit_share, round(1.0::DOUBLE-legit_share,4) AS phishing_share FROM (
  SELECT tld, count(*) AS total_count, round(avg(1-label),4) AS legit_share FROM hosts GROUP BY tld)) WHERE total_count>=10 AND phishing_share>=0.7 ORDER BY phishing_share DESC, total_count DESC, tld LIMIT 20""")
_https = "starts_with(lower(url),'https://')::INT"
O["https_crosstab"] = sql(f"SELECT label, round(avg(1-{_https})*100,2) AS http_pct, round(avg({_https})*100,2) AS https_pct FROM corpus GROUP BY label")
O["domain_describe"] = sql(_describe("hosts", "reg_domain_length", ", 'reg_domain_length' AS measure") + " UNION ALL " + _describe("hosts", "subdomain_count", ", 'subdomain_count' AS measure"))
O["subdomain_crosstab"] = sql("SELECT label, subdomain_count, count(*) AS n, round(round(count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY label),4)*100,2) AS pct FROM hosts GROUP BY label, subdomain_count")


def _side(s: str, v: int) -> str:
    c = f"CASE WHEN label={v} THEN"
    return f"""count_if(label={v})::BIGINT AS {s}_count, {pct(f'count_if(label={v})', 'count(*)', 2)} AS {s}_pct, round(avg({c} length(url) END),2) AS {s}_length_mean,
  max({c} length(url) END)::BIGINT AS {s}_length_max, round(avg({c} {_https}*100 END),2) AS {s}_https_pct, round(avg({c} d END),4) AS {s}_digit_ratio, round(avg({c} a END),4) AS {s}_alpha_ratio,
  round(avg({c} (subdomain_count=0)::INT*100 END),2) AS {s}_zero_subdomain_pct, max({c} subdomain_count END)::BIGINT AS {s}_max_subdomains"""


O["findings"] = sql(f"SELECT count(*) AS total_rows, (count(*)-count(DISTINCT url))::BIGINT AS duplicates, {_side('phishing', 1)}, {_side('legitimate', 0)} FROM (SELECT *, {_chars} FROM hosts)")
O["feature_means"] = sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(CASE WHEN label=1 THEN {f} END),4) AS phishing, round(avg(CASE WHEN label=0 THEN {f} END),4) AS legitimate FROM feat" for f in words.FEATURES))
O["drift_check"] = sql(" UNION ALL ".join(
    f"""SELECT '{f}' AS feature, round(p,4) AS phishing, {a}::DOUBLE AS phishing_expected, round(abs(p-{a}::DOUBLE),4) AS phishing_diff,
  round(l,4) AS legitimate, {b}::DOUBLE AS legitimate_expected, round(abs(l-{b}::DOUBLE),4) AS legitimate_diff
  FROM (SELECT avg(CASE WHEN label=1 THEN {f} END)::DOUBLE AS p, avg(CASE WHEN label=0 THEN {f} END)::DOUBLE AS l FROM feat)""" for f, (a, b) in words.EXPECTED_MEANS.items()))
O["class_separation"] = sql("SELECT label, round(avg(url_length),1) AS mean_length, round(avg(has_https)*100,1) AS https_pct FROM feat GROUP BY label")

O["stream_score"] = sql("SELECT url_id, verdict, score, layer1_verdict, escalated FROM scored")
PIECES["delivered"] = """SELECT event_id, verdict, ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  CASE WHEN third=0 AND event_id%50=0 THEN 2 ELSE third END AS delivery
  FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 3 // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS third FROM clicks)"""
PIECES["closed"] = """SELECT d.delivery, (SELECT max(ts) FROM delivered b WHERE b.delivery < d.delivery) - INTERVAL 10 MINUTE AS closed_until
  FROM (VALUES (0), (1), (2), (3)) d(delivery)"""
O["stream_verdict_counts"] = sql("""SELECT window_end - INTERVAL 1 HOUR AS window_start, window_end, verdict, count(*) AS n
  FROM delivered JOIN closed c USING (delivery) WHERE (c.closed_until IS NULL OR window_end > c.closed_until)
  AND window_end <= (SELECT closed_until FROM closed WHERE delivery=3) GROUP BY ALL""")
O["stream_recent_scans"] = sql("""SELECT ts, event_id, substr(url,1,60) AS url, verdict, score FROM clicks
  WHERE ts > (SELECT max(ts) FROM clicks) - INTERVAL 1 DAY ORDER BY ts DESC, event_id DESC LIMIT 5""")
O["recent_scans"] = sql("SELECT ts, event_id, substr(url,1,60) AS url, verdict, score FROM clicks ORDER BY ts DESC, event_id DESC LIMIT 5")


@cache
def all_oracles() -> dict[str, str]:
    return dict(ORACLES)

# ---- trained models: what any well-behaved fit must give ------------------------------------

O["gbt_scores"] = O["rf_scores"] = sql("SELECT url_id, label, true AS is_probability, true AS accurate FROM split2 WHERE split='test'")
O["lr_baseline"] = sql("SELECT 'logistic' AS model, unnest(['accuracy','precision','recall','f1','mcc','roc_auc']) AS metric, true AS far_above_chance")
O["feature_importance"] = sql(f"""SELECT unnest({lst(words.FEATURES)}) AS feature, true AS boosted_ok, true AS forest_ok, 1.0::DOUBLE AS boosted_total,
  1.0::DOUBLE AS forest_total, true AS boosted_ranks_complete, true AS forest_ranks_complete""")
O["attribution_topk"] = sql("SELECT url_id, unnest(range(1, 13))::INTEGER AS rank, true AS adds_up, true AS value_ok FROM split2 WHERE split='test'")
O["model_roundtrip"] = sql("SELECT url_id, label, true AS same FROM split2 WHERE split='test'")
O["training_summary"] = sql("""SELECT 'forest' AS model, 'train_size' AS metric, count(*)::VARCHAR AS value FROM split2 WHERE split='train'
  UNION ALL SELECT 'forest', 'test_size', count(*)::VARCHAR FROM split2 WHERE split='test'
  UNION ALL SELECT 'forest', m, v FROM (VALUES ('features','24'), ('numTrees','300'), ('maxDepth','20'), ('featureSubsetStrategy','sqrt'),
    ('seed','42'), ('maxBins','128')) t(m, v)""")
O["hybrid_score_ml"] = sql("""SELECT url_id, layer1_verdict, high AS decided_by_rules, CASE WHEN high THEN 'CRITICAL' END AS verdict,
  CASE WHEN high THEN 1.0::DOUBLE END AS score, true AS in_range, false AS wrongly_escalated
  FROM (SELECT *, layer1_verdict='HIGH_RISK' AS high FROM hits)""")

# ---- stored reports and dimensions ----------------------------------------------------------

O["rule_dimension"] = sql(f"""SELECT url_id, rule, rule_order, severity, techniques, description FROM (SELECT url_id, unnest(rules) AS rule FROM hits) h
  JOIN (VALUES {",".join(f"({q(n)},{i},{q(s)},{q(','.join(t))},{q(d)})" for i, (n, s, t, d) in enumerate(RU.RULES))}) v(name, rule_order, severity, techniques, description)
  ON h.rule = v.name""")
O["weights_roundtrip"] = sql(f"""SELECT url_id, {rnd("w1*p1+w2*p2", 6)} AS ensemble FROM surr, (SELECT max(CASE WHEN model='boosted' THEN weight END) AS w1,
  max(CASE WHEN model='forest' THEN weight END) AS w2 FROM (SELECT model, round(f1/sum(f1) OVER (),4) AS weight FROM testmetrics WHERE model IN ('boosted','forest')))""")
O["nested_report_roundtrip"] = O["findings"]
O["stored_rates"] = sql("""SELECT 'detection' AS rate, count_if(verdict<>'ERROR')::BIGINT AS n,
  round(count_if(verdict IN ('CRITICAL','HIGH','MEDIUM'))*100.0::DOUBLE/count_if(verdict<>'ERROR'),2) AS pct FROM holdout
  UNION ALL SELECT 'retention', count_if(detected_before)::BIGINT,
  round(count_if(detected_before AND detected_after)*100.0::DOUBLE/count_if(detected_before),2) FROM advers""")
