"""URL rules indexed by their rarest literal token.

Every rule names tokens (runs of a-z and 0-9) that a matching URL must hold whole. How many URLs hold each of these
tokens is counted over all URLs; a rule is filed under its rarest one. A URL's own tokens then fetch the few rules that
can match, and only those run their regular expressions.

Site rules (host and path prefix) come first and the longest wins; if none fits, pattern rules decide: block if any
fits, else allow.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no site rule and, if null, no pattern
rule; null ids pass through; repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST, _PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
#: Rules travel to every executor, so their number is bounded.
MOST_RULES = 200_000


def url_tokens(url: str) -> set[str]:
    return set(_TOKEN.findall(url.translate(_LOWER)))


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) after the first ``://``; path up to a query or fragment."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def literals(self) -> frozenset[str]:
        # a prefix may end inside a token of the URL, so the path's last token counts only if something closes it
        closed = self.path[: len(self.path.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))]
        return frozenset(url_tokens(self.host) | url_tokens(closed))

    def compiled(self):
        return re.compile(rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}", re.DOTALL)


@dataclass(frozen=True)
class PatternRule:
    """Fits where ``pattern`` is found in the URL in lower case; ``literals`` are tokens that every such URL holds whole."""

    pattern: str
    literals: frozenset[str] = field(default_factory=frozenset)
    verdict: str = "block"

    @property
    def name(self) -> str:
        return self.pattern

    def compiled(self):
        return re.compile(self.pattern)


#: The site rules of the query.
SITE_RULES = (
    SiteRule("net", "/", "block"),
    SiteRule("example.net", "/en/", "allow"),
    SiteRule("example.com", "/de/", "block"),
    SiteRule("org", "/fr/", "allow"),
)
#: Pattern rules for pages that are no prose: adverts, logins, carts, trackers, adult or gambling hosts, binaries.
PATTERN_RULES = tuple(
    PatternRule(pattern, frozenset(literals.split()))
    for pattern, literals in (
        (r"://ad\.", "ad"),
        (r"://ads\.", "ads"),
        (r"/ads/", "ads"),
        (r"\badserver\b", "adserver"),
        (r"\bdoubleclick\b", "doubleclick"),
        (r"/wp-(?:admin|login)\b", "wp"),
        (r"/(?:sign-in|sign-up)\b", "sign"),
        (r"/login(?:[/?.]|$)", "login"),
        (r"/logout(?:[/?.]|$)", "logout"),
        (r"/cart/(?:add|checkout)\b", "cart"),
        (r"[?&]phpsessid=", "phpsessid"),
        (r"[?&]jsessionid=", "jsessionid"),
        (r"://(?:[^/]*[.-])?casino[.-]", "casino"),
        (r"://(?:[^/]*[.-])?poker[.-]", "poker"),
        (r"://(?:[^/]*[.-])?porn[.-]", "porn"),
        (r"://(?:[^/]*[.-])?xxx(?:[./?#:]|$)", "xxx"),
        (r"\.exe(?:[?#]|$)", "exe"),
        (r"\.zip(?:[?#]|$)", "zip"),
    )
)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; the result has one row a token of a rule."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    lower = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    rows = held.join(F.broadcast(wanted), "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: list, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rarest literal token to rules, and the rules without one, which every URL runs."""
    index: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    return index, always


class Judge:
    def __init__(self, rules: list, index: dict[str, list[int]], always: list[int]):
        self.rules, self.index, self.always = rules, index, always
        self.patterns = [r.compiled() for r in rules]

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """host, path, site rule, verdict, pattern rule, and how many rules ran."""
        host, path = host_path(url)
        if url is None:
            return host, path, None, "allow", None, 0
        ran, site, hit = list(self.always), None, None
        for t in url_tokens(url):
            ran += self.index.get(t, ())
        for k in ran:
            rule = self.rules[k]
            if isinstance(rule, SiteRule):
                if host and (site is None or (len(rule.name), rule.name) > (len(site.name), site.name)) and self.patterns[k].match(f"{host}\n{path}"):
                    site = rule
            elif (hit is None or k < hit) and self.patterns[k].search(url.translate(_LOWER)):
                hit = k
        verdict = site.verdict if site else self.rules[hit].verdict if hit is not None else "allow"
        return host, path, site.name if site else None, verdict, self.rules[hit].name if hit is not None else None, len(ran)


_JUDGED = pa.schema([("page_id", pa.int64())] + [(c, pa.string()) for c in ("host", "path", "rule", "verdict", "pattern")] + [("rules_run", pa.int32())])


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict, pattern, rules_run."""
    rules = [*site_rules, *pattern_rules]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} travel to the executors")
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    tokens = sorted(set().union(*(r.literals for r in rules))) if rules else []
    index, always = rule_index(rules, token_counts(urls, tokens) if tokens else {})

    def run(batches):
        judge = Judge(rules, index, always)
        for batch in batches:
            found = [judge(u) for u in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_JUDGED)[1:], strict=True))], schema=_JUDGED)

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string, rules_run int")
