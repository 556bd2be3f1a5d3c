"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a pattern. ``host/path`` fits a host, its subdomains and
paths that start alike. A pattern in slashes, ``/.../``, is a regular expression
over the lower-cased url, whose literal tokens are read off it. A corpus-wide
count of tokens picks each rule's rarest one, and a url runs only the regular
expressions of the rules that its own tokens fetch.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import arrow_batches, whole_row, with_fields

TOKEN = re.compile(r"[a-z0-9]+")
TOKEN_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_sre = re._constants


_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` of a site rule, or ``regex``, whose literal tokens are
    read off it where they aren't given."""

    action: str
    host: str = ""
    path: str = ""
    regex: str = ""
    literals: tuple[str, ...] | None = None

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else self.regex

    def tokens(self) -> list[str]:
        """Tokens that every lower-cased url holds which the rule fits. Whole ones: a
        host rule's labels stand between dots, the last token of its path may go on."""
        if not self.host:
            return literal_tokens(self.regex) if self.literals is None else list(self.literals)
        return TOKEN.findall(self.host) + TOKEN.findall(self.path.rpartition("/")[0].translate(_LOWER))

    def pattern(self) -> re.Pattern:
        if not self.host:
            return re.compile(self.regex)
        return re.compile(rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}", re.S)


def literal_tokens(regex: str) -> list[str]:
    """The [a-z0-9]+ tokens that stand whole in every text the expression is found
    in: literals of its outermost sequence with an edge on either side, which is an
    anchor, another literal sign, or a group that can only go on with such an edge."""

    def edge(item) -> bool:
        op, arg = item
        if op is _sre.AT:  # the start or end of a text, or the boundary of a word
            return arg is not _sre.AT_NON_BOUNDARY
        if op is _sre.LITERAL:
            return chr(arg).lower() not in TOKEN_SIGNS
        if op is _sre.IN:
            return all(o is _sre.LITERAL and chr(a).lower() not in TOKEN_SIGNS for o, a in arg)
        if op is _sre.SUBPATTERN:
            return bool(arg[3]) and edge(arg[3][0])
        if op is _sre.BRANCH:
            return all(len(b) and edge(b[0]) for b in arg[1])
        return False

    out, run, whole = [], "", False  # whole: an edge comes before the run
    for item in [*re._parser.parse(regex), None]:
        op, arg = item or (None, None)
        if op is _sre.LITERAL and chr(arg) in TOKEN_SIGNS:
            run += chr(arg)
            continue
        ends = item is not None and edge(item)
        if run and whole and ends:
            out.append(run)
        # A group may end in anything; a sign or an anchor is an edge for what follows.
        run, whole = "", ends and op in (_sre.AT, _sre.LITERAL, _sre.IN)
    return out


def site(action: str, rule: str) -> Rule:
    host, _, path = rule.partition("/")
    return Rule(action, host.translate(_LOWER), "/" + path)


def rules_of(lines: list[str]) -> tuple[Rule, ...]:
    """Rules as text, one a line: ``allow host/path`` or ``block /regex/``; empty
    lines and those from ``#`` on are no rules."""
    out = []
    for line in lines:
        action, _, rule = line.strip().partition(" ")
        rule = rule.strip()
        if not action or action.startswith("#"):
            continue
        if action not in ("allow", "block") or not rule:
            raise ValueError(f"Not a rule: {line!r}")
        out.append(Rule(action, regex=rule[1:-1]) if rule.startswith("/") and rule.endswith("/") and len(rule) > 2 else site(action, rule))
    return tuple(out)


# The rules that the query's contract fixes.
SITE_RULES = (
    site("allow", "com/"),
    site("block", "example.com/en/"),
    site("allow", "www.example.com/en/"),
    site("block", "net/es/"),
    site("block", "net/fr/"),
)

# Pattern rules: spam and adult trade words as a whole token of the host, trackers
# and advert servers, downloads that are no pages. Whole tokens only, so that
# "essex" or "therapist" fits nothing.
PATTERN_RULES = tuple(
    Rule("block", regex=rf"^[^/?#]*\b{a}-{b}\b")
    for a, b in (
        ("cheap", "pills"), ("online", "casino"), ("casino", "bonus"), ("free", "slots"), ("sports", "betting"), ("payday", "loans"),
        ("quick", "loans"), ("replica", "watches"), ("diet", "pills"), ("weight", "loss"), ("escort", "service"), ("live", "cams"),
        ("adult", "chat"), ("free", "porn"), ("essay", "writing"), ("buy", "followers"), ("crypto", "doubler"), ("win", "prizes"),
    )
) + (
    *(Rule("block", regex=rf"^[^/?#]*\b{w}\b") for w in ("porn", "xxx", "casino", "viagra", "warez")),
    *(Rule("block", regex=rf"^{w}\.") for w in ("ads", "adserver", "doubleclick", "tracker", "malware")),
    Rule("block", regex=r"^[^/?#]*/(?:[^?#]*/)?wp-login\.php"),
    *(Rule("block", regex=rf"^[^/?#]*/[^?#]*\.{w}(?:[?#]|$)") for w in ("exe", "apk", "zip", "torrent", "mp4")),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """The contract's host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWER), path


def token_counts(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls hold each literal token of the rules: as many rows as the
    rules have tokens, counted by Spark over all urls."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    want = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    found = urls.select(F.explode(tokens).alias("t")).join(F.broadcast(want), "t").groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list], list]:
    """token -> [(rank, rule name, action, is a site rule, regex)], and the rules
    without a literal, which every url runs. Ranks: site rules before patterns,
    longer before shorter, then the order of the list."""
    by: dict[str, list] = defaultdict(list)
    for i, r in enumerate(rules):
        entry = ((0 if r.host else 1, -len(r.name) if r.host else i, i), r.name, r.action, bool(r.host), r.pattern())
        tokens = r.tokens()
        by[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else ""].append(entry)
    return dict(by), by.get("", [])


def judge_urls(pages: DataFrame, url: str = "url", keep: list[str] | None = None, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """``keep`` (all columns but these results) with host, path, rule, verdict and
    pattern.

    The longest site rule that fits decides; else the first pattern rule in the
    list; else ``default``. ``rule`` names the site rule or is null, ``pattern``
    the pattern rule that decided or is null. A null url, or one without ``://``,
    has an empty host and path and gets the default. Every row gives one row,
    repeated rows the same ones; an empty table gives none.
    """
    results = ["host", "path", "rule", "verdict", "pattern"]
    keep = [c for c in (keep or pages.columns) if c not in results]
    counts = token_counts(pages.select(url), url, rules)
    by, always = index(rules, counts)
    arrow_batches(pages.sparkSession, 4096)
    src = pages.select(F.struct(*keep).alias("_row"), F.col(url).alias("_url"))
    schema = with_fields(src.select("_row"), ", ".join(f"{c} string" for c in results))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for u in b.column("_url"):
                u = u.as_py()
                host, path = host_and_path(u)
                best = None
                if host or path:
                    full = host + path
                    low = u.partition("://")[2].translate(_LOWER)
                    tokens = set(TOKEN.findall(low))
                    fetched = [e for t in tokens if t in by for e in by[t]] + always
                    # Site rules read host and path as they are, patterns the lower-cased url.
                    fits = (e for e in fetched if (e[4].match(full) if e[3] else e[4].search(low)))
                    best = min(fits, key=lambda e: e[0], default=None)
                if best is None:
                    out.append((host, path, None, default, None))
                else:
                    out.append((host, path, best[1] if best[3] else None, best[2], None if best[3] else best[1]))
            cols = [pa.array(list(c), pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([b.column("_row"), *cols], names=schema.names)

    return src.mapInArrow(run, schema).select("_row.*", *results)


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, all their columns."""
    return judge_urls(pages.select(whole_row(), F.col(url).alias("_at")), "_at", ["_row"], rules).filter("verdict = 'allow'").select("_row.*")
