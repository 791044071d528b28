"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule has an action and either a host with a path prefix (it then fits that host and all its subdomains) or a
wildcard pattern over the whole URL. Every rule compiles to one regular expression. Its literal tokens (runs of letters
and digits that any matching URL must contain as whole tokens) are counted over all URLs by one grouped aggregation, whose result
has a row per token of the rules at most, and the rule is filed under its rarest one; rules without a sure token are tried on
every URL. A URL's own tokens fetch the rules filed under them, and only
those run their expression. Of the host rules that fit, the longest decides. Otherwise the pattern rules decide: an
allowing one overrides blocking ones, and a URL that fits none is allowed.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no host rule and has no tokens, so only
token-free patterns can judge it. Repeated rows give repeated results; ties between equally long host rules go to block.
Other columns are kept out of the result. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    """action: allow or block. host and path make a host rule; pattern (with * for any run) a pattern rule."""

    action: str
    host: str | None = None
    path: str = "/"
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.pattern if self.host is None else self.host + self.path

    def expression(self) -> str:
        """Host rules run on "host path" joined by a blank, patterns on the lower-cased URL."""
        if self.host is not None:
            return rf"(?:[^/]*\.)?{re.escape(self.host)} {re.escape(self.path)}"
        return "(?s:.*" + ".*".join(map(re.escape, self.pattern.split("*"))) + ")"

    def tokens(self) -> set[str]:
        """Tokens that any fitting URL has: literal runs that nothing in the rule lets grow to a longer run."""
        if self.host is not None:
            sure = TOKEN.findall(self.host)
            path = self.path.translate(ASCII_LOWER)
            return set(sure) | {m.group() for m in TOKEN.finditer(path) if m.end() < len(path) and m.start() > 0}
        return {
            m.group()
            for part in self.pattern.split("*")
            for m in TOKEN.finditer(part)
            if m.start() > 0 and m.end() < len(part)
        }


#: Patterns used where no host rules fit: kinds of site that training corpora leave out.
DEFAULT_PATTERNS = tuple(
    Rule("block", pattern=p)
    for p in ("://ads.*", "/ads/*", "/adserver/*", "/banner/*", ".casino.*", "/casino/*", "/porn/*", ".xxx/*", "/warez/*", "/wp-login.*", "/cgi-bin/*", "/phishing/*")
) + (Rule("allow", pattern="/robots.txt*"),)


class RuleIndex:
    """counts: how often URLs have a token; without them, how often rules have it."""

    def __init__(self, rules: tuple[Rule, ...], counts: Mapping[str, int] | None = None):
        self.rules = [(rule, re.compile(rule.expression()), len(rule.name)) for rule in rules]
        common = Counter(token for rule in rules for token in rule.tokens()) if counts is None else Counter(counts)
        self.filed: dict[str, list[int]] = {}
        self.untokened: list[int] = []
        for k, rule in enumerate(rules):
            rarest = min(rule.tokens(), key=lambda token: (common[token], -len(token), token), default=None)
            (self.untokened if rarest is None else self.filed.setdefault(rarest, [])).append(k)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, deciding host rule or None, verdict)."""
        host, path = split_url(url)
        low = (url or "").translate(ASCII_LOWER)
        joined = f"{host} {path}"
        fetched = {k for token in set(TOKEN.findall(low)) for k in self.filed.get(token, ())}
        best, allowed, blocked = None, False, False
        for k in sorted(fetched) + self.untokened:
            rule, expression, length = self.rules[k]
            if expression.match(joined if rule.host is not None else low) is None:
                continue
            if rule.host is None:
                allowed |= rule.action == "allow"
                blocked |= rule.action == "block"
            elif best is None or (length, rule.action) > (best[0], best[1].action):
                best = (length, rule)
        if best is not None:
            return host, path, best[1].name, best[1].action
        return host, path, None, "block" if blocked and not allowed else "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased): from the first :// to the next of / ? # or the end; path: from there to ? # or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(ASCII_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def token_counts(pages: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URL tokens equal each token of the rules."""
    wanted = sorted({token for rule in rules for token in rule.tokens()})
    tokens = pages.select(F.explode(F.split(F.lower(F.col(url_col).cast("string")), "[^0-9a-z]+")).alias("token"))
    counted = tokens.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {row["token"]: row["n"] for row in counted.collect()}


def judge_column(url: str | Column, rules: tuple[Rule, ...], counts: Mapping[str, int] | None = None) -> Column:
    """struct(host, path, rule, verdict). Rules are broadcast, and indexed and compiled once by each worker that needs them."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast((rules, None if counts is None else dict(counts)))
    made: list[RuleIndex] = []

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judge(urls: pa.Array) -> pa.Array:
        if not made:
            made.append(RuleIndex(*sent.value))
        rows = [made[0].judge(url) for url in urls.to_pylist()]
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict"])

    return judge(F.col(url).cast("string") if isinstance(url, str) else url)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    counts = token_counts(pages, url_col, rules)
    judged = pages.select(F.col(id_col), judge_column(url_col, rules, counts).alias("__j"))
    return judged.select(id_col, "__j.host", "__j.path", "__j.rule", "__j.verdict")
