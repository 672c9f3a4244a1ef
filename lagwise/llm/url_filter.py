"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over the URL. Its literal tokens, the runs of a-z and 0-9
that every match must hold as whole tokens, are given or taken from a host and path. Each
rule is filed under the token of it that the fewest URLs hold, counted over all URLs. The
tokens of a URL fetch the rules filed under them, and only those regular expressions run.

The rule list is a Python argument and so bounded; it is part of the plan as a constant,
which keeps every row in its place: no join, no shuffle, and hot hosts cost nothing. The
only aggregation counts tokens that occur in rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import whole

ALLOW, BLOCK = "allow", "block"
TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` appears in results; rules of a higher ``rank`` win, then longer names."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int = 0


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with ``path``.

    A token of the path counts as whole only if a separator follows it inside the rule.
    """
    pattern = rf"^[^:]*+(?::(?!//)[^:]*+)*+://(?:[^/?#]*\.)?(?i:{_quote(host)}){_quote(path)}"
    whole = re.findall(r"[a-z0-9]+(?=[^a-zA-Z0-9])", f"{host}/") + [
        t.lower() for t in re.findall(r"[a-zA-Z0-9]+(?=[^a-zA-Z0-9])", path)
    ]
    return Rule(host + path, pattern, tuple(whole), verdict, rank=1)


def word_rule(word: str, verdict: str = BLOCK) -> Rule:
    """A rule for URLs that hold ``word`` as a whole token of host or path."""
    return Rule(f"*{word}*", rf"(?i)(?:^|[^a-z0-9]){_quote(word)}(?:[^a-z0-9]|$)", (word.lower(),), verdict)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    lowered = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lowered, TOKEN), lambda t: t != ""))


def token_frequencies(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """Number of URLs that hold each token of the rules: as many rows as such tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = (
        pages.select(F.explode(tokens_of(F.col(url))).alias("token"))
        .where(F.col("token").isin(wanted))
        .groupBy("token")
        .count()
        .collect()
    )
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in seen}


def index_rules(rules: Sequence[Rule], frequency: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; ties go to the longer, then the smaller token."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name} has no literal token")
        rarest = min(r.tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))
        index.setdefault(rarest, []).append(r)
    return index


def _constant(index: dict[str, list[Rule]]) -> Column:
    entries = [
        F.struct(
            F.lit(token).alias("key"),
            F.array(
                *(
                    F.struct(
                        F.lit(r.rank).alias("rank"),
                        F.lit(len(r.name)).alias("size"),
                        F.lit(r.name).alias("name"),
                        F.lit(r.verdict).alias("verdict"),
                        F.lit(r.pattern).alias("pattern"),
                    )
                    for r in rules
                )
            ).alias("value"),
        )
        for token, rules in sorted(index.items())
    ]
    return F.map_from_entries(F.array(*entries))


def match_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with columns ``matched`` (name of the winning rule, else null) and ``verdict``.

    The winner has the highest rank, then the longest name, then the smaller name. A null
    or empty URL matches nothing and gets ``default``. Every row is kept where it is,
    repeated ones too; columns of the two names are replaced. Without rules or rows the
    columns are still there.
    """
    if not rules:
        return pages.withColumn("matched", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    index = _constant(index_rules(rules, token_frequencies(pages, rules, url)))
    # The struct keeps the pages' own columns apart from the working ones.
    rows, address = whole(pages), F.col(f"_row.`{url}`")
    fetched = F.flatten(
        F.transform(
            F.filter(tokens_of(address), lambda t: F.map_contains_key(index, t)),
            lambda t: F.element_at(index, t),
        )
    )
    fits = F.filter(fetched, lambda r: F.regexp_like(address, r["pattern"]))
    best = F.array_min(
        F.transform(fits, lambda r: F.struct((-r["rank"]).alias("rank"), (-r["size"]).alias("size"), r["name"], r["verdict"]))
    )
    kept = [F.col(f"_row.`{c}`") for c in pages.columns if c.lower() not in ("matched", "verdict")]
    return rows.withColumn("_best", best).select(
        *kept, F.col("_best.name").alias("matched"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


# Hosts and paths that the query's contract names.
SITE_RULES = [
    site_rule("org", "/", ALLOW),
    site_rule("example.org", "/es/", BLOCK),
    site_rule("example.org", "/en/1", BLOCK),
    site_rule("com", "/fr/", ALLOW),
    site_rule("com", "/de/", BLOCK),
]
# Tokens that mark advertising, tracking, gambling, adult or spam hosts and paths.
BAD_WORDS = [
    "ads", "adserver", "doubleclick", "banner", "popunder", "track", "tracker", "pixel", "beacon", "clickbait",
    "casino", "poker", "betting", "jackpot", "slots", "lottery", "porn", "xxx", "sex", "adult", "escort", "webcam",
    "viagra", "pharmacy", "pills", "payday", "loans", "spam", "malware", "phishing", "warez", "torrent", "crack",
    "keygen",
]
RULES = [*SITE_RULES, *(word_rule(w) for w in BAD_WORDS)]


def filter_pages(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) for every row of ``pages``.

    ``rule`` is the winning site rule; a page without one gets the verdict of the pattern
    rules, named in ``pattern_rule``, and is allowed if none fits.
    """
    found = match_urls(pages.select("page_id", "url"), rules)
    site = F.col("matched").isin([r.name for r in rules if r.rank > 0])
    return found.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(site, F.col("matched")).alias("rule"),
        "verdict",
        F.when(~site, F.col("matched")).alias("pattern_rule"),
    )
