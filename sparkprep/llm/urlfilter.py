"""URL filters: pattern rules indexed by their rarest literal token.

A rule is found through one token of its literal text, the one that the fewest URLs hold. A URL's own tokens
fetch the rules to try, and only those run their regular expressions. URLs are judged in one narrow pass.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules that go to the tasks at once; longer lists take further narrow passes.
RULES_PER_PASS = 100_000


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched anywhere in what `on` names: "place" (host and path) or "url" (the whole URL, lower case).

    `literal` is text that every URL which fits must hold; tokens are cut from it, so that its first and last token must
    be bounded by the pattern. Among rules that fit, the highest `rank` wins, then the smaller name.
    """

    name: str
    verdict: str
    pattern: str
    literal: str
    rank: int = 0
    on: str = "place"


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's path; the longest wins."""
    host, slash, path = text.partition("/")
    # The last token of a path may continue in the URL, so only whole tokens before it may index the rule.
    literal = host.lower() + "/" + (path if not path or path.endswith("/") else re.sub(r"[A-Za-z0-9]+$", "", path)).lower()
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower() + slash + path)}", literal, 1000 + len(text))


#: The explicit rules, then patterns for everything they leave open.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
PATTERNS = [
    Rule("*ads-track*", "block", r"(?:^|[^a-z0-9])ads-track(?:[^a-z0-9]|$)", "ads-track", on="url"),
    Rule("*doubleclick*", "block", r"(?:^|[^a-z0-9])doubleclick(?:[^a-z0-9]|$)", "doubleclick", on="url"),
    Rule("*/login*", "block", r"/login(?:[^a-z0-9]|$)", "/login", on="url"),
    Rule("*/wp-admin/*", "block", r"/wp-admin/", "/wp-admin/", on="url"),
    Rule("*sessionid=*", "block", r"[?&]sessionid=", "sessionid", on="url"),
]
DEFAULT_RULES = [host_rule(text, verdict) for text, verdict in HOST_RULES] + PATTERNS


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.partition("://")[2], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), slash + path


def token_counts(df: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows; at most one number per wanted token."""
    found = F.array_intersect(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([a-z0-9]+)"), F.lit(1)), F.array(*map(F.lit, wanted)))
    rows = df.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """token -> rules; a rule without a token is under "" and is tried on every URL."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        tokens = TOKEN.findall(rule.literal)
        index[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else ""].append(rule)
    return dict(index)


def best_rule(url: str | None, index: dict[str, list[Rule]], compiled: dict[str, re.Pattern]) -> Rule | None:
    if url is None:
        return None
    host, path = split_url(url)
    low = url.lower()
    best = None
    for token in {"", *TOKEN.findall(low)}:
        for rule in index.get(token, ()):
            if (best is None or (-rule.rank, rule.name) < (-best.rank, best.name)) and compiled[rule.pattern].search(
                host + path if rule.on == "place" else low
            ):
                best = rule
    return best


def judge_urls(df: DataFrame, url: str = "url", keep: list[str] | None = None, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """The columns `keep` (default: all others than the five new ones) with host, path, rule, pattern and verdict.

    `rule` is the explicit host/path rule that fits best, else NULL; `pattern` the open pattern that fits where there is
    no such rule; `verdict` comes from the one that counts, else `default`. A NULL or malformed URL has empty host and
    path; patterns on the whole URL still see a malformed one. Rows are neither dropped nor merged. Input columns named
    like a new one are replaced.
    """
    rules = DEFAULT_RULES if rules is None else rules
    new = ["host", "path", "rule", "pattern", "verdict"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    wanted = sorted({t for r in rules for t in TOKEN.findall(r.literal)})
    counts: dict[str, int] = {}
    for i in range(0, len(wanted), 5000):
        counts |= token_counts(df, url, wanted[i:i + 5000])
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.col(url).alias("__url"))
    state = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "__url string, host string, path string, rule string, pattern string, verdict string, __rank long"])
    for i in range(0, max(len(rules), 1), RULES_PER_PASS):
        part = index_rules(rules[i:i + RULES_PER_PASS], counts)

        def judge(frames: Iterator[pd.DataFrame], part=part, first=i == 0) -> Iterator[pd.DataFrame]:
            compiled = {r.pattern: re.compile(r.pattern, re.S) for rs in part.values() for r in rs}
            for pdf in frames:
                if first:
                    places = [split_url(u) for u in pdf["__url"]]
                    pdf = pdf.assign(host=[h for h, _ in places], path=[p for _, p in places], rule=None, pattern=None, verdict=default, __rank=-1)
                rows = []
                for u, rank, rule, pattern, verdict in zip(pdf["__url"], pdf["__rank"], pdf["rule"], pdf["pattern"], pdf["verdict"]):
                    hit = best_rule(u, part, compiled)
                    if hit is not None and hit.rank > rank:
                        rank, verdict = hit.rank, hit.verdict
                        rule, pattern = (hit.name, None) if hit.on == "place" else (None, hit.name)
                    rows.append((rank, rule, pattern, verdict))
                for k, name in enumerate(("__rank", "rule", "pattern", "verdict")):
                    pdf[name] = [r[k] for r in rows]
                yield pdf

        out = out.mapInPandas(judge, state)
    return out.drop("__url", "__rank")
