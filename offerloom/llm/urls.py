"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it matches must contain.
Token frequencies are counted over all URLs; each rule is filed under its rarest token. A URL
fetches the rules filed under its own tokens, and only those run their expression; the longest
match wins. Rules without a whole literal token are candidates for every URL.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the
method's verdict; repeated rows are judged alike; an empty table gives an empty table; further
columns are carried along, but for those with the names of the results, which are replaced.
Bound: the rule list is held by every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ascii_lower

RESULTS = ("host", "path", "rule", "verdict", "tried")
TOKEN = "[A-Za-z0-9]+"
HOST_AND_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched at the start of host + path; ``tokens`` stand as whole tokens in whatever it matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()


def host_path_rule(verdict: str, rule: str) -> UrlRule:
    """``example.org/en/``: the host with all its subdomains, and every path that starts with the given one."""
    pattern = r"(?:[^/?#]*\.)?" + re.escape(rule)
    whole = [m.group() for m in re.finditer(TOKEN, rule) if m.end() < len(rule)]
    return UrlRule(rule, verdict, pattern, tuple(dict.fromkeys(whole)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_AND_PATH, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_AND_PATH, 2)


def token_counts(urls: DataFrame, rules: Sequence[UrlRule], host: str = "host", path: str = "path") -> dict[str, int]:
    """In how many URLs each token of the rules stands; at most as many rows as the rules have tokens."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(f"({TOKEN})")))
    counted = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def rarest_token_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str | None, list[UrlRule]]:
    index: dict[str | None, list[UrlRule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t)) if rule.tokens else None
        index.setdefault(token, []).append(rule)
    return index


def judge_urls(
    urls: DataFrame, rules: Sequence[UrlRule], url: str = "url", otherwise: str = "allow",
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``tried``, the expressions that were run."""
    kept = [c for c in urls.columns if c not in RESULTS]
    parts = urls.select(*kept, host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"))
    index = rarest_token_index(rules, token_counts(parts, rules) if counts is None else counts)

    @F.pandas_udf("struct<rule:string,verdict:string,tried:int>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {token: [(re.compile(r.pattern), r) for r in filed] for token, filed in index.items()}
        always, tokens_in = compiled.pop(None, []), re.compile(TOKEN).findall
        for hosts, paths in batches:
            out = []
            for subject in hosts + paths:
                candidates = always + [c for token in set(tokens_in(subject)) for c in compiled.get(token, ())]
                fit = [r for pattern, r in candidates if pattern.match(subject)]
                best = max(fit, key=lambda r: (len(r.name), r.name)) if fit else None
                out.append((best.name if best else None, best.verdict if best else otherwise, len(candidates)))
            yield pd.DataFrame(out, columns=["rule", "verdict", "tried"])

    judged = parts.select(F.struct(*parts.columns).alias("row"), judge("host", "path").alias("said"))
    return judged.select("row.*", "said.*")
