"""Pattern rules for URLs, indexed by their rarest literal token.

A rule is a pattern over the URL's host and what follows it, without scheme: ``||`` at its start stands for the
host's start or a dot in the host, ``|`` for the start or the end, ``*`` for any characters, ``^`` for one
character other than letters, digits and ``_ - . %``, or the end; the rest is literal. The tokens of a
pattern are the runs of letters and digits that any matching URL must hold as a whole. Every rule is
filed under the one of its tokens that the fewest URLs hold; a URL's own tokens fetch the rules filed
under them, and only these run their regular expressions. Rules without a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile("[A-Za-z0-9]+")
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"
#: Rules that one column function holds; a longer list is judged by several, whose strongest finds are compared.
BLOCK_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` and ``verdict``; ``name``: set for a host rule, which outweighs those without and is case-sensitive."""

    pattern: str
    verdict: str
    name: str | None = None

    def strength(self) -> tuple:
        """Of several rules that match, the greatest decides: host rules, then the longest, allow before
        block, then the last by text."""
        text = self.name or self.pattern
        return self.name is not None, len(text), self.verdict == "allow", text


def host_rule(verdict: str, name: str) -> Rule:
    """``name`` (a host and the start of a path, as ``example.com/en/``) for the host and its subdomains."""
    return Rule(f"||{name}", verdict, name)


#: The method's own rules, where no host rule fits: adult and gambling sites, advertising and counting
#: hosts, pages of forms instead of text.
PATTERNS = [
    *[Rule(p, "block") for p in ("||adult-", "||adult.", "||casino-", "||casino.", "/casino/", "||ads.", "||adserver.", "||track.", "||tracker.", "/wp-login.php", "/wp-admin/", "/login^", "/signin^", "/cart^", "/checkout^")],
    Rule("/robots.txt|", "allow"),
]


def compiled(pattern: str) -> tuple[str, list[str]]:
    """The regular expression of ``pattern`` and its tokens, lower-cased."""
    regex, body, bounded = "", pattern, False
    if body.startswith("||"):
        regex, body, bounded = r"\A(?:[^/?#]*\.)?", body[2:], True
    elif body.startswith("|"):
        regex, body, bounded = r"\A", body[1:], True
    ends = body.endswith("|")
    parts = re.split(r"([*^])", body[:-1] if ends else body)
    tokens = []
    for i, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += SEPARATOR
        elif part:
            before = bounded if i == 0 else parts[i - 1] == "^"
            after = ends if i == len(parts) - 1 else parts[i + 1] == "^"
            for m in TOKEN.finditer(part):
                if (m.start() or before) and (m.end() < len(part) or after):
                    tokens.append(m[0].lower())
            regex += re.escape(part)
    return regex + (r"\Z" if ends else ""), tokens


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, the host and all that follows it); empty for a null URL or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    name = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(name) + 1, F.length(rest))
    host = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(tail, r"\A[^?#]*", 0), F.concat(host, tail)


def token_counts(addresses: DataFrame, column: str, tokens: set[str]) -> dict[str, int]:
    """How many rows hold each of ``tokens``, by one aggregate over all rows; what returns is bounded by the rules."""
    if not tokens:
        return {}
    known = addresses.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    held = addresses.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    counted = held.join(common.bounded_broadcast(known, len(tokens)), "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


FOUND = "struct<strength:int,rule:string,verdict:string,pattern:string>"


def _finder(rules: list[tuple[int, Rule]], counts: dict[str, int]) -> Callable[[Column], Column]:
    """A column function: the strongest of ``rules`` (strength, rule) that matches, or null."""
    index: dict[str | None, list[tuple[int, str, int, tuple]]] = {}
    for strength, rule in sorted(rules, reverse=True, key=lambda r: r[0]):
        regex, tokens = compiled(rule.pattern)
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        flags = re.DOTALL | re.ASCII | (0 if rule.name else re.IGNORECASE)
        index.setdefault(rarest, []).append((strength, regex, flags, (strength, rule.name, rule.verdict, rule.pattern)))

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready: dict[int, re.Pattern] = {}
        none = (None, None, None, None)
        for batch in batches:
            out = []
            for address in batch:
                best, row = -1, none
                for token in (None, *{t.lower() for t in TOKEN.findall(address)}):
                    for strength, regex, flags, told in index.get(token, ()):  # strongest first
                        if strength <= best:
                            break
                        if strength not in ready:
                            ready[strength] = re.compile(regex, flags)
                        if ready[strength].search(address):
                            best, row = strength, told
                            break
                out.append(row)
            yield pd.DataFrame(out, columns=["strength", "rule", "verdict", "pattern"]).astype({"strength": "Int32"})

    return find


def judge(urls: DataFrame, rules: list[Rule], url_column: str = "url", otherwise: str = "allow") -> DataFrame:
    """``urls`` with url_host, url_path, url_rule (the deciding host rule's name), url_verdict and url_pattern.

    ``rules`` are a configuration's, so each task holds them; only the address goes to Python. Where
    none matches the verdict is ``otherwise``.

    Cases: a null or empty URL, or one without ``://``, has empty host and path and matches only rules that
    match nothing at all; very long URLs are read whole; each row is judged by itself, repeated ones alike; of
    rules that match, ``Rule.strength`` tells the one that decides; an empty table stays empty; other
    columns stay, of those named like the results the results remain.
    """
    ordered = sorted(set(rules), key=Rule.strength)
    host, path, address = parts(F.col(url_column))
    told = urls.withColumns({"url_host": host, "url_path": path, "__address": address})
    counts = token_counts(told, "__address", {t for r in ordered for t in compiled(r.pattern)[1]})
    numbered = list(enumerate(ordered))
    found = [_finder(numbered[i : i + BLOCK_RULES], counts)(F.col("__address")) for i in range(0, len(numbered), BLOCK_RULES)]
    best = found[0] if len(found) == 1 else F.greatest(*found) if found else F.lit(None).cast(FOUND)
    told = told.withColumn("__found", best)
    told = told.withColumns({"url_rule": F.col("__found.rule"), "url_verdict": F.coalesce("__found.verdict", F.lit(otherwise)), "url_pattern": F.col("__found.pattern")})
    return told.drop("__found", "__address")
