"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with a verdict and a rank. Its literal tokens (runs of a-z and 0-9 that every match
must contain as whole tokens) come with it; the index files it under the one that is rarest in the URLs at hand, or
under the empty token if it has none. The tokens of a URL fetch candidate rules, only those run their expression, and
of the rules that match the one of highest rank wins.

The rule list is the caller's, or a table of host rules, and is limited to MAX_RULES, which bounds what executors get.
URLs are judged whole, whatever their length. A null URL, or one without
"://", has an empty host and path and matches no host rule. Repeated rows each get their verdict. Empty tables give
empty results; other columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, lean

MAX_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """name is what a result shows; rank orders matching rules, higher first."""

    name: str | None
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`; longer rules rank higher."""
    whole = tuple(_TOKEN.findall(host)) + tuple(_TOKEN.findall(path.lower())[: -1 if path[-1:].isalnum() else None])
    pattern = r"^(?:[^#]*\.)?" + re.escape(host) + "#" + re.escape(path)
    return Rule(f"{host}{path}", pattern, verdict, whole, 1000 + len(host) + len(path))


def word_rule(word: str) -> Rule:
    """Blocks hosts that have the word as a token; ranks below every host rule."""
    return Rule(None, rf"^(?:[^#]*[^a-z0-9#])?{re.escape(word)}(?:[^a-z0-9#][^#]*)?#", "block", (word,), 0)


#: The contract's rules, then words of host names that carry spam.
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SPAM_WORDS = ("ads", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx")
RULES = tuple(host_rule(*x) for x in HOST_RULES) + tuple(word_rule(x) for x in SPAM_WORDS)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat_ws(" ", host, path)), F.lit("([a-z0-9]+)"), 1))


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules under their rarest token by the counts in URLs; of equally rare ones, under that of fewest rules."""
    index: dict[str, list[Rule]] = {}
    shared = Counter(t for rule in rules for t in set(rule.tokens))
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), shared[t], t)) if rule.tokens else ""
        index.setdefault(token, []).append(rule)
    return index


def rules_of(table: DataFrame) -> list[Rule]:
    """Host rules from a table (host, path, verdict), in a fixed order; null hosts are left out and null paths are "/"."""
    rows = table.where(F.col("host").isNotNull()).select("host", F.coalesce("path", F.lit("/")).alias("path"), "verdict").distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [host_rule(*r) for r in sorted(rows)]


def judge(index: dict[str, list[Rule]], compiled: dict[str, re.Pattern], host: str, path: str) -> Rule | None:
    """The rule of highest rank among those that the URL's tokens fetch and whose expressions match."""
    subject, best = f"{host}#{path}", None  # neither holds a #
    for token in {*_TOKEN.findall(subject.lower()), ""}:
        for rule in index.get(token, ()):
            if rule.pattern not in compiled:
                compiled[rule.pattern] = re.compile(rule.pattern)
            key = (rule.rank, rule.name or "", rule.pattern)
            if (best is None or key > (best.rank, best.name or "", best.pattern)) and compiled[rule.pattern].search(subject):
                best = rule
    return best


def filter_urls(df: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """df with host, path, rule (name of the rule that decided, or null) and verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to executors")
    url = F.col("__url")
    named = df.withColumn("__url", F.col(url_col)).drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    named = named.withColumn("host", host_of(url)).withColumn("path", path_of(url)).drop("__url")
    literal = sorted({t for rule in rules for t in rule.tokens})
    wanted = df.sparkSession.createDataFrame([(t,) for t in literal], "t string")
    seen = named.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("t")).join(F.broadcast(wanted), "t", "left_semi")  # MAX_RULES bounds them
    counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row for each rule token at most
    index = df.sparkSession.sparkContext.broadcast(build_index(rules, counts))

    def run(batches):
        compiled: dict[str, re.Pattern] = {}
        held = index.value

        for batch in batches:
            names = batch.schema.names
            hosts, paths = (batch.column(names.index(c)).to_pylist() for c in ("host", "path"))
            shown, verdicts = [], []
            for host, path in zip(hosts, paths, strict=True):
                best = judge(held, compiled, host, path)
                shown.append(best and best.name)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string()), pa.array(verdicts, pa.string())], [*names, "rule", "verdict"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in named.schema] + [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return named.mapInArrow(lean(run), schema)
