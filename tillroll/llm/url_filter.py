"""URL allow and block lists: a broadcast trie over reversed host labels, then path segments.

A rule ``host/path`` fits its host and every subdomain if the URL's path starts with the
rule's path.  Of the rules that fit, the longest decides: more host labels first, then the
longer path.  Where no rule fits, the default verdict stands.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; the path is what follows up to ``?``, ``#`` or the end.  A null URL or
one without ``://`` has an empty host and path, fits no rule and gets the default verdict.  Very
long URLs are read whole.  Repeated rows are judged alike, and null ids are rows like others.
Ties: of two rules with one host and path, block wins.  An empty table gives an empty result, and
without rules every URL gets the default verdict.  Extra columns are kept, whatever their names;
those named host, path, rule and verdict are replaced.

Rules are a list, or a DataFrame (verdict, host, path) of any size.  While their characters, and
so the trie, are within a bound, the trie is broadcast; beyond it both sides are joined, on hashed
pairs of a host suffix and a path's beginning, with the rules' side unique in every join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.llm._common import UPPER, by_position, position

#: Rules up to this many characters, their number counted eight times, are broadcast as a trie: nodes take some
#: hundred bytes a label or segment, so a worker holds a few dozen MB at most.  More are joined.
MAX_TRIE_CHARS = 1_000_000
RULES = "verdict string, host string, path string"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """From ``host/path``; without a slash the rule fits every path of its host."""
        host, slash, rest = text.partition("/")
        return cls(verdict, host.lower(), slash + rest)


class Trie:
    """Nodes are dicts keyed by a host label; a node's ``None`` entry holds its path rules.

    Path rules form a second trie over whole segments.  A rule's last segment may be cut short
    (``/en/1`` fits ``/en/10``), so a path node keeps rule ends as ``(partial segment, rule)``.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            path = node.setdefault(None, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                path = path.setdefault(segment, {})
            # Of two rules with the same host and path, block wins.
            ends = path.setdefault(None, {})
            if last not in ends or rule.verdict == "block":
                ends[last] = rule

    @staticmethod
    def _longest_path(node: dict, path: str) -> Rule | None:
        best = None
        segments = path.split("/")
        for k, segment in enumerate(segments):
            ends = node.get(None)
            if ends:
                fit = max((e for e in ends if segment.startswith(e)), key=len, default=None)
                if fit is not None:
                    best = ends[fit]
            node = node.get(segment) if k + 1 < len(segments) else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._longest_path(node[None], path) or best
        return best


_SPLIT = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; columns of these names are replaced."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _weight(rules: list[Rule] | DataFrame) -> int:
    """Characters of all rules and eight more for each."""
    if isinstance(rules, DataFrame):
        return rules.select(F.coalesce(F.sum(F.length("host") + F.length("path") + 8), F.lit(0))).first()[0]
    return sum(len(r.host) + len(r.path) + 8 for r in rules)


def _split(df: DataFrame, url_col: str) -> tuple[DataFrame, list[str], list[str]]:
    """df by position with host and path, the columns that stay, and their names."""
    stay = [k for k, c in enumerate(df.columns) if c.lower() not in ("host", "path", "rule", "verdict")]
    docs = split_url(by_position(df), position(df, url_col))
    return docs, [f"_k{k}" for k in stay], [df.columns[k] for k in stay]


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url", default: str = "allow", max_trie_chars: int = MAX_TRIE_CHARS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    if _weight(rules) > max_trie_chars:
        return judge_urls_joined(df, rules, url_col, default)
    listed = [Rule(*r) for r in rules.select("verdict", "host", "path").collect()] if isinstance(rules, DataFrame) else rules  # bounded above
    trie = df.sparkSession.sparkContext.broadcast(Trie(listed))

    @F.pandas_udf(_SPLIT)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        look = trie.value.find
        for hosts, paths in batches:
            found = [look(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r and r.host + r.path for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    docs, held, names = _split(df, url_col)
    return docs.withColumn("_found", find("host", "path")).select(*held, "host", "path", "_found.rule", "_found.verdict").toDF(*names, "host", "path", "rule", "verdict")


def _rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], RULES)
    return table.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))


def judge_urls_joined(df: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same for rules too many to broadcast.

    Distinct pairs of host and path are looked up once, so copies of one URL cost nothing.  Each
    emits its host's suffixes, which meet the lengths of that host's rule paths, one row a host;
    then the path's beginnings of these lengths, which meet the rules, one row a host and path.
    """
    table = _rule_table(df.sparkSession, rules)
    lengths = table.groupBy("r_host").agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"))
    parts, held, names = _split(df, url_col)
    hosts = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    near = hosts.withColumn("r_host", suffix).join(lengths, "r_host")
    tried = near.select("host", "path", "r_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("r_path", F.expr("substring(path, 1, n)"))
    fits = tried.join(table, ["r_host", "r_path"])
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v")), F.struct(F.length("r_host"), "n"))
    found = fits.groupBy("host", "path").agg(best.alias("_found"))
    out = parts.join(found, ["host", "path"], "left").select(*held, "host", "path", "_found.rule", F.coalesce("_found.v", F.lit(default)).alias("verdict"))
    return out.toDF(*names, "host", "path", "rule", "verdict")
