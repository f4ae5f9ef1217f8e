"""URL allow and block rules: a trie over reversed host labels and path segments.

The rules are compiled once on the driver, checked against ``max_rules``, and
broadcast; the longest fitting rule decides.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; urls that fit none get the default verdict. A rule that is
given both ways blocks. Repeated rows are judged alike; an empty table gives an
empty result; columns of the input other than the id and the url are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    # Rules that end here: the begun last path segment, and the rule.
    ends: list[tuple[str, Rule]] = field(default_factory=list)

    def child(self, label: str) -> Node:
        return self.children.setdefault(label, Node())


def compile_rules(rules: Iterable[Rule], max_rules: int = MAX_RULES) -> Node:
    """The trie. Host labels come first, last label first; then ``/segment`` edges."""
    root = Node()
    for n, rule in enumerate(rules):
        if n >= max_rules:
            raise ValueError(f"more than {max_rules} rules do not fit a broadcast")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.child(label)
        *whole, begun = rule.path.split("/")
        for segment in whole:
            node = node.child("/" + segment)
        node.ends.append((begun, rule))
        node.ends.sort(key=lambda e: (-len(e[0]), e[1].verdict != "block"))
    return root


def _best_on_path(node: Node, segments: list[str]) -> Rule | None:
    best = None
    for segment in segments:
        for begun, rule in node.ends:
            if segment.startswith(begun):
                best = rule
                break
        node = node.children.get("/" + segment)
        if node is None:
            return best
    return best


def match(root: Node, host: str, path: str) -> Rule | None:
    """The longest rule: most host labels first, then the longest path."""
    best, segments, node = None, path.split("/"), root
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        best = _best_on_path(node, segments) or best
    return best


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    return F.when(at > 0, F.substr(whole, at + 3)).otherwise("")


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """A row per page: id, host, path, the rule that decided (or null), and the verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(compile_rules(rules, max_rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [match(trie.value, h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(
            {
                "rule": pd.Series([r and r.name for r in found], dtype=object),
                "verdict": pd.Series([r.verdict if r else default for r in found], dtype=object),
            }
        )

    parts = pages.select(
        F.col(id_col),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    judged = parts.withColumn("_j", decide("host", "path"))
    return judged.select(id_col, "host", "path", "_j.rule", "_j.verdict")
