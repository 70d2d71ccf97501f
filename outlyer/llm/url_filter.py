"""URL filter: a broadcast trie over reversed host labels and then path segments.

A rule is ``(action, host, path)``. It fits its host and every subdomain when the url's path
starts with the rule's path. Of the rules that fit, the one with most host labels wins, then the
one with the longest path; of equal rules ``block`` goes before ``allow``. Where none fits, the
default verdict holds.

The rule list is a configuration of bounded size (``MOST_RULES``); a longer one is refused rather
than broadcast. Null urls, and urls without ``://``, have an empty host and path. Labels are
compared as they stand, so a port or a user name is a part of its label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nested dicts: labels from the right, then whole path segments, then the rest of a segment."""

    HOSTS, PATHS, RULES = 0, 1, 2

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = self._node()
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[self.HOSTS].setdefault(label, self._node())
            *segments, rest = path.split("/")
            for segment in segments:
                node = node[self.PATHS].setdefault(segment, self._node())
            old = node[self.RULES].get(rest)
            if old is None or old[0] == "allow":
                node[self.RULES][rest] = (action, host + path)

    @staticmethod
    def _node() -> tuple[dict, dict, dict]:
        return {}, {}, {}

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Action and text of the longest rule that fits."""
        node, hosts = self.root, [self.root]
        for label in reversed(host.split(".")) if host else ():
            node = node[self.HOSTS].get(label)
            if node is None:
                break
            hosts.append(node)
        return next((found for node in reversed(hosts) if (found := self._under(node, path))), None)

    def _under(self, node, path: str) -> tuple[str, str] | None:
        best, rest = None, path
        while node is not None:
            fits = [r for r in node[self.RULES] if rest.startswith(r)] if node[self.RULES] else []
            if fits:
                best = node[self.RULES][max(fits, key=len)]
            segment, slash, rest = rest.partition("/")
            node = node[self.PATHS].get(segment) if slash else None
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of those names are replaced)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are not broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]}, dtype=object)

    url = F.col(url_col)
    clean = pages.withColumn("__host", host_of(url)).withColumn("__path", path_of(url)).withColumn("__found", look_up("__host", "__path"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return clean.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), "__found.rule", "__found.verdict")
