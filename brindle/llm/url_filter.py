"""URL filters as a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix) of one rule.
Rule = tuple[str, str, str]
#: Rules that one sweep holds; more rules mean more sweeps over the same pages, never fewer matches.
RULES_PER_SWEEP = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_rule(text: str, verdict: str) -> Rule:
    """``example.net/en/`` as (verdict, ``example.net``, ``/en/``)."""
    host, slash, path = text.partition("/")
    return verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def host_key(host: str) -> str:
    """Labels in reverse, each ended by a dot: a host's subdomains are exactly the keys that its key begins."""
    return ".".join(reversed(host.split("."))) + "."


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and sort key of a url; host and path are empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    return F.translate(host, _UPPER, _LOWER), path, F.translate(key, _UPPER, _LOWER)


class Sweep:
    """Rules as intervals of host keys in ascending order, and the stack of those that hold at the current key."""

    def __init__(self, rules: Sequence[Rule]):
        by_key: dict[str, dict[str, Rule]] = {}
        for rule in sorted(rules):  # of rules with the same host and path the last by verdict holds
            by_key.setdefault(host_key(rule[1]), {})[rule[2]] = rule
        self.levels = [(key, paths, sorted({len(p) for p in paths}, reverse=True)) for key, paths in sorted(by_key.items())]
        self.at, self.stack = 0, []

    def move(self, key: str) -> None:
        """Advances to ``key``, which is not below any earlier one."""
        while self.at < len(self.levels) and self.levels[self.at][0] <= key:
            level = self.levels[self.at]
            while self.stack and not level[0].startswith(self.stack[-1][0]):
                self.stack.pop()
            self.stack.append(level)
            self.at += 1
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def best(self, path: str) -> Rule | None:
        """The longest rule, by host and path together, of the stack that fits ``path``."""
        found: list[Rule] = []
        for _, paths, lengths in self.stack:
            rule = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
            if rule:
                found.append(rule)
        return max(found, key=lambda r: (len(r[1]) + len(r[2]), r[1]), default=None)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, the longest fitting rule (else null) and its verdict (else ``default``).

    Pages are dealt by range of (key, path, id), so a host with any share of the pages lies in many partitions,
    sorted, and swept once for each ``RULES_PER_SWEEP`` rules. A rule fits its host and all subdomains where the
    path starts with the rule's. Null urls have empty host and path; repeated rows are judged each; without
    rules every page gets ``default``; only the two named columns are read.
    """
    sweeps = [list(rules[i : i + RULES_PER_SWEEP]) for i in range(0, len(rules), RULES_PER_SWEEP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = [Sweep(x) for x in sweeps]
        last = None
        for batch in batches:
            names, verdicts = [], []
            for key, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != last:
                    for s in active:
                        s.move(key)
                    last = key
                found = [r for s in active if (r := s.best(path))]
                rule = max(found, key=lambda r: (len(r[1]) + len(r[2]), r[1]), default=None)
                names.append(rule and rule[1] + rule[2])
                verdicts.append(rule[0] if rule else default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path, key = url_parts(pages[url_col].cast("string"))
    keyed = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"), key.alias("key"))
    dealt = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path")
    return dealt.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [parse_rule("net/", "block"), parse_rule("example.net/en/", "allow"), parse_rule("example.com/de/", "block"), parse_rule("org/fr/", "allow")]

ORACLE = f"""
WITH r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
judged AS (
  SELECT page_id, host, path, max(lpad(CAST(length(h || p) AS VARCHAR), 5, '0') || ' ' || h || p) AS best
  FROM parts LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path)
SELECT j.page_id, j.host, j.path, r.h || r.p AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM judged j LEFT JOIN r ON j.best = lpad(CAST(length(r.h || r.p) AS VARCHAR), 5, '0') || ' ' || r.h || r.p
"""
