"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule fits its host and all subdomains of it where the path starts with the rule's path. The longest fitting rule
(host and path together; on a tie the longer host) decides between allow and block; of two equal rules block wins.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; urls that fit no rule get
the default verdict; an empty rule list gives the default everywhere. Only the id and url columns are read.
The rule list is broadcast to tasks inside the function; it is a configured list, and is refused above MAX_RULES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import attach

#: Rules beyond this number do not belong into every task.
MAX_RULES = 2_000_000
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass
class Node:
    """below: by host label or full path segment; ends: (rest of the path, rule, verdict) of rules that end here."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    ends: list[tuple[str, str, str]] = field(default_factory=list)


def segments(path: str) -> list[str]:
    """Path segments, each with its closing slash; what follows the last slash is the last one."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + [parts[-1]]


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        best: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
            if best.get((host, path)) != "block":
                best[host, path] = verdict
        if len(best) > MAX_RULES:
            raise ValueError(f"{len(best)} rules; at most {MAX_RULES} are sent to every task")
        self.root = Node()
        for (host, path), verdict in best.items():
            node = self.root
            for label in reversed(host.lower().split(".")) if host else ():
                node = node.below.setdefault(label, Node())
            node.paths = node = node.paths or Node()
            *full, rest = segments(path)
            for s in full:
                node = node.below.setdefault(s, Node())
            node.ends.append((rest, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        found: tuple[int, int, str, str] | None = None
        segs = segments(path)
        node: Node | None = self.root
        labels = host.split(".") if host else []
        for depth in range(len(labels) + 1):
            at, i = node.paths, 0
            while at is not None:
                for rest, rule, verdict in at.ends:
                    if i < len(segs) and segs[i].startswith(rest) or rest == "":
                        rank = (len(rule), depth, rule, verdict)
                        if found is None or rank[:2] > found[:2]:
                            found = rank
                at, i = (at.below.get(segs[i]) if i < len(segs) else None), i + 1
            if depth == len(labels):
                break
            node = node.below.get(labels[-1 - depth])
            if node is None:
                break
        return found and found[2:]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the deciding rule (or null) and the verdict."""
    attach(pages.sparkSession)
    trie = UrlTrie(rules)
    after = F.regexp_extract(url_col, r"^(?s:.*?)://(?s:(.*))$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [trie.match(h, p) or (None, default) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            rule, verdict = pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    kind = parts.schema["id"].dataType.simpleString()
    return parts.mapInArrow(look_up, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
