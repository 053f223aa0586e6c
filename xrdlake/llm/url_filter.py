"""Allow and block lists for URLs: a trie over reversed host labels and path segments, the longest entry wins.

The list is an argument of the program, not data: it is broadcast, and refused beyond ``MAX_ENTRIES``.
"""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import DataFrame

from xrdlake.llm.common import pick

MAX_ENTRIES = 1_000_000
NAMES = ("page_id", "url", "host", "path", "rule", "verdict")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclasses.dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production list.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    rest = rest[2]
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:stop].translate(LOWER), rest[stop:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host, path[:end]


def build(rules) -> dict:
    """Nested dicts: host labels from the right, then under ``"/"`` path segments; the last segment of a rule is a prefix.

    Of two rules for one place the later stands.
    """
    rules = list(rules)
    if len(rules) > MAX_ENTRIES:
        raise ValueError(f"{len(rules)} entries; at most {MAX_ENTRIES} are broadcast")
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.translate(LOWER).split(".")):
            node = node.setdefault(label, {})
        *whole, start = rule.path.split("/")
        node = node.setdefault("/", {})
        for segment in whole:
            node = node.setdefault(("is", segment), {})
        node.setdefault("starts", {})[start] = (rule.name, rule.verdict)
    return root


def longest_path(node: dict, path: str):
    best, parts = None, path.split("/")
    for part in parts:
        found = max((s for s in node.get("starts", ()) if part.startswith(s)), key=len, default=None)
        if found is not None:
            best = node["starts"][found]
        node = node.get(("is", part))
        if node is None:
            break
    return best


def match(trie: dict, host: str, path: str):
    """The entry with most host labels, then with most path; None where none fits."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if "/" in node:
            best = longest_path(node["/"], path) or best
    return best


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row.

    Null urls and urls without ``://`` have an empty host and path, which no entry fits; those get ``default``. A rule path is a
    plain prefix of the url's path, so ``/`` does not fit an empty path. Repeated rows give repeated results, an empty table
    none; other columns are not read.
    """
    rows = pick(pages, page_id="long", url="string")
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    def look(batches):
        for b in batches:
            found = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                found.append((host, path, *(match(trie.value, host, path) or (None, default))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in zip(*found, strict=True))], names=[*NAMES])

    return rows.mapInArrow(look, "page_id long, url string, host string, path string, rule string, verdict string")
