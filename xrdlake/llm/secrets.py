"""Secrets in texts: three fixed patterns, and an assignment-aware lexer that follows constants to sensitive names."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import by_place, give_back, ids_back, ids_of, pick, place_of, renamed

#: Kinds in the order that breaks ties of a start; the last is the lexer's.
KINDS = ("assign", "access", "hex", "literal")

# The base patterns. Those of one class only may ask for their length at once: a run is taken whole.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: Words in target names and how sensitive they make a value.
NAMES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
         "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "cookie": 0.6, "pin": 0.6, "dsn": 0.6}
KEY_OF = {"api", "access", "private", "secret", "auth", "signing", "encryption", "master", "account", "shared", "ssh", "service"}
HARMLESS = {"true", "false", "none", "null", "nil", "undefined", "example", "changeme", "placeholder", "redacted", "required", "optional", "string", "default", "your-password", "password", "secret", "token"}
THRESHOLD = 0.55

_OPERATOR = re.compile(r"[:=]")
_VALUE = re.compile(r"""[ \t]*(?:(?:[fbru]{0,2})(?:"((?:\\.|[^"\\\n])*+)"|'((?:\\.|[^'\\\n])*+)'|`([^`\n]*+)`)|([A-Za-z_$][\w.$]*+)(?![\w(\["'])|([^\s"'`,;(){}\[\]]++))""", re.ASCII)
_PLUS = re.compile(r"[ \t]*\+(?!=)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")


def sensitive(name: str) -> float:
    """From 0 to 1, how sensitive the words of a target name are."""
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max((NAMES.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:], strict=False):
        if b in ("key", "keys") and a in KEY_OF:
            best = 1.0
    return best


def randomness(value: str) -> float:
    """From 0 to 1: bits per character against six, with length and character classes; prose-like values stay low."""
    if len(set(value)) < 3 or value.lower() in HARMLESS or value[0] in "<$%{" or "..." in value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if any(c.isspace() for c in value):
        kinds -= 2
    return max(0.0, min(1.0, bits / 6 + 0.15 * (kinds - 1) + min(n, 32) / 160))


def assignments(text: str):
    """``(name, literals, references)`` of every assignment: literals as ``(start, end, quoted)``, references as names."""
    for m in _OPERATOR.finditer(text):
        at = m.start()
        if text[at - 1:at] in ("=", "!", "<", ">", ":") or text[at + 1:at + 3] == "//" or text[at] == text[at + 1:at + 2]:
            continue  # a comparison, a scope, a web address, or the second sign of an operator
        end = at - (1 if text[at - 1:at] in ("+", "?") else 0)
        while end and text[end - 1] in " \t":
            end -= 1
        quote = text[end - 1:end]
        if quote and quote in "\"'`]":
            end -= 1 + (quote == "]" and text[end - 2:end - 1] in ("'", '"'))
        start = end
        while start and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:end].strip(".-$")
        if not name or not name[0].isalpha() and name[0] != "_":
            continue
        pos = at + 1
        if text[pos:pos + 1] in ("=", ">"):
            pos += 1
        literals, refs = [], []
        while True:
            v = _VALUE.match(text, pos)
            if not v:
                break
            group = v.lastindex
            if group == 4:
                refs.append((v[4], v.start(4), v.end(4)))
            else:
                literals.append((v.start(group), v.end(group), group < 4))
            more = _PLUS.match(text, v.end())
            if not more:
                break
            pos = more.end()
        if literals or refs:
            yield name, literals, refs


def lexed(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants, and look random enough for its name."""
    if "=" not in text and ":" not in text:
        return []
    own: dict[str, list] = {}
    found = []
    for name, literals, refs in assignments(text):
        found.append((name, literals, refs))
        for key in {name, name.rpartition(".")[2]}:
            own.setdefault(key, []).append((literals, refs))
    # the most sensitive names go first, so whatever is reached has its weight: each constant is followed once
    weight: dict[tuple[int, int, bool], float] = {}
    rated = {name: sensitive(name) for name, _, _ in found}
    seen: set[str] = set()
    for name, literals, refs in sorted((x for x in found if rated[x[0]]), key=lambda x: -rated[x[0]]):
        w, todo = rated[name], [(literals, refs)]
        while todo:
            literals, refs = todo.pop()
            for lit in literals:
                weight.setdefault(lit, w)
            for ref, a, b in refs:
                keys = [k for k in dict.fromkeys((ref, ref.rpartition(".")[2])) if k in own]
                for key in keys:
                    if key not in seen:
                        seen.add(key)
                        todo += own[key]
                if not keys:  # no constant of that name: a bare word of a configuration file
                    weight.setdefault((a, b, False), w)
    out = []
    for (a, b, quoted), w in weight.items():
        value = text[a:b].rstrip(".") if not quoted else text[a:b]
        if len(value) < LEAST_VALUE or not quoted and value.isalpha():
            continue
        if w * randomness(value) >= THRESHOLD:
            out.append((a, a + len(value)))
    return sorted(out)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` sorted, kinds as numbers of ``KINDS``, in code points."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    starts, far = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    inside = lambda a, b: (k := bisect_right(starts, a)) and far[k - 1] >= b
    return sorted(spans + [(a, 3, b) for a, b in lexed(text) if not inside(a, b)])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: kind, start and end (exclusive) in code points, by start and kind.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows; other columns are
    not read. Literals inside a base span are not reported again.
    """
    def look(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids_back(ids_of(part.column(0))), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(look, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def spelled(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def hidden(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every found span replaced; a null text stays null."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, without the secrets in ``text``; ``n_chars``, where there is one, follows.

    Null and empty texts and repeated rows stay as they are; columns of any name pass through; an empty table stays empty.
    """
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        give_back()
        parts = [pa.array([hidden(t) for t in texts.slice(at, 500).to_pylist()], pa.string()) for at in range(0, len(texts), 500)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    text, chars = (None if (i := place_of(docs, c)) is None else f"c{i}" for c in ("text", "n_chars"))
    out = by_place(docs).withColumn(text, clean(text))
    return renamed(out.withColumn(chars, F.length(text).cast("long")) if chars else out, docs)
