"""Secrets in text: fixed patterns, and assignment-aware lexing.

Patterns: assignments to a tell-tale name, access keys and long hexadecimal runs. The lexer reads source
and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``export NAME=x``, ``name := 'a' + "b"``,
``<name>x</name>``, ``login(user, "x")``) into pairs of a name and a literal. A name that is assigned another name, or called
with it, takes over that name's literals, so a constant is followed to a sensitive name that it ends in. Names are
told by their whole parts (``authToken``: auth, token; ``authors``: none). A literal's score is its target's
sensitivity times its own randomness; from the threshold on, its span is reported, or stands by the fixed pattern that covers it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import python_ready

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
#: A name, an assignment sign, and the rest of the line.
_PAIR = re.compile(rf"(?:(?P<q>[\"'])(?P<quoted>{_NAME})(?P=q)|(?<![A-Za-z0-9_.-])-*+(?P<plain>{_NAME}))(?:\x20*:\x20*(?:str|string|String)(?=\x20*=))?\x20*(?::=|=>|=(?!=)|:(?!/))\x20*(?P<value>{_LITERAL}|[^\s\"'`,;(){{}}\[\]<>]+)")
_JOIN = re.compile(rf"\x20*(?:\+|\.\.?)?\x20*(?P<value>{_LITERAL})|\x20*(?:\+|\.\.)\x20*(?P<name>{_NAME})")
_TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>")
_IDENTIFIER = re.compile(_NAME + r"\Z")
#: Credentials inside an address, and a block scalar: a name, a bar, and the more deeply indented lines below it.
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@\"'<>]*+:(?P<value>[^\s:/@\"'<>]{6,}+)@")
_BLOCK = re.compile(rf"^(?P<before>\x20*+(?:-\x20+)?)(?P<name>{_NAME})\x20*:\x20*[|>][+-]?\x20*\n", re.MULTILINE)
_LINE = re.compile(r"(?P<indent>\x20*+)(?P<value>[^\n]*)(?:\n|\Z)")

_CALL = re.compile(rf"(?<![A-Za-z0-9_.-])(?P<callee>{_NAME})\((?P<arguments>(?:{_LITERAL}|[^()\n\"'`])*+)\)")
_ARGUMENT = re.compile(rf"(?P<value>{_LITERAL})|(?P<name>{_NAME})(?!\x20*[=:(])")

#: Whole parts of sensitive names and how much they say. ``key`` alone: a literal of mixed classes passes, a plain word (randomness 0.6 at most) cannot.
SENSITIVITY = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pw": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "signature": 0.5, "salt": 0.6, "bearer": 0.9, "key": 0.6, "login": 0.6, "authenticate": 0.8,
}
#: Parts that make of ``key`` after them a secret beyond doubt.
KEY_OF = {"api": 1.0, "access": 1.0, "private": 1.0, "encryption": 1.0, "signing": 1.0, "client": 0.8, "auth": 0.9, "secret": 1.0}
#: Last parts of names that speak about a secret and hold none; a name so ended counts two fifths.
ABOUT = frozenset("count counts size length len type name id ids url uri path file hint policy limit max min format field column prefix suffix ttl expiry".split())
#: Literals that stand for a secret and are none.
PLACEHOLDERS = re.compile(r"(?i)\A(?:x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\$[A-Z_]+|todo)\Z")
THRESHOLD = 0.45
MIN_CHARS = 6
#: What is left of a score where a colon stands in running text, and of that of a literal of several plain words.
PROSE, WORDS = 0.5, 0.4


def doubt(text: str, begin: int, name: str, sign: str, value: str, end: int) -> float:
    """What is left of the score of an assignment that may be none: a sentence around a colon, or a quoted sentence."""
    if value[:1] in "\"'`":
        words = value[1:-1].split()
        return WORDS if len(words) > 1 and all(w.strip(".,;:!?").isalpha() for w in words) and "phrase" not in name.lower() else 1.0
    if ":" in sign and "=" not in sign and re.match(r"\x20+[A-Za-z]", text[end : end + 3]):
        line = max(begin - 200, text.rfind("\n", max(0, begin - 200), begin) + 1)  # so far a sentence is looked back at
        before = text[max(0, line) : begin]
        return PROSE if re.search("[A-Za-z]", before) else 1.0
    return 1.0


def sensitivity(name: str) -> float:
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[-.]", "_", name).lower().split("_")
    found = [SENSITIVITY.get(x, 0.0) for x in parts] + [KEY_OF.get(a, 0.0) for a, b in pairwise(parts) if b in ("key", "keys")]
    return max(found) * (0.4 if len(parts) > 1 and parts[-1] in ABOUT else 1.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy of the characters against 4 bits, with a bonus for several classes of them."""
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(x, literal)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (0.7 + 0.1 * classes) if classes > 1 else 0.6 * min(1.0, entropy / 4)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def lexed_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that reach a sensitive name, directly or through other names; of several names the one of the best score."""
    if "=" not in text and ":" not in text and "</" not in text and "(" not in text:
        return []
    literals: dict[str, list[tuple[int, int]]] = {}
    refers: dict[str, list[str]] = {}
    left: dict[tuple[int, int], float] = {}

    def take(name: str, value: str, start: int, end: int, share: float = 1.0) -> None:
        if value[:1] in "\"'`":
            start, end = start + 1, end - 1
        elif _IDENTIFIER.match(value):
            refers.setdefault(name, []).append(value)
        if end - start >= 1:
            literals.setdefault(name, []).append((start, end))
            left[start, end] = min(share, left.get((start, end), 1.0))

    for m in _PAIR.finditer(text):
        name = m["quoted"] or m["plain"]
        sign = text[m.end("quoted" if m["quoted"] else "plain") : m.start("value")]
        take(name, m["value"], *m.span("value"), doubt(text, m.start(), name, sign, m["value"], m.end()))
        at = m.end()
        while more := _JOIN.match(text, at):
            if more["value"]:
                take(name, more["value"], *more.span("value"))
            else:
                refers.setdefault(name, []).append(more["name"])
            at = more.end()
    if "://" in text:
        for m in _ADDRESS.finditer(text):
            take("address_password", m["value"], *m.span("value"))
    if "|" in text or ">" in text:
        for m in _BLOCK.finditer(text):
            at = m.end()
            while at < len(text) and (line := _LINE.match(text, at)):
                value = line["value"].rstrip()
                if value and len(line["indent"]) <= len(m["before"]):
                    break
                if value:
                    take(m["name"], value, line.start("value"), line.start("value") + len(value))
                at = line.end()
    if "</" in text:
        for m in _TAG.finditer(text):
            take(m["name"], m["value"], *m.span("value"))
    if "(" in text:
        for m in _CALL.finditer(text):
            if sensitivity(m["callee"]):
                for x in _ARGUMENT.finditer(text, *m.span("arguments")):
                    if x["value"]:
                        take(m["callee"], x["value"], *x.span("value"))
                    else:
                        refers.setdefault(m["callee"], []).append(x["name"])
    score: dict[str, float] = {}  # a name's sensitivity flows to the names it was assigned from
    todo = sorted((w, x) for x in {*literals, *refers} if (w := sensitivity(x)) > 0)
    while todo:  # the most sensitive first
        weight, name = todo.pop()
        if score.get(name, 0.0) >= weight:
            continue
        score[name] = weight
        todo += [(weight, x) for x in dict.fromkeys(refers.get(name, ())) if x in literals or x in refers]
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for name, weight in score.items():
        for start, end in literals.get(name, ()):
            value = text[start:end]
            if end - start >= MIN_CHARS and value not in literals and value not in refers and not PLACEHOLDERS.match(value):
                got = weight * randomness(value) * left[start, end]
                if got >= THRESHOLD and got > found.get((start, end), (0.0, ""))[0]:
                    found[start, end] = got, name
    return [(*span, name, got) for span, (got, name) in sorted(found.items())]


def spans(text: str | None) -> list[tuple[int, int, str, str | None, float | None]]:
    """All spans (start, end, kind, name, score) by start, kind as listed, end; code points, end exclusive.

    A lexed literal that a fixed pattern covers gives that span its name and score and is no span of its own.
    """
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda x: (x[0], KINDS.index(x[2])))
    starts, reach = [x[0] for x in base], []
    for x in base:
        reach.append(max(x[1], reach[-1] if reach else 0))
    said: dict[int, tuple[str, float]] = {}
    extra = []
    for a, b, name, score in lexed_spans(text):
        k = bisect_right(starts, a)
        if k and reach[k - 1] >= b:
            at = next(i for i in range(k - 1, -1, -1) if base[i][1] >= b)
            said.setdefault(at, (name, score))
        else:
            extra.append((a, b, "lexed", name, score))
    return sorted([(*x, *said.get(i, (None, None))) for i, x in enumerate(base)] + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind, name, score) of whole texts; null and empty texts have none.

    name and score: the sensitive name that the lexer found for the literal, null where a fixed pattern stands alone.

    Rows of equal or null doc_id are rows of their own, other columns are ignored, an empty table gives no row.
    """
    python_ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k, "name": n, "score": s} for a, b, k, n, s in spans(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,name:string,score:double>>")
