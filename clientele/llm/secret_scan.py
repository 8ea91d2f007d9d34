"""Secrets in source and configuration text, by assignment-aware lexing.

A text is read as name-literal pairs: ``name = "literal"`` and its relatives in program text, JSON, YAML, INI, properties,
shell and XML. Right-hand sides may hold several literals, calls and names; a name stands for the literals that were assigned to
it before (constants are propagated, through any number of steps). A literal is reported when the name that it reaches is
sensitive and the literal looks like a secret; both are scored. Three plain patterns (``BASE``) are reported besides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

KINDS = ("assign", "access", "hex", "literal")
# kind, pattern, group whose length counts, least length
BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24))      # its matches are the runs of [0-9a-f]+ that are long enough

# sensitive names by their words; a pair stands for neighbouring words
NAMES = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0,
         "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "bearer": 1.0,
         "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "auth key": 1.0, "encryption key": 1.0, "signing key": 1.0,
         "master key": 1.0, "account key": 1.0, "shared key": 1.0, "connection string": 1.0,
         "pass": 0.6, "auth": 0.6, "authorization": 0.6, "key": 0.5, "salt": 0.5, "signature": 0.5, "pin": 0.5, "otp": 0.5, "dsn": 0.5, "cookie": 0.5, "session": 0.5}
# as a last word these name something about the secret, not the secret
ABOUT = {"length", "len", "min", "max", "count", "size", "file", "filename", "path", "dir", "url", "uri", "host", "name", "id", "hint", "policy", "type", "expiry", "expires",
         "ttl", "timeout", "field", "label", "regex", "pattern", "prompt", "reset", "version", "algorithm", "format", "enabled", "required", "limit", "column", "index", "header", "endpoint"}
PLACEHOLDERS = {"changeme", "change", "example", "sample", "dummy", "placeholder", "test", "testing", "none", "null", "nil", "true", "false", "undefined", "todo", "redacted", "default", "string", "password",
                "secret", "token", "your", "insert", "here", "xxx", "xxxx", "xxxxx", "xxxxxx", "xxxxxxxx"}
THRESHOLD = 0.35
NESTED = 3                           # levels of pairs inside the values of pairs, as in "Server=a;Pwd=b"
PAIR = re.compile("[=:]")

NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+"
TARGET = re.compile(rf"""(?<![\w$.-])(?:--)?(?:(?P<bare>{NAME})(?:\[["'](?P<item>[\w .-]{{1,}}+)["']\])?+|["'](?P<quoted>{NAME})["']\]?)
                         (?:[\x20\t]*+:[\x20\t]*+&?[A-Za-z_][\w.<>\[\]]*+(?=[\x20\t]*+=))?+      # a declared type
                         [\x20\t]*+(?P<op>:=|=>|\?=|\|\|=|\+=|=(?![=~>])|:(?![:/=]))[\x20\t]*+""", re.VERBOSE | re.ASCII)
ELEMENT = re.compile(rf"<(?P<name>{NAME})(?:[\x20\t][^<>\n]*+)?+>(?P<text>[^<>\n]++)</(?P=name)>", re.ASCII)
STRING = re.compile(r'''[rRbBuUfF@$]{0,2}(?:"""(?P<a>(?:[^"\\]|\\.|"(?!""))*+)"""|"(?P<b>(?:[^"\\\n]|\\.)*+)"|'(?P<c>(?:[^'\\\n]|\\.)*+)'|`(?P<d>(?:[^`\\\n]|\\.)*+)`)''', re.DOTALL)
WORD = re.compile(rf"(?P<name>{NAME})(?P<call>[\x20\t]*+\()?+", re.ASCII)
BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]++""")
USE = re.compile(rf"\$\{{(?P<a>{NAME})|\$(?P<b>[A-Za-z_]\w*+)|%(?P<c>[A-Za-z_]\w*+)%|\{{\{{[\x20\t]*+(?P<d>{NAME})|#\{{(?P<e>{NAME})|\{{(?P<f>{NAME})\}}", re.ASCII)
GLUE = re.compile(r"[\x20\t]*+(?:\+|\.\.|\.|\|\||\?\?|,|\band\b|\bor\b|&)?[\x20\t]*+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass
class Value:
    """What a name stands for: literals of its own and the values that it was made of."""
    literals: list[tuple[int, int]] = field(default_factory=list)
    made_of: list["Value"] = field(default_factory=list)


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target name is."""
    words = [w.lower() for w in PARTS.findall(name) if not w.isdigit()]
    if not words or words[-1] in ABOUT or "public" in words:
        return 0.0
    return max(NAMES.get(w, 0.0) for w in [*words, *map(" ".join, zip(words, words[1:])), *map("".join, zip(words, words[1:]))])


def literal_score(text: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret, from its length, entropy and kinds of characters."""
    if len(text) < 6 or text.isspace() or USE.fullmatch(text) or text[0] in "<{$%*" and text[-1] in ">})%*":
        return 0.0
    if all(w in PLACEHOLDERS for w in map(str.lower, PARTS.findall(text))):
        return 0.0
    kinds = sum(map(bool, (re.search(p, text) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))))
    if any(c in "\n\r" for c in text) or not quoted and re.fullmatch(r"[._-]*(?:[a-z._-]+|[A-Z._-]+|[0-9._-]+)", text):
        return 0.0                   # a bare word, number or dotted path
    counts = Counter(text)
    bits = sum(n * math.log2(len(text) / n) for n in counts.values())
    return min(1.0, bits / 64 + 0.15 * (kinds - 1)) * (0.4 if " " in text.strip() else 1.0)


class Lexer:
    """Reads one text from front to back; time grows with its length."""

    def __init__(self, text: str):
        self.text, self.names, self.sensitive, self.quoted = text, {}, [], set()

    def operands(self, at: int, end: int) -> tuple[Value, int, list[tuple[int, int]]]:
        """The value behind an operator, where it ends, and the parts that may hold pairs of their own."""
        text, value, depth, inner = self.text, Value(), 0, []
        while at < end and text[at] not in "\n\r":
            if m := STRING.match(text, at, end):
                kind = m.lastgroup
                value.literals.append(m.span(kind))
                self.quoted.add(m.span(kind))
                self.used(m.start(kind), m.end(kind), value)
                inner.append(m.span(kind))
            elif text[at] in ")]}":
                if not depth:
                    break
                depth, at = depth - 1, at + 1
                continue
            elif depth and text[at] in "([{":
                depth, at = depth + 1, at + 1
                continue
            elif (m := WORD.match(text, at, end)) and (m["call"] or m["name"] in self.names or depth):
                if m["call"]:
                    depth += 1
                elif m["name"] in self.names:
                    value.made_of.append(self.names[m["name"]])
            elif not depth and (m := BARE.match(text, at, end)):
                self.used(m.start(), m.end(), value)
                if not (value.literals or value.made_of):
                    value.literals.append(m.span())
                inner.append(m.span())
                at = m.end()
                break
            else:
                m = None
            at = m.end() if m else at + 1
            glue = GLUE.match(text, at, end)
            if not depth and glue[0].strip(" \t") in ("", ","):
                break
            at = glue.end()
        return value, at, inner

    def used(self, start: int, end: int, value: Value) -> None:
        for m in USE.finditer(self.text, start, end):
            if (name := m[m.lastgroup]) in self.names:
                value.made_of.append(self.names[name])

    def assign(self, name: str, value: Value, joined: bool = False) -> None:
        if joined and name in self.names:
            value.made_of.append(self.names[name])
        self.names[name] = value
        if (score := name_score(name)) > 0:
            self.sensitive.append((score, name, value))

    def pairs(self, at: int, end: int, level: int) -> None:
        """All pairs of a part of the text, in order, with those inside their values."""
        named = None
        while m := TARGET.search(self.text, at, end):
            value, at, inner = self.operands(m.end(), end)
            name = m["item"] or m["quoted"] or m["bare"]
            last = re.split(r"[.-]", name)[-1].lower()
            if last == "value" and named:                             # name: X, value: Y as a pair
                self.assign(named, value)
            named = self.text[slice(*value.literals[0])] if last in ("name", "key") and len(value.literals) == 1 else None
            self.assign(name, value, m["op"] == "+=")
            for part in inner if level < NESTED else ():
                if PAIR.search(self.text, *part):
                    self.pairs(*part, level + 1)

    def run(self) -> dict[tuple[int, int], tuple[float, str]]:
        """Literals that reach a sensitive name: their bounds, best score and that name."""
        text = self.text
        for m in ELEMENT.finditer(text):
            value = Value([m.span("text")])
            self.quoted.add(m.span("text"))
            self.used(*m.span("text"), value)
            self.assign(m["name"], value)
        self.pairs(0, len(text), 0)
        found: dict[tuple[int, int], tuple[float, str]] = {}
        seen: dict[int, float] = {}
        for score, name, value in sorted(self.sensitive, key=lambda s: -s[0]):      # each value is followed once per level of sensitivity at most
            todo = [value]
            while todo:
                v = todo.pop()
                if seen.get(id(v), 0.0) >= score:
                    continue
                seen[id(v)] = score
                todo.extend(v.made_of)
                for span in v.literals:
                    total = score * literal_score(text[slice(*span)], span in self.quoted)
                    if total >= THRESHOLD and total > found.get(span, (0.0, ""))[0]:
                        found[span] = (total, name)
        return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, index of the kind, and end of the base patterns' matches."""
    return sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[group]) >= least)


def findings(text: str) -> list[tuple[int, int, int, str | None, float | None]]:
    """Start, index of the kind, end, name and score of all spans; a literal inside a base span of kind ``assign`` isn't listed again."""
    base = base_spans(text)
    held = [(s, e) for s, k, e in base if k == 0]
    out, i = [(s, k, e, None, None) for s, k, e in base], 0
    for (s, e), (score, name) in sorted(Lexer(text).run().items()):
        while i < len(held) and held[i][1] < e:
            i += 1
        if not (i < len(held) and held[i][0] <= s):
            out.append((s, len(KINDS) - 1, e, name, score))
    return sorted(out, key=lambda x: x[:3])


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in spans)


def locate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per finding: ``doc_id``, ``kind``, ``start``, ``end`` (code points, end exclusive), ``name``, ``score`` (both null for base kinds)."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            ids, rows = batch.column(0), [(i, *f) for i, t in enumerate(K.texts_of(batch, text_column)) for f in findings(t)]
            at, start, kind, end, name, score = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                                              pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "kind", "start", "end", "name", "score"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(part, f"doc_id {kind}, kind string, start long, end long, name string, score double")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_literal``.

    A null text counts as empty: no spans and the digest of the empty string. Null ids and repeated rows stay rows of their own;
    other columns are not read. A text is read whole; the time grows with its length. Names are looked up in the order of the text,
    without regard to scopes: a later assignment replaces an earlier one.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            out: list[tuple] = []
            for text in K.texts_of(batch, text_column):
                spans = findings(text)
                n = Counter(x[1] for x in spans)
                digest = sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
                out.append((n[0], n[1], n[2], digest, _joined(spans), n[3]))
            a, b, c, digest, joined, lit = zip(*out) if out else ((),) * 6
            count = lambda v: pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), count(a), count(b), count(c), pa.array(digest, pa.string()), pa.array(joined, pa.string()), count(lit)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(part, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
