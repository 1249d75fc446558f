"""Secret scan by assignment-aware lexing.

A text with an assigner is lexed as a whole into strings (with prefixes, triple quotes, continued lines), names,
operators, brackets and bare values. Name-literal pairs come from

* ``name = value``, ``name: value``, ``:=``, ``=>``, ``==`` and ``+=``, ``"name": value``, ``name: type = value``,
  ``table["name"] = value``; the value may begin on the next line;
* ``setName("value")``, ``name("value")``, ``put("name", "value")``; ``<name>value</name>``.

A value is a string, neighbouring strings, an earlier name, any of these joined by ``+`` and in parentheses; unknown
names in such a sum are left out, and its literals stay. Each element of a list or tuple, however deep, is a value, and so
is each further argument of a call that reads a setting (``getenv("X", "value")``). Within brackets that are a name's
value, names stand under it: a literal counts for its own name, or at ``INHERITED`` for one it stands under. An unquoted
value is a literal only where it cannot be an identifier. Constants are
propagated in order through the text, so ``a = "..."; password = a`` reports the literal where it stands; a name
that gets another value forgets its constant. A literal is reported when the target name's sensitivity times the
literal's strength reaches ``MIN_SCORE``. Three plain patterns are always reported: assign, access and hex. Spans
are code points, end exclusive.

Null and empty texts have no findings; an empty table gives an empty result; repeated rows give equal rows; very
long texts are scanned whole, in time that grows with their length (a chain of constants is kept as references and
told once); extra columns stay, and where one has the result's name, the result's gets an underscore behind it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, small_batches, tidy

MIN_SCORE = 0.5
INHERITED = 0.7
KINDS = ("assign", "access", "hex", "named")
#: Parts of a target name and how much they say.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "pwd": 1.0,
    "passphrase": 1.0,
    "secret": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "token": 0.9,
    "apikey": 1.0,
    "auth": 0.7,
    "authorization": 0.8,
    "bearer": 0.9,
    "private": 0.6,
    "signing": 0.6,
    "key": 0.6,
    "salt": 0.5,
    "cookie": 0.5,
    "session": 0.5,
    "dsn": 0.6,
}
_PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|none|null|true|false|changeme|example|placeholder|your.*|todo|test)$")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\1" * 24
_LEX = re.compile(
    r"""(?P<str>(?<![A-Za-z0-9_$])[bBfFrRuU]{0,2}(?:\"{3}(?:\\.|[^\\"]|\"(?!\"\"))*\"{3}|'{3}(?:\\.|[^\\']|'(?!''))*'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`))
    |(?P<op>:=|=>|===?|!=|<=|>=|\+=|[=:])
    |(?P<plus>\+)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$-]*(?:\.[A-Za-z_$][A-Za-z0-9_$-]*)*)
    |(?P<open>[(\[{])
    |(?P<close>[)\]}])
    |(?P<end>[;,])
    |(?P<line>\n)
    |(?P<bare>[^\s"'`=:;,(){}\[\]]+)
    |(?P<other>["'`])""",
    re.X | re.S,
)
_ASSIGNERS = {":=", "=>", "=", ":", "==", "===", "+="}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_READERS = ("get", "getenv", "env", "environ", "config", "setting", "pop", "setdefault", "lookup", "read", "fetch", "optional", "default")
_SETTERS = ("set", "put", "add", "with", "use", "append", "header", "insert")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>\s*([^<>\s][^<>]*?)\s*</\1\s*>")
_HOLES = re.compile(r"\$?\{[^{}]*\}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("latin-1", "replace").translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name.strip("\"'`"))]
    parts += ["".join(pair) for pair in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


class Value:
    """A literal, or several joined: what its strength needs, its spans, and the values it is made of."""

    __slots__ = ("length", "chars", "text", "key", "span", "parts", "told")

    def __init__(self, text: str | None, span: tuple[int, int] | None = None, parts: tuple = ()):
        self.span, self.parts, self.told = span, parts, False
        if parts:
            self.length, self.chars = sum(p.length for p in parts), sum((p.chars for p in parts), Counter())
            short = self.length <= 256 and all(p.text is not None for p in parts)
            self.text, self.key = "".join(p.text for p in parts) if short else None, any(p.key for p in parts)
        else:
            self.length, self.chars, self.key = len(text), Counter(text), "PRIVATE KEY-----" in text
            self.text = text if len(text) <= 256 else None

    def tell(self, found: set) -> None:
        """Adds the spans below that have not been told yet."""
        stack = [self]
        while stack:
            value = stack.pop()
            if not value.told:
                value.told = True
                if value.span and value.span[1] > value.span[0]:
                    found.add((*value.span, "named"))
                stack += value.parts


def strength(value: Value | str) -> float:
    """0 to 1 from length and bits a character; 0 for what is plainly no secret."""
    value = Value(value) if isinstance(value, str) else value
    n, chars = value.length, value.chars
    if value.key:
        return 1.0
    if n < 6 or chars[" "] or chars["\n"] or value.text is not None and _PLACEHOLDERS.match(value.text):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in chars.values() if k)
    kinds = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in chars)
    return min(1.0, n / 16) * 0.4 + min(1.0, bits / 3.5) * 0.4 + min(1.0, (kinds - 1) / 2) * 0.2


def bare_literal(text: str) -> bool:
    """Whether an unquoted value can be no identifier: one has no two digits among letters without a word break."""
    if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$.-]*", text):
        return any(c.isalnum() for c in text)
    return len(text) >= 8 and sum(c.isdigit() for c in text) >= 2 and not re.search(r"[._$-]", text)


class Pairs:
    """The name-literal pairs of one text, in order, with constants put in."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _LEX.finditer(text)]
        self.known: dict[str, Value] = {}
        self.annotated = self._annotated()

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        _, a, b = self.tokens[i]
        return self.text[a:b]

    def _annotated(self) -> dict[int, int]:
        """For each ``=`` behind ``name: type`` the name's place; types may have brackets of any depth and length."""
        found: dict[int, int] = {}
        names: list[int | None] = [None]  # the annotated name of each open bracket's level
        for i, (kind, _, _) in enumerate(self.tokens):
            if kind == "open":
                names.append(None)
            elif kind == "close":
                if len(names) > 1:
                    names.pop()
                if self.word(i) == "}":
                    names[-1] = None
            elif kind == "op":
                word = self.word(i)
                if word == "=" and names[-1] is not None and names[-1] < i - 2:
                    found[i] = names[-1]
                names[-1] = i - 1 if word == ":" and self.kind(i - 1) == "name" else None
            elif kind in ("line", "end", "str", "other"):
                names[-1] = None
        return found

    def string(self, i: int) -> Value:
        _, a, b = self.tokens[i]
        while self.text[a] not in "\"'`":
            a += 1
        formatted = "f" in self.text[self.tokens[i][1] : a].lower() or self.text[a] == "`"
        size = 3 if b - a >= 6 and self.text[a : a + 3] in ('"' * 3, "'" * 3) else 1
        inner = self.text[a + size : b - size]
        return Value(_HOLES.sub("", inner) if formatted else inner, (a + size, b - size))

    def target(self, i: int) -> str | None:
        """The name that the assigner at ``i`` gives a value to."""
        if self.kind(i - 1) == "close" and self.word(i - 1) == "]" and self.kind(i - 3) == "open" and self.kind(i - 4) in ("name", "close") and self.kind(i - 2) in ("str", "name"):
            inside = self.word(i - 2)
            if self.kind(i - 2) == "str" or self.kind(i - 5) != "op":  # else a type, name: kind[of] =
                return inside.strip("\"'`")
        if i in self.annotated:  # name: type = value
            return self.word(self.annotated[i])
        return self.word(i - 1).strip("\"'`") if self.kind(i - 1) in ("name", "str", "bare") else None

    def value(self, k: int) -> tuple[list[Value], int, bool]:
        """The values that begin at ``k``, where they end, and whether they are one value, wholly literal."""
        start = k
        while self.kind(k) == "line" or self.kind(k) == "bare" and self.word(k) == "\\":
            k += 1
        if k > start and self.kind(k) != "str":
            return [], start, False
        if self.kind(k) == "open" and self.word(k) == "[":
            return self.elements(k + 1), k, False
        depth, parts, joined, unknown = 0, [], True, False
        while True:
            kind = self.kind(k)
            if kind == "open" and self.word(k) == "(" and joined:
                depth += 1
            elif kind == "line" and depth or kind == "bare" and self.word(k) == "\\" and self.kind(k + 1) == "line":
                k += kind == "bare"
            elif kind == "str":
                parts.append(self.string(k))
                joined = False
            elif kind == "plus" and not joined:
                joined = True
            elif joined and kind in ("name", "bare"):
                word, after = self.word(k), self.tokens[k + 1] if k + 1 < len(self.tokens) else ("", -1, -1)
                called = after[0] == "open" and after[1] == self.tokens[k][2]
                if kind == "name" and word in self.known and not called:
                    parts.append(self.known[word])
                elif not called and not parts and self.kind(k + 1) in ("", "line", "end", "close") and bare_literal(word):
                    parts.append(Value(word, self.tokens[k][1:]))
                elif called and not parts and _PARTS.findall(word) and any(p.lower() in _READERS for p in _PARTS.findall(word.rsplit(".", 1)[-1])[:1] + [word.rsplit(".", 1)[-1]]):
                    return self.elements(k + 2)[1:], k, False  # the first argument names the setting
                elif called or kind == "bare":
                    break
                else:
                    unknown = True
                joined = False
            elif kind == "close" and depth and self.word(k) == ")":
                depth -= 1
            else:
                break
            k += 1
        whole = parts[0] if len(parts) == 1 else Value(None, None, tuple(parts)) if parts else None
        if depth and whole and self.kind(k) == "end" and self.word(k) == ",":  # a tuple
            return [whole, *self.elements(k + 1)], k, False
        return [whole] if whole else [], k, bool(parts) and not joined and not unknown

    def elements(self, k: int) -> list[Value]:
        """The strings from ``k`` to the end of the brackets around it, up to an operator: behind one stands a pair of its own."""
        found, depth = [], 1
        while depth and (kind := self.kind(k)) and kind != "op":
            depth += (kind == "open") - (kind == "close")
            if kind == "str" and self.kind(k + 1) != "op":
                found.append(self.string(k))
            k += 1
        return found

    def calls(self, i: int) -> tuple[str, list[Value]] | None:
        """The pair of the call whose bracket is at ``i``."""
        if self.kind(i - 1) != "name" or self.kind(i + 1) != "str":
            return None
        last = self.word(i - 1).rsplit(".", 1)[-1]
        parts = [p.lower() for p in _PARTS.findall(last)]
        setter = bool(parts) and parts[0] in _SETTERS
        if setter and self.kind(i + 2) == "end" and self.word(i + 2) == "," and self.kind(i + 3) == "str":
            return self.word(i + 1).strip("\"'`"), self.value(i + 3)[0]
        if setter and len(parts) > 1 or parts and all(p in SENSITIVE or p == "api" for p in parts):
            return last, self.value(i + 1)[0]
        return None

    def __iter__(self):
        """(name, values, above): the target, and the sensitivity of the names that it stands under."""
        under = [0.0]  # for each open bracket that of all names above
        pending: str | None = None  # the name whose value begins here
        for i, (kind, _, _) in enumerate(self.tokens):
            if kind == "open":
                if self.word(i) == "(" and (got := self.calls(i)):
                    yield *got, under[-1]
                under.append(max(under[-1], sensitivity(pending)) if pending else under[-1])
                pending = None
            elif kind == "close":
                if len(under) > 1:
                    under.pop()
                pending = None
            elif kind == "op" and (op := self.word(i)) in _ASSIGNERS and i:
                pending = name = self.target(i)
                if name is None:
                    continue
                values, _, whole = self.value(i + 1)
                if op == "+=" and whole and name in self.known:
                    values = [Value(None, None, (self.known[name], values[0]))]
                if op not in ("==", "==="):
                    if whole:
                        self.known[name] = values[0]
                    elif op != ":":
                        self.known.pop(name, None)
                if values:
                    yield name, values, under[-1]
            elif kind != "line":
                pending = None
        for m in _TAG.finditer(self.text):
            yield m[1], [Value(m[2], m.span(2))], 0.0


def named_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str]]:
    if not any(c in text for c in ":=(<"):
        return []
    found: set = set()
    for name, values, above in Pairs(text):
        weight = max(sensitivity(name), INHERITED * above)
        for value in values if weight else ():
            if weight * strength(value) >= min_score:
                value.tell(found)
    return sorted(found)


def scan(text: str | None, min_score: float = MIN_SCORE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and the method's further ones, each by start, then kind."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base_spans(text), key=order), sorted(named_spans(text, min_score), key=order)


def written_out(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_udf(min_score: float = MIN_SCORE):
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, more = scan(text, min_score)
            n = Counter(kind for _, _, kind in base)
            every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(every)))
        tidy()
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, to: str = "secrets", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with a struct column of counts and spans; other columns stay."""
    return small_batches(docs).withColumn(fresh(docs, to)[0], scan_udf(min_score)(F.col("text")))
