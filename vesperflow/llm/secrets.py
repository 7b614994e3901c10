"""Secret scanning: base patterns, and an assignment-aware lexer of source and configuration syntax.

The lexer turns a text into tokens: strings of all quotings (triple, raw, formatted, template), heredocs, names with
their dots, operators, bare configuration values. The parser makes name-literal pairs of them: assignments of all
spellings (`name = "x"`, `"name": "x"`, `name: type = "x"`, `cfg["name"] = "x"`, `a, b = "x", "y"`, `NAME=x`), keyword
and positional call arguments, list elements, XML elements, heredocs. Values follow constants through names, also ones
defined further down, `+`, neighbouring strings and placeholders of formatted strings. A literal is a secret if the
name it is assigned to, or one that it reaches through constants, is sensitive and the value looks like a key.

Values are graphs of shared parts: nothing is built by joining, so time and memory are linear in the text however often
constants are joined. What a value looks like is kept in a few numbers that are added up along the graph.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vesperflow.llm._common import map_batches, map_rows
from vesperflow.session import pick

KINDS = ("assign", "access", "hex", "literal")
#: Base patterns; what is matched and too short is dropped, not searched again.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Name parts and how strongly each marks its value as secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "auth": 0.6, "key": 0.5, "salt": 0.6, "signature": 0.5}
_JOINED = {("api", "key"): "apikey", ("access", "key"): "accesskey", ("private", "key"): "privatekey"}
#: Last parts of names that hold something about a secret, and parts that make a key none.
ABOUT = frozenset("type count url uri name field length len size path file prefix expires expiry ttl limit header regex pattern label hint format algorithm method id index column policy".split())
OPEN = frozenset("public primary foreign partition sort cache index".split())
PLACEHOLDER = re.compile(r"(?i)^(changeme|example|placeholder|dummy|none|null|true|false|x{4,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[_-].*)$")
#: Name strength times literal strength from which a literal is a secret.
THRESHOLD = 0.45
#: Functions whose value is their argument's, for what it looks like.
TRANSPARENT = frozenset("str bytes string b64decode b64encode base64decode atob btoa decode encode unhexlify fromhex from frombase64string secretstr securestring strip trim quote dedent format join".split())
_NAMED = re.compile(r"(?i)pass|pwd|secret|token|key|credential|auth|salt|signature", re.ASCII)
_TOKEN = re.compile(
    r"""(?P<str>(?i:[rbfu]|[rb][rbf]|fr)?(?:"(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*')|`(?:[^`\\\n]|\\.)*`)|(?P<triple>(?i:[rbfu]|[rb][rbf]|fr)?(?:\"""|\'\'\'))|(?P<here><<[-~]?\x20?["']?[A-Za-z_]\w*["']?)|(?P<op>:=|=>|===?|!==?|<=|>=|\+=|\|\|=|\?\?=|[=:+,;(){}\[\]<>])|(?P<nl>\n)|(?P<name>\$?\$?\{?[A-Za-z_][A-Za-z0-9_]*\}?(?:(?:[.\-]|->|::)[A-Za-z_][A-Za-z0-9_]*)*)|(?P<bare>[^\s"'`=:+,;(){}\[\]<>]+)""",
    re.ASCII,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HOLE = re.compile(r"\$?\{([^{}]*)\}")
_SHELL_HOLE = re.compile(r"\$\{([^{}]*)\}|\$([A-Za-z_]\w*)", re.ASCII)
_WORDS = re.compile(r"[A-Za-z]?[a-z]*(?:[_\-./: ]+[A-Za-z]?[a-z]*)*|[A-Z]+(?:[_\-./: ]+[A-Z]+)*")
_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_strength(name: str) -> float:
    """How strongly a target's name says that its value is secret, 0 to 1; camel, snake, dotted names alike."""
    parts = [p.lower() for p in _PART.findall(name)]
    parts = [p[:-1] if p.endswith("s") and p[:-1] in SENSITIVE else p for p in parts]
    if not parts or parts[-1] in ABOUT or parts[-1] == "key" and not OPEN.isdisjoint(parts):
        return 0.0
    parts += [j for pair, j in _JOINED.items() for a in [parts] if any((x, y) == pair for x, y in zip(a, a[1:], strict=False))]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


class Look(NamedTuple):
    """What a value looks like: its length, a bit for each distinct character (ASCII apart, others by 32 classes), the
    text itself if short, whether it is a private key's block."""

    n: int = 0
    chars: int = 0
    text: str | None = ""
    block: bool = False


#: Values up to this length can be placeholders or plain words; lengths are counted up to FAR.
SHORT, FAR = 64, 1 << 40
_SETS = [sum(1 << ord(c) for c in s) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")]
_BLANK = 1 << 32


def look(text: str) -> Look:
    """A literal's look; line breaks and the blanks around them count as nothing."""
    if "\n" in text:
        text = "".join(x.strip() for x in text.split("\n"))
    bits = 0
    for c in set(text):
        bits |= 1 << (ord(c) if ord(c) < 128 else 128 + ord(c) % 32)
    return Look(len(text), bits, text if len(text) <= SHORT else None, bool(_BEGIN.search(text)))


def joined(a: Look, b: Look) -> Look:
    n = min(a.n + b.n, FAR)
    return Look(n, a.chars | b.chars, a.text + b.text if n <= SHORT and a.text is not None and b.text is not None else None, a.block or b.block)


def literal_strength(value: str | Look) -> float:
    """How much a literal looks like a key, 0 to 1: by length, distinct characters (5 at least) and mixture of classes."""
    v = look(value) if isinstance(value, str) else value
    if v.block:
        return 1.0
    if v.text is not None:
        v = look(v.text.strip()) if v.text != v.text.strip() else v
        if PLACEHOLDER.match(v.text) or _WORDS.fullmatch(v.text):
            return 0.0
    if v.n < 8 or v.chars & _BLANK or v.chars.bit_count() < 5:
        return 0.0
    classes = sum(bool(v.chars & x) for x in _SETS) + bool(v.chars & ~(_SETS[0] | _SETS[1] | _SETS[2]))
    if classes < 2:
        return 0.0
    return min(1.0, min(v.n, 16) / 16) * min(1.0, math.log2(v.chars.bit_count()) / 3.0) * min(1.0, 0.5 + classes / 4)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def lex(text: str) -> Iterator[Token]:
    """Tokens in order. A triple-quoted string or heredoc gives one token `block` with the place of its body and is
    then lexed inside as well, as it may hold configuration; its end is passed over."""
    at, closes, lines = 0, set(), None
    while m := _TOKEN.search(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "triple":
            quote = m.group()[-3:]
            if at - 3 in closes:
                closes.discard(at - 3)
                continue
            end = text.find(quote, at)
            if end >= 0:
                closes.add(end)
                yield Token("block", m.group(), at, end)
        elif kind == "here":
            if lines is None:  # where each line begins, by what it says
                lines, start = {}, 0
                for row in text.split("\n"):
                    word = row.strip()
                    if word.isidentifier():
                        lines.setdefault(word, []).append(start)
                    start += len(row) + 1
            ends, body = lines.get(m.group().lstrip("<-~ ").strip("\"'"), []), text.find("\n", at) + 1
            k = bisect_left(ends, body)
            if body and k < len(ends):
                yield Token("block", m.group(), body, ends[k])
        else:
            yield Token(kind, m.group(), m.start(), at)


class Graph:
    """Values by node: a node's parts are places of literals, earlier nodes, or names that are looked up at
    the end; a place with a name is a bare value, unless the name turns out to be defined."""

    def __init__(self, text: str):
        self.text = text
        self.parts: list[list] = []
        self.names: list[str] = []
        self.first: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def put(self, name: str, parts: list) -> int:
        k = len(self.parts)
        self.parts.append(parts)
        self.names.append(name)
        for n in {name, short(name)}:
            self.first.setdefault(n, k)
            self.last[n] = k
        return k

    def ref(self, name: str) -> int | str:
        """The latest value of a name so far, or the name itself if it has none yet."""
        return self.last.get(name, self.last.get(short(name), name))

    def defined(self, name: str) -> int | None:
        return self.first.get(name, self.first.get(short(name)))

    def resolved(self, k: int) -> list:
        """A node's parts as places and nodes; a name that nothing defines is none, or a bare value's own place."""
        out = []
        for p in self.parts[k]:
            name = p if isinstance(p, str) else p[2] if isinstance(p, tuple) and len(p) > 2 else None
            found = p if name is None else self.defined(name)
            found = p[:2] if found is None and isinstance(p, tuple) else found
            out += [] if found is None or found == k else [found]
        return out

    def looks(self, of: list[int]) -> dict[int, Look]:
        """The looks of nodes, with those they are made of. What refers to itself adds nothing to itself."""
        done: dict[int, Look] = {}
        open_: set[int] = set()
        stack = list(reversed(of))
        while stack:
            k = stack[-1]
            if k in done:
                stack.pop()
                continue
            if k not in open_:
                open_.add(k)
                more = [c for c in self.resolved(k) if isinstance(c, int) and c not in done and c not in open_]
                if more:
                    stack += more
                    continue
            stack.pop()
            out = Look()
            for p in self.resolved(k):
                out = joined(out, look(self.text[p[0] : p[1]]) if isinstance(p, tuple) else done.get(p, Look()))
            done[k] = out
        return done

    def places(self, of: list[int]) -> list[tuple[int, int]]:
        """The places of all literals that the nodes reach, each once."""
        seen, found, stack = set(of), set(), list(of)
        while stack:
            for p in self.resolved(stack.pop()):
                if isinstance(p, tuple):
                    found.update([p] if p[1] > p[0] else [])
                elif p not in seen:
                    seen.add(p)
                    stack.append(p)
        return sorted(found)


def short(name: str) -> str:
    """The last part of a dotted or subscripted name."""
    return re.split(r"[.:>]", name)[-1] or name


def plain_name(name: str) -> str:
    return name.lstrip("$").strip("{}")


def pieces(t: Token) -> list:
    """The parts of a string token: its literal stretches, and the names in the holes of a formatted one."""
    i = next(k for k, c in enumerate(t.text) if c in "\"'`")
    a, b, quote = t.start + i + 1, t.end - 1, t.text[i]
    body = t.text[i + 1 : -1]
    hole = _HOLE if "f" in t.text[:i].lower() or quote == "`" else _SHELL_HOLE if quote == '"' and "$" in body else None
    if hole is None:
        return [(a, b)]
    out, at = [], 0
    for m in hole.finditer(body):
        if quote == "`" and not m.group().startswith("$"):
            continue
        out += [(a + at, a + m.start())] if m.start() > at else []
        inner = (m[1] if m[1] is not None else m[m.lastindex]).split("!")[0].split(":")[0].strip()
        out += [inner] if re.fullmatch(r"[A-Za-z_][\w.]*", inner) else []
        at = m.end()
    return [*out, (a + at, b)] if a + at < b or not out else out


class Parser:
    """Name-literal pairs of a text's tokens, read once from left to right."""

    def __init__(self, text: str):
        self.text, self.graph = text, Graph(text)
        self.tokens, self.ahead, self.at = lex(text), deque(), 0
        #: For each open bracket: the called function, the string last seen as an argument of its own, None if no call.
        self.calls: list[list] = []

    def peek(self, k: int = 0) -> Token:
        while len(self.ahead) <= k:
            self.ahead.append(next(self.tokens, Token("end", "", len(self.text), len(self.text))))
        return self.ahead[k]

    def next(self) -> Token:
        t = self.peek()
        if t.kind != "end":
            self.ahead.popleft()
        return t

    def op(self, k: int, *which: str) -> bool:
        t = self.peek(k)
        return t.kind == "op" and t.text in which

    def run(self) -> Graph:
        while self.peek().kind != "end":
            t = self.peek()
            if t.kind in ("name", "str", "block") and self.pair():
                continue
            self.next()
            if t.kind == "op" and t.text in "([{":
                self.calls.append([None, None])
            elif t.kind == "op" and t.text in ")]}" and self.calls:
                self.calls.pop()
            elif t.kind == "name" and self.op(0, "(") and self.peek().start == t.end:
                self.next()
                self.calls.append([plain_name(t.text), None])
            elif t.kind in ("str", "block") and self.calls and self.calls[-1][0]:
                self.argument(t)
            elif t.kind == "op" and t.text == ">":
                self.element()
        return self.graph

    def argument(self, t: Token) -> None:
        """A literal among a call's arguments belongs to the name before it, else to the function."""
        f, before = self.calls[-1]
        parts = pieces(t) if t.kind == "str" else [(t.start, t.end)]
        if before is not None:
            self.graph.put(before, parts)
            self.calls[-1][1] = None
            return
        text = "".join(self.text[p[0] : p[1]] for p in parts if isinstance(p, tuple))
        if len(text) <= SHORT and re.fullmatch(r"[A-Za-z_][\w.\-]*", text) and name_strength(text):
            self.calls[-1][1] = text
        elif name_strength(f) and re.match(r"(?i)set|with|add|use|put|login|auth|pass|secret|token", short(f)):
            self.graph.put(f, parts)

    def element(self) -> None:
        """<name>value</name>, seen from its first `>`."""
        m = re.compile(r"<([A-Za-z][\w.:-]*)>$").search(self.text, max(0, self.peek().start - 80), self.peek().start) if self.peek().kind != "end" else None
        if m and (v := re.compile(r"([^\s<>]+)</").match(self.text, m.end())):
            self.graph.put(m[1], [(v.start(1), v.end(1))])

    def target(self) -> tuple[str, int] | None:
        """(name, tokens it takes) of an assignment's target at the head, up to the sign; None if there is none."""
        t, k = self.peek(), 1
        name = plain_name(t.text) if t.kind == "name" else self.text[t.start : t.end].strip("\"'`") if t.kind == "str" else None
        if not name:
            return None
        while t.kind == "name" and self.op(k, "[") and self.peek(k).start == self.peek(k - 1).end and self.peek(k + 1).kind in ("str", "name") and self.op(k + 2, "]"):
            inner = self.peek(k + 1)
            name += "." + (plain_name(inner.text) if inner.kind == "name" else inner.text.strip("\"'`"))
            k += 3
        return name, k

    def pair(self) -> bool:
        """Read an assignment at the head; False, with nothing read, if there is none."""
        found = self.target()
        if found is None:
            return False
        names, k = [found[0]], found[1]
        while self.op(k, ",") and self.peek(k + 1).kind == "name" and len(names) < 32 and (not self.calls or self.calls[-1][0] is None):
            names.append(plain_name(self.peek(k + 1).text))
            k += 2
        if len(names) > 1 and not self.op(k, "="):
            return False
        if self.op(k, ":") and self.peek().kind == "name" and self.peek(k + 1).kind == "name":  # an annotated name
            j = k + 2
            if self.op(j, "["):
                while j < k + 16 and not self.op(j, "]"):
                    j += 1
                j += 1
            k = j if self.op(j, "=") else k
        if not self.op(k, "=", ":", ":=", "=>", "+=", "||=", "??="):
            return False
        more = self.peek(k).text == "+="
        for _ in range(k + 1):
            self.next()
        chain = [names[0]]
        while len(names) == 1 and self.peek().kind == "name" and (found := self.target()) and self.op(found[1], "="):  # a = b = "x"
            chain.append(found[0])
            for _ in range(found[1] + 1):
                self.next()
        if len(chain) == 1 and (self.op(0, "[", "(") or len(names) > 1):
            self.several(names)
            return True
        parts = self.value()
        if more:
            parts = [self.graph.ref(names[0]), *parts]
        if parts:
            of = self.graph.put(chain[-1], parts)
            for name in reversed(chain[:-1]):
                of = self.graph.put(name, [of])
        return True

    def several(self, names: list[str]) -> None:
        """A list of values for one name, or as many values as names."""
        close = {"[": "]", "(": ")"}.get(self.peek().text) if self.op(0, "[", "(") else None
        if close:
            self.next()
        i = 0
        while self.peek().kind != "end":
            if close and self.peek().kind == "nl":
                self.next()
                continue
            head = self.peek()
            if head.kind in ("name", "str") and (found := self.target()) and self.op(found[1], ":", "=", "=>"):
                break  # a record within a list: its own pairs follow
            parts = self.value(bool(close))
            if parts:
                self.graph.put(names[min(i, len(names) - 1)], parts)
            i += 1
            while close and self.peek().kind == "nl":
                self.next()
            if not self.op(0, ","):
                break
            self.next()
        if close:
            if self.op(0, close):
                self.next()
            else:
                self.calls.append([None, None])

    def value(self, lines: bool = False) -> list:
        """The parts of an expression at the head: strings side by side or joined by signs, names, calls, bare values."""
        parts: list = []
        while True:
            t = self.peek()
            if t.kind == "str":
                parts += [self.graph.ref(p) if isinstance(p, str) else p for p in pieces(self.next())]
            elif t.kind == "block":
                self.next()
                return [*parts, (t.start, t.end)]
            elif t.kind in ("name", "bare"):
                name = plain_name(t.text)
                if self.op(1, "(") and self.peek(1).start == t.end:
                    if short(name).lower() not in TRANSPARENT and not re.search(r"(?i)\.(decode|encode|format|strip)$", name):
                        return parts  # what a call gives is not in the text; its arguments are read as a call's
                    self.next()
                    self.next()
                    parts += self.value(lines)
                    if self.op(0, ")"):
                        self.next()
                    else:
                        self.calls.append([name, None])
                        return parts
                elif t.kind == "name" and (name in self.graph.last or short(name) in self.graph.last):
                    parts.append(self.graph.ref(name))
                    self.next()
                elif not parts and (m := _BARE.match(self.text, t.start)) and not self.identifier(m.group(), t):
                    while self.peek().start < m.end() and self.peek().kind != "end":
                        self.next()  # a bare configuration value goes on to the next blank or separator
                    return [(t.start, m.end(), name) if t.kind == "name" and m.end() == t.end else (t.start, m.end())]
                elif t.kind == "name":
                    parts.append(name)
                    self.next()
                else:
                    return parts
            else:
                return parts
            k = 0
            while lines and self.peek(k).kind == "nl":
                k += 1
            if self.op(k, "+") or self.peek(k).kind == "bare" and self.peek(k).text in (".", "..", "||", "\\"):
                k += 1
                while self.peek(k).kind == "nl":
                    k += 1
            elif self.peek(k).kind == "name" and self.peek(k).text == "or":
                k += 1
            elif self.peek(k).kind != "str" or t.kind != "str":
                return parts
            for _ in range(k):
                self.next()

    def identifier(self, bare: str, t: Token) -> bool:
        """Whether a bare value is a name or a path of names, which stands for a value and is none."""
        return t.kind == "name" and bare == t.text and (t.text.startswith("$") or not any(map(str.isdigit, bare)) or "." in bare or "->" in bare)


def pairs(text: str) -> list[tuple[str, Look, list[tuple[int, int]]]]:
    """(name, look of the value, places of the literals it is made of) of all assignments, constants propagated.

    For inspection: places are listed for each pair. `literal_spans` lists each once.
    """
    g = Parser(text).run()
    looks = g.looks(list(range(len(g.parts))))
    return [(n, looks[k], g.places([k])) for k, n in enumerate(g.names)]


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, "literal") of the literals that sensitive names are given."""
    if not _NAMED.search(text) or not ("=" in text or ":" in text or "(" in text or "</" in text):
        return []
    g = Parser(text).run()
    strengths: dict[str, float] = {}
    for n in g.names:
        if n not in strengths:
            strengths[n] = name_strength(n)
    marked = [k for k, n in enumerate(g.names) if strengths[n]]
    looks = g.looks(marked)
    return [(a, b, "literal") for a, b in g.places([k for k in marked if strengths[g.names[k]] * literal_strength(looks[k]) >= THRESHOLD])]


def order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of `docs`.

    Spans are code points of the whole text, end exclusive, by start and then kind. Null texts count as empty;
    repeated rows stay; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def make():
        def f(b: pa.RecordBatch) -> dict:
            base = [order(base_spans(t or "")) for t in b.column(1).to_pylist()]
            more = [literal_spans(t or "") for t in b.column(1).to_pylist()]
            return {
                "doc_id": b.column(0), **{f"n_{k}": [sum(s[2] == k for s in x) for x in base] for k in KINDS[:3]},
                "base_sha256": [hashlib.sha256(join(x).encode()).hexdigest() for x in base], "spans": [join(order(x + y)) for x, y in zip(base, more, strict=True)],
            }

        return f

    return map_batches(pick(docs, [id_col, text_col]), make, schema)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every stretch of secret spans replaced by `mark`."""
    spans = order(base_spans(text) + literal_spans(text))
    out, at, until = [], 0, -1
    for a, b, _ in spans:
        if a > until:
            out += [text[at:a], mark]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs`, all columns as they are, with secrets in the text replaced and the length column, if there, renewed."""
    names = docs.columns
    at = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if t is None else redact(t) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                old = b.column(size).to_pylist()
                cols[size] = pa.array([o if n == t else len(n) for o, t, n in zip(old, texts, new, strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_rows(docs, run)
