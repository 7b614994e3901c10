"""Chat formatting: a compiler from a sandboxed template language to Python closures.

Source goes through a scanner and a recursive-descent parser to a syntax tree; constant expressions and branches are
folded and neighbouring texts joined; the tree becomes nested closures that write into an `Output`, which also notes
the stretches between generation markers (the loss mask).

    {{ expr }}   {% for x in expr %} .. {% else %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set x = expr %}   {% generation %} .. {% endgeneration %}   {# comment #}   {%- and -%} trim white space

Expressions have literals, lists, names, `a.b`, `a[b]`, filters, tests (`is defined`, `is none`), arithmetic, `~`,
comparison, `in`, `and`/`or`/`not` and `a if c else b`. Templates reach only the values they are given: fields of
mappings and of `loop`, never Python attributes or calls.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperflow.llm._common import bound_arrow
from vesperflow.session import pick


class TemplateError(ValueError):
    pass


# ---- scanner -------------------------------------------------------------------------------------------------------

_WORD = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<end>-?%\}|-?\}\})|(?P<op>==|!=|<=|>=|//|[-+*/%~<>=.,|()\[\]:]))""",
    re.DOTALL,
)
_OPEN = re.compile(r"\{\{-?|\{%-?|\{#-?")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.DOTALL)


def scan(source: str) -> list[tuple]:
    """("text", s), ("out", words) and ("tag", words) in order; words are (kind, value)."""
    out: list[tuple] = []
    at, trim = 0, False
    while True:
        m = _OPEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m.group().endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            return out
        kind = m.group()[:2]
        if kind == "{#":
            end = source.find("#}", m.end())
            if end < 0:
                raise TemplateError("a comment does not end")
            trim, at = source[end - 1] == "-", end + 2
            continue
        words, at = [], m.end()
        while True:
            w = _WORD.match(source, at)
            if not w:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            at = w.end()
            if w.lastgroup == "end":
                if w["end"].lstrip("-") != {"{{": "}}", "{%": "%}"}[kind]:
                    raise TemplateError(f"{kind} ends with {w['end']}")
                trim = w["end"].startswith("-")
                break
            v = w[w.lastgroup]
            words.append(("num", float(v) if "." in v else int(v)) if w.lastgroup == "num" else ("str", _unquote(v)) if w.lastgroup == "str" else (w.lastgroup, v))
        out.append(("out" if kind == "{{" else "tag", words))


# ---- parser: expressions are tuples (kind, ...), statements too ----------------------------------------------------

_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "is", "if", "else", "for", "set"}
_BINARY = [["or"], ["and"], None, ["==", "!=", "<", "<=", ">", ">=", "in"], ["~"], ["+", "-"], ["*", "/", "//", "%"]]
DEPTH = 60


class _Expressions:
    def __init__(self, words: list[tuple]):
        self.words, self.at, self.depth = words, 0, 0

    def peek(self, *values) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] in ("op", "name") and self.words[self.at][1] in values

    def take(self, *values):
        if values and not self.peek(*values) or self.at >= len(self.words):
            raise TemplateError(f"{' or '.join(values) or 'something'} expected in {self.words!r}")
        self.at += 1
        return self.words[self.at - 1]

    def done(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")

    def name(self) -> str:
        kind, v = self.take()
        if kind != "name" or v.startswith("_"):
            raise TemplateError(f"{v!r} is not a name that templates may use")
        return v

    def expr(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        a = self.binary(0)
        if self.peek("if"):
            self.take()
            c = self.binary(0)
            b = ("const", "")
            if self.peek("else"):
                self.take()
                b = self.expr()
            a = ("cond", c, a, b)
        self.depth -= 1
        return a

    def binary(self, level: int):
        if level == len(_BINARY):
            return self.unary()
        if _BINARY[level] is None:
            if self.peek("not"):
                self.take()
                return ("not", self.binary(level))
            return self.binary(level + 1)
        a = self.binary(level + 1)
        while True:
            if "in" in _BINARY[level] and self.peek("not"):
                self.take()
                self.take("in")
                a = ("not", ("bin", "in", a, self.binary(level + 1)))
            elif self.peek(*_BINARY[level]):
                op = self.take()[1]
                b = self.binary(level + 1)
                a = (op, a, b) if op in ("and", "or") else ("bin", op, a, b)
            else:
                return a

    def unary(self):
        if self.peek("-"):
            self.take()
            return ("neg", self.unary())
        e = self.primary()
        while True:
            if self.peek("."):
                self.take()
                e = ("item", e, ("const", self.name()))
            elif self.peek("["):
                self.take()
                e = ("item", e, self.expr())
                self.take("]")
            elif self.peek("|"):
                self.take()
                name, args = self.name(), []
                if self.peek("("):
                    args = self.listed("(", ")")
                if name not in FILTERS and name != "escape":
                    raise TemplateError(f"no filter {name!r}")
                e = ("filter", name, e, args)
            elif self.peek("is"):
                self.take()
                no = self.peek("not") and bool(self.take())
                name = self.name()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                e = ("test", name, e)
                e = ("not", e) if no else e
            else:
                return e

    def listed(self, first: str, last: str) -> list:
        self.take(first)
        out = []
        while not self.peek(last):
            out.append(self.expr())
            if not self.peek(last):
                self.take(",")
        self.take(last)
        return out

    def primary(self):
        if self.peek("("):
            self.take()
            e = self.expr()
            self.take(")")
            return e
        if self.peek("["):
            return ("list", self.listed("[", "]"))
        kind, v = self.take()
        if kind in ("num", "str"):
            return ("const", v)
        if kind == "name" and v in _CONSTANTS:
            return ("const", _CONSTANTS[v])
        if kind == "name" and v not in _KEYWORDS and not v.startswith("_"):
            return ("name", v)
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of statements."""
    pieces, at = scan(source), 0

    def block(*ends: str, depth: int = 0) -> tuple[list[tuple], str | None, _Expressions | None]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        out: list[tuple] = []
        while at < len(pieces):
            kind, v = pieces[at]
            at += 1
            if kind == "text":
                out.append(("text", v))
                continue
            e = _Expressions(v)
            if kind == "out":
                out.append(("out", e.expr()))
                e.done()
                continue
            word = e.name()
            if word in ends:
                return out, word, e
            if word == "for":
                names = [e.name()]
                while e.peek(","):
                    e.take()
                    names.append(e.name())
                e.take("in")
                over = e.expr()
                e.done()
                body, end, _ = block("else", "endfor", depth=depth + 1)
                other = block("endfor", depth=depth + 1)[0] if end == "else" else []
                out.append(("for", names, over, body, other))
            elif word == "if":
                arms, other, end = [], [], "elif"
                while end == "elif":
                    c = e.expr()
                    e.done()
                    body, end, e = block("elif", "else", "endif", depth=depth + 1)
                    arms.append((c, body))
                if end == "else":
                    other = block("endif", depth=depth + 1)[0]
                out.append(("if", arms, other))
            elif word == "set":
                name = e.name()
                e.take("=")
                out.append(("set", name, e.expr()))
                e.done()
            elif word == "generation":
                e.done()
                out.append(("generation", block("endgeneration", depth=depth + 1)[0]))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, None, None

    return block()[0]


# ---- meaning of operators, filters and tests ----------------------------------------------------------------------

UNDEFINED = type("Undefined", (), {"__bool__": lambda self: False, "__str__": lambda self: ""})()


def text_of(v) -> str:
    return "" if v is None or v is UNDEFINED else v if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


def _number(v):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise TemplateError("not a number")
    return v


def _add(a, b):
    return a + b if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list) else _number(a) + _number(b)


def _in(a, b):
    return a in b if isinstance(b, (str, list, dict)) else False


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: text_of(a) + text_of(b), "+": _add, "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "/": lambda a, b: _number(a) / _number(b),
    "//": lambda a, b: _number(a) // _number(b), "%": lambda a, b: _number(a) % _number(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": _in,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "default": lambda v, d="": d if v is UNDEFINED or v is None else v, "tojson": lambda v: json.dumps(None if v is UNDEFINED else v, ensure_ascii=False), "string": text_of, "first": lambda v: v[0] if v else UNDEFINED,
    "last": lambda v: v[-1] if v else UNDEFINED, "join": lambda v, s="": text_of(s).join(map(text_of, v)), "replace": lambda v, a, b: text_of(v).replace(a, b) if a else text_of(v),
}
TESTS: dict[str, Callable] = {"defined": lambda v: v is not UNDEFINED, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict)}


# ---- folding ------------------------------------------------------------------------------------------------------


def fold(e: tuple) -> tuple:
    """The expression with all constant parts worked out; what would fail is left to fail when it runs."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "list":
        items = [fold(x) for x in e[1]]
        return ("const", [x[1] for x in items]) if all(x[0] == "const" for x in items) else ("list", items)
    if kind == "filter":
        v, args = fold(e[2]), [fold(x) for x in e[3]]
        new, parts = ("filter", e[1], v, args), [v, *args]
        if e[1] == "escape":
            return new
    elif kind == "test":
        new = ("test", e[1], v := fold(e[2]))
        parts = [v]
    elif kind == "bin":
        parts = [fold(e[2]), fold(e[3])]
        new = ("bin", e[1], *parts)
    else:
        parts = [fold(x) for x in e[1:]]
        new = (kind, *parts)
        if kind == "cond" and parts[0][0] == "const":
            return parts[1] if parts[0][1] else parts[2]
        if kind in ("and", "or") and parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", closure(new, None)({}))
        except (TemplateError, TypeError, ArithmeticError, ValueError):
            return new
    return new


def fold_block(block: list[tuple]) -> list[tuple]:
    """The statements folded: constant output is text, dead branches are gone, neighbouring texts are one."""
    out: list[tuple] = []

    def put(s: tuple) -> None:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)

    for s in block:
        if s[0] == "out":
            e = fold(s[1])
            put(("text", text_of(e[1])) if e[0] == "const" else ("out", e))
        elif s[0] == "for":
            put(("for", s[1], fold(s[2]), fold_block(s[3]), fold_block(s[4])))
        elif s[0] == "set":
            put(("set", s[1], fold(s[2])))
        elif s[0] == "generation":
            put(("generation", fold_block(s[1])))
        elif s[0] == "if":
            arms, other = [], fold_block(s[2])
            for c, body in s[1]:
                c = fold(c)
                if c[0] == "const" and not c[1]:
                    continue
                if c[0] == "const":
                    other = fold_block(body)
                    break
                arms.append((c, fold_block(body)))
            if arms:
                put(("if", arms, other))
            else:
                for x in other:
                    put(x)
        else:
            put(s)
    return out


# ---- closures -----------------------------------------------------------------------------------------------------


class Output:
    """Collects text; `spans` are the code points written between generation markers."""

    def __init__(self):
        self.parts: list[str] = []
        self.n = 0
        self.spans: list[tuple[int, int]] = []
        self.inside = 0

    def write(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.n += len(s)


def closure(e: tuple, escape: Callable[[str], str] | None) -> Callable[[dict], object]:
    """A function from the names in scope to the expression's value."""
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "item":
        of, key = closure(e[1], escape), closure(e[2], escape)

        def item(env):
            o, k = of(env), key(env)
            if isinstance(o, dict):
                return o.get(k, UNDEFINED)
            if isinstance(o, (list, str)) and isinstance(k, int):
                return o[k] if -len(o) <= k < len(o) else UNDEFINED
            return UNDEFINED

        return item
    if kind == "list":
        items = [closure(x, escape) for x in e[1]]
        return lambda env: [f(env) for f in items]
    if kind == "filter":
        v, args = closure(e[2], escape), [closure(x, escape) for x in e[3]]
        if e[1] == "escape":
            return lambda env: escape(text_of(v(env)))
        f = FILTERS[e[1]]
        return (lambda env: f(v(env), *(a(env) for a in args))) if args else (lambda env: f(v(env)))
    if kind == "test":
        t, v = TESTS[e[1]], closure(e[2], escape)
        return lambda env: t(v(env))
    if kind == "bin":
        op, a, b = OPERATORS[e[1]], closure(e[2], escape), closure(e[3], escape)
        return lambda env: op(a(env), b(env))
    a, *rest = (closure(x, escape) for x in e[1:])
    if kind == "not":
        return lambda env: not a(env)
    if kind == "neg":
        return lambda env: -_number(a(env))
    if kind == "and":
        return lambda env: a(env) and rest[0](env)
    if kind == "or":
        return lambda env: a(env) or rest[0](env)
    if kind == "cond":
        return lambda env: rest[0](env) if a(env) else rest[1](env)
    raise TemplateError(kind)


def compile_block(block: list[tuple], escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    """A function that renders the statements with the names in scope."""
    steps = [_compile(s, escape) for s in block]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for f in steps:
            f(env, out)

    return run


def _compile(s: tuple, escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    kind = s[0]
    if kind == "text":
        t = s[1]
        return lambda env, out: out.write(t)
    if kind == "out":
        e = closure(s[1], escape)
        return lambda env, out: out.write(text_of(e(env)))
    if kind == "set":
        name, e = s[1], closure(s[2], escape)

        def assign(env, out):
            env[name] = e(env)

        return assign
    if kind == "generation":
        body = compile_block(s[1], escape)

        def marked(env, out):
            start = out.n
            out.inside += 1
            body(env, out)
            out.inside -= 1
            if not out.inside:
                out.spans.append((start, out.n))

        return marked
    if kind == "if":
        arms, other = [(closure(c, escape), compile_block(b, escape)) for c, b in s[1]], compile_block(s[2], escape)

        def branch(env, out):
            for c, body in arms:
                if c(env):
                    return body(env, out)
            return other(env, out)

        return branch
    names, over, body, other = s[1], closure(s[2], escape), compile_block(s[3], escape), compile_block(s[4], escape)

    def loop(env, out):
        items = over(env)
        if isinstance(items, dict):
            items = list(items)
        if not isinstance(items, list) or not items:
            return other(env, out)
        n = len(items)
        for i, x in enumerate(items):
            own = dict(env)
            if len(names) == 1:
                own[names[0]] = x
            else:
                own.update(zip(names, x, strict=True))
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
            body(own, out)
        return None

    return loop


# ---- formats ------------------------------------------------------------------------------------------------------

#: Turns of a user stand between [INST] and [/INST], an assistant's text ends with </s>, any other role is named.
TEMPLATE = """<s>{% for m in messages %}\
{% if m.role == "user" %}[INST]{{ m.text | escape }}[/INST]\
{% elif m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>\
{% else %}[ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/TEXT]{% endif %}{% endfor %}"""
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TEXT]")


class ChatFormat:
    """A compiled template with its control strings and a reversible escape.

    `\\` becomes `\\\\`, and the first character of a control string inside a text becomes `\\xHH;`, so an escaped
    text holds no control string. No control string may begin inside another or hold an escape's characters first.
    """

    def __init__(self, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS):
        for a in controls:
            if not a or "\\" in a or a[0] in "x0123456789abcdef;" or any(b.startswith(a[i:]) for b in controls for i in range(1, len(a))):
                raise TemplateError(f"{a!r} cannot be a control string here")
        self.controls = controls
        by_length = sorted(map(re.escape, controls), key=len, reverse=True)
        self._control = re.compile("|".join(by_length))
        self._risky = re.compile(rf"\\|(?={'|'.join(by_length)}).", re.DOTALL)
        self.tree = fold_block(parse(template))
        self._render = compile_block(self.tree, self.escape)

    def escape(self, s: str) -> str:
        return self._risky.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\x{ord(m[0]):x};", s)

    @staticmethod
    def unescape(s: str) -> str:
        return re.sub(r"\\(\\|x([0-9a-f]+);)", lambda m: "\\" if m[1] == "\\" else chr(int(m[2], 16)), s)

    def render(self, messages: list[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """(text, loss spans) of a conversation."""
        out = Output()
        self._render({"messages": messages, **names}, out)
        return "".join(out.parts), out.spans

    def split(self, formatted: str) -> list[tuple[str | None, str]]:
        """(control string before it, text as it was) of every stretch between control strings."""
        out, at, last = [], 0, None
        for m in self._control.finditer(formatted):
            out.append((last, self.unescape(formatted[at : m.start()])))
            at, last = m.end(), m.group()
        return [*out, (last, self.unescape(formatted[at:]))]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn, read back from text of the default template."""
        out, role = [], None
        pieces = self.split(formatted)
        for k, (mark, s) in enumerate(pieces):
            following = pieces[k + 1][0] if k + 1 < len(pieces) else None
            if mark == "[INST]":
                out.append(("user", s))
            elif mark == "[ROLE]":
                role = s
            elif mark == "[TEXT]":
                out.append((role, s))
            elif following == "</s>":
                out.append(("assistant", s))
        return out


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): each conversation in the template, with its loss spans in code points.

    Rows are taken by turn (null first), equal turns by role and text, repeated rows as often as they come. Null roles
    and texts count as empty. A row with a null conversation is a conversation by itself. A task holds one
    conversation at a time, as its text is one value of the result.
    """
    compiled = ChatFormat(template, controls)  # errors show here, not on an executor
    del compiled
    bound_arrow(turns.sparkSession)
    rows = pick(turns, [conv, turn, role, text]).toDF("c", "t", "r", "x")
    rows = rows.withColumn("own", F.when(F.col("c").isNull(), F.monotonically_increasing_id()))
    id_type = turns.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt = ChatFormat(template, controls)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = None
        now, held, done, size = None, [], [], 0

        def finish():
            if held:
                s, spans = fmt.render(held)
                done.append((now[0], s, [{"start": a, "end": b} for a, b in spans]))
                return len(s)
            return 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], span)], names=["conv_id", "formatted", "spans"])

        for b in batches:
            schema = b.schema.field(0).type
            for c, _, r, x, own in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (c, own) != now:
                    size += finish()
                    now, held = (c, own), []
                    if size > 4 << 20:
                        yield flush()
                        done.clear()
                        size = 0
                held.append({"role": r or "", "text": x or ""})
        finish()
        if done:
            yield flush()

    ordered = rows.repartition("c", "own").sortWithinPartitions("c", "own", "t", "r", "x")
    return ordered.mapInArrow(run, f"conv_id {id_type}, formatted string, spans array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    bound_arrow(formatted.sparkSession)
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt = ChatFormat(template, controls)
        for b in batches:
            texts, turns, loss = b.column(1).to_pylist(), [], []
            for s, spans in zip(texts, b.column(2).to_pylist(), strict=True):
                turns.append(fmt.turns(s))
                loss.append("".join(fmt.unescape(s[x["start"] : x["end"]]) for x in spans))
            sha = [hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode("utf-8", "surrogatepass")).hexdigest() for t in turns]
            cols = [b.column(0), pa.array(map(len, turns), pa.int64()), pa.array(sha, pa.string()), pa.array(map(len, loss), pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in loss], pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
