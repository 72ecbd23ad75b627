"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
yield a conversation's text piece by piece, each piece with its mark whether it is to be learnt from.
The language is sandboxed: a name is a variable of the conversation, `a.b` a field of a mapping, and
there are no calls, no Python attributes and no names with underscores at their start.

    {{ expr }}   {% for x in expr %}..{% endfor %}   {% if expr %}..{% elif expr %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}             expr: 'text', 12, true, false, none, a.b, not, and, or, ==, !=, +, |escape, |trim

`escape` makes control strings inside texts harmless and can be undone: after the first character of a
control string (and after any backslashes that follow it there) it puts one more backslash.

Rows are brought together by conversation and sorted by turn in Spark, then streamed: a task holds one
turn and one chunk of output at a time, never a conversation, whatever its length.  The text under the
loss mask is that of the `generation` blocks; its places are code points in the chunk.

Defined cases: null texts and roles are empty; turns of one conversation with equal numbers are sorted by
role and text; a null turn comes first; a null conversation id is a conversation; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Control strings: each begins with < or [ and has neither of them, nor a backslash, after that.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}{{ '[INST]' + ' ' }}{{ m.role | escape }}{{ ' ' + '[/INST]' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}{% endfor %}"
)
#: Code points after which a chunk of output is closed.
CHUNK = 1 << 20

Piece = tuple[str, bool]
Render = Callable[[dict], Iterator[Piece]]


# ---- escaping

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda _: "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip}


# ---- template to syntax tree

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_EXPR = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z][A-Za-z0-9_]*)|(==|!=|[+|.()]))")
_LITERALS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes are tuples: (const, v), (name, n), (field, e, n), (filter, e, n), (not, e), (and|or|==|!=|+, e, e)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _EXPR.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            if m[1] is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1])))
            elif m[2] is not None:
                self.tokens.append(("const", int(m[2])))
            elif m[3] is not None:
                self.tokens.append(("const", _LITERALS[m[3]]) if m[3] in _LITERALS else ("word", m[3]))
            else:
                self.tokens.append(("sign", m[4]))
            at = m.end()
        self.at = 0

    def _take(self, *tokens: tuple[str, object]) -> object | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in tokens:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return str(self.tokens[self.at - 1][1])

    def parse(self) -> tuple:
        node = self._either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _either(self) -> tuple:
        node = self._both()
        while self._take(("word", "or")):
            node = ("or", node, self._both())
        return node

    def _both(self) -> tuple:
        node = self._negated()
        while self._take(("word", "and")):
            node = ("and", node, self._negated())
        return node

    def _negated(self) -> tuple:
        return ("not", self._negated()) if self._take(("word", "not")) else self._compared()

    def _compared(self) -> tuple:
        node = self._sum()
        if sign := self._take(("sign", "=="), ("sign", "!=")):
            node = (sign, node, self._sum())
        return node

    def _sum(self) -> tuple:
        node = self._filtered()
        while self._take(("sign", "+")):
            node = ("+", node, self._filtered())
        return node

    def _filtered(self) -> tuple:
        node = self._field()
        while self._take(("sign", "|")):
            if (name := self._name()) not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", node, name)
        return node

    def _field(self) -> tuple:
        if self._take(("sign", "(")):
            node = self._either()
            if not self._take(("sign", ")")):
                raise TemplateError(") is missing")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            node = self.tokens[self.at]
            self.at += 1
        else:
            node = ("name", self._name())
        while self._take(("sign", ".")):
            node = ("field", node, self._name())
        return node


def parse(template: str) -> list[tuple]:
    """Nodes: (text, s), (out, e), (for, name, e, body), (if, [(e, body)..]), (generation, body)."""
    root: list[tuple] = []
    stack: list[tuple[str, list, list[tuple]]] = [("", [], root)]  # tag, its data, the open body
    at = 0
    for m in _TAGS.finditer(template):
        body = stack[-1][2]
        if m.start() > at:
            body.append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", _Expression(m[1]).parse()))
            continue
        tag, _, rest = m[2].strip().partition(" ")
        if tag == "for":
            if not (parts := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                raise TemplateError(f"for {rest}")
            stack.append(("for", [parts[1], _Expression(parts[2]).parse()], []))
        elif tag == "if":
            stack.append(("if", [[_Expression(rest).parse(), None]], []))
        elif tag in ("elif", "else") and stack[-1][0] == "if":
            _, arms, done = stack.pop()
            arms[-1][1] = done
            stack.append(("if", [*arms, [_Expression(rest).parse() if tag == "elif" else ("const", True), None]], []))
        elif tag == "generation":
            stack.append(("generation", [], []))
        elif tag.startswith("end") and len(stack) > 1 and tag == f"end{stack[-1][0]}":
            kind, data, done = stack.pop()
            if kind == "for":
                stack[-1][2].append(("for", *data, done))
            elif kind == "if":
                data[-1][1] = done
                stack[-1][2].append(("if", [tuple(arm) for arm in data]))
            else:
                stack[-1][2].append(("generation", done))
        else:
            raise TemplateError(f"unexpected {tag}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    if at < len(template):
        root.append(("text", template[at:]))
    return root


# ---- folding

def _string(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(kind: str, *values: object) -> object:
    if kind == "not":
        return not values[0]
    if kind == "==":
        return values[0] == values[1]
    if kind == "!=":
        return values[0] != values[1]
    return values[0] + values[1] if all(isinstance(v, int) for v in values) else _string(values[0]) + _string(values[1])


def fold(node: tuple) -> tuple:
    """The expression with its constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return (kind, fold(node[1]), node[2])
    if kind == "filter":
        inner = fold(node[1])
        return ("const", FILTERS[node[2]](_string(inner[1]))) if inner[0] == "const" else (kind, inner, node[2])
    parts = [fold(x) for x in node[1:]]
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        return (kind, *parts)
    if all(p[0] == "const" for p in parts):
        return ("const", _apply(kind, *(p[1] for p in parts)))
    return (kind, *parts)


def fold_body(body: list[tuple]) -> list[tuple]:
    """The body with constant output as text, neighbouring texts as one, and only the arms that can be reached."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            expression = fold(node[1])
            add(("text", _string(expression[1])) if expression[0] == "const" else ("out", expression))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif node[0] == "generation":
            add(("generation", fold_body(node[1])))
        elif node[0] == "if":
            arms = []
            for condition, arm in node[1]:
                condition = fold(condition)
                if condition[0] == "const" and not condition[1]:
                    continue
                arms.append((condition, fold_body(arm)))
                if condition[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    add(inner)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


# ---- closures

def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "field":
        inner, name = _value(node[1]), node[2]

        def field(env: dict) -> object:
            found = inner(env)
            return found.get(name) if isinstance(found, Mapping) else None

        return field
    if kind == "filter":
        inner, change = _value(node[1]), FILTERS[node[2]]
        return lambda env: change(_string(inner(env)))
    parts = [_value(x) for x in node[1:]]
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env: _apply(kind, *(p(env) for p in parts))


def _text(text: str, marked: bool) -> Render:
    piece = (text, marked)

    def render(_: dict) -> Iterator[Piece]:
        yield piece

    return render


def _out(node: tuple, marked: bool) -> Render:
    value = _value(node)

    def render(env: dict) -> Iterator[Piece]:
        yield _string(value(env)), marked

    return render


def _for(name: str, over: tuple, body: Render) -> Render:
    items = _value(over)

    def render(env: dict) -> Iterator[Piece]:
        for k, item in enumerate(items(env) or ()):
            yield from body(env | {name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0}})

    return render


def _if(arms: list[tuple[tuple, Render]]) -> Render:
    tests = [(_value(condition), body) for condition, body in arms]

    def render(env: dict) -> Iterator[Piece]:
        for test, body in tests:
            if test(env):
                yield from body(env)
                return

    return render


def _body(body: list[tuple], marked: bool) -> Render:
    makers: list[Render] = []
    for node in body:
        if node[0] == "text":
            makers.append(_text(node[1], marked))
        elif node[0] == "out":
            makers.append(_out(node[1], marked))
        elif node[0] == "for":
            makers.append(_for(node[1], node[2], _body(node[3], marked)))
        elif node[0] == "if":
            makers.append(_if([(condition, _body(arm, marked)) for condition, arm in node[1]]))
        else:
            makers.append(_body(node[1], True))

    def render(env: dict) -> Iterator[Piece]:
        for make in makers:
            yield from make(env)

    return render


def compile_template(template: str) -> Callable[[Iterable[Mapping[str, str]]], Iterator[Piece]]:
    """A function from messages (role, text) to pieces (text, whether it is under the loss mask)."""
    render = _body(fold_body(parse(template)), False)
    return lambda messages: render({"messages": messages})


# ---- in Spark

def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, str]]]:
    for batch in batches:
        for conv, role, text in zip(batch.column("conv").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
            yield conv, {"role": role.as_py() or "", "text": text.as_py() or ""}


def _format(batches: Iterator[pa.RecordBatch], template: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    render = compile_template(template)
    rows: list[tuple] = []
    held = 0
    for conv, turns in groupby(_turns(batches), key=lambda x: x[0]):
        parts: list[str] = []
        spans: list[dict[str, int]] = []
        length, chunk = 0, 0
        for text, marked in render(turn for _, turn in turns):
            if marked and text:
                spans.append({"begin": length, "end": length + len(text)})
            parts.append(text)
            length += len(text)
            if length >= CHUNK:
                rows.append((conv, chunk, "".join(parts), spans))
                parts, spans, length, chunk = [], [], 0, chunk + 1
                yield _chunk_batch(rows, kind)
                rows, held = [], 0
        if length or not chunk:
            rows.append((conv, chunk, "".join(parts), spans))
            held += length
        if held >= CHUNK or len(rows) >= 10_000:
            yield _chunk_batch(rows, kind)
            rows, held = [], 0
    if rows:
        yield _chunk_batch(rows, kind)


def _chunk_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, chunk, text, spans = zip(*rows, strict=True)
    loss = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(chunk, pa.int64()), pa.array(text, pa.string()), pa.array(spans, loss)], names=["conv", "chunk", "text", "loss"])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(conv, chunk, text, loss): each conversation's formatted text in chunks, in order within a partition; loss has the places in the chunk to learn from."""
    turns = rows.select(rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text"))
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = turns.schema["conv"].dataType
    return ordered.mapInArrow(partial(_format, template=template, kind=to_arrow_type(kind)), f"conv {kind.simpleString()}, chunk long, text string, loss array<struct<begin:long,end:long>>")


_TURN = re.compile(r"\[INST\] (.*?) \[/INST\](.*)", re.DOTALL)


def _read_back(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column("conv").to_pylist(), batch.column("text"), batch.column("loss"), strict=True)

    rows: list[tuple] = []
    for conv, group in groupby(chunks(), key=lambda x: x[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = formatted = 0
        rest = ""
        for _, text, spans in group:
            text = text.as_py()
            if not formatted:
                if not text.startswith("<s>"):
                    raise ValueError("a conversation begins with <s>")
            body = text if formatted else text[len("<s>") :]
            formatted += len(text)
            *ended, rest = (rest + body).split("</s>")
            for turn in ended:
                m = _TURN.fullmatch(turn)
                if m is None:
                    raise ValueError("a turn is not marked")
                n_turns += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for span in spans.as_py():
                part = unescape(text[span["begin"] : span["end"]])
                loss_chars += len(part)
                loss.update(part.encode())
        if rest:
            raise ValueError("a turn is not ended")
        rows.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))
        if len(rows) >= 10_000:
            yield _read_batch(rows, kind)
            rows = []
    yield _read_batch(rows, kind)


def _read_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_chats(formatted: DataFrame) -> DataFrame:
    """Of format_chats(): (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted text.  Reads the chunks in the order in which they were made, so nothing shuffles."""
    kind = formatted.schema["conv"].dataType
    return formatted.mapInArrow(partial(_read_back, kind=to_arrow_type(kind)), f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
