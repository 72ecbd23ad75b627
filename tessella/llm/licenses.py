"""Licence scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

A text's words are its runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond
ASCII.  One automaton finds all notice phrases, and the phrase of the SPDX tag, in one pass over the
words.  Where that tag is found, the expression after `SPDX-License-Identifier:` on the same line is
parsed as far as it is well formed; `with` binds closest, then `and`, then `or`.

Nothing shuffles; memory follows the longest text.  Defined cases: a null text is empty; a text without
matches has empty labels, null positions and score 0; an expression that is not well formed gives no
labels; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Notice phrases and what they stand for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software": "unlicense",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How free an expression leaves its user, by the first part of an identifier; others count as UNKNOWN.
FREEDOM = {"mit": 1.0, "isc": 1.0, "0bsd": 1.0, "cc0": 1.0, "unlicense": 1.0, "apache": 1.0, "bsd": 1.0, "bsl": 1.0, "zlib": 1.0, "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "gpl": 0.3, "agpl": 0.2}
UNKNOWN = 0.5
#: How sure a tag and a notice phrase make us, each distinct one by itself.
TAG_WEIGHT, PHRASE_WEIGHT = 0.9, 0.6

_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" or c > 127 else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def tokens(line: str) -> list[str]:
    """Tokens of the longest start of line that is an expression: what follows the last place where no operand and no parenthesis is due is left out."""
    found: list[str] = []
    depth, at, whole, operand = 0, 0, 0, True  # operand: one is due; whole: tokens of the expression so far
    while m := _TOKEN.match(line, at):
        token = m[1]
        word = token.lower()
        if operand and token == "(":
            depth += 1
        elif operand and token != ")" and word not in PRECEDENCE:
            operand = False
            token = token.rstrip(".:-") or token
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and word in PRECEDENCE:
            operand, token = True, word
        else:
            break
        found.append(token)
        at = m.end()
        if not operand and not depth:
            whole = len(found)
    return found[:whole]


def postfix(expression: Sequence[str]) -> list[str] | None:
    """Shunting-yard: the tokens in postfix order; None if parentheses don't match."""
    out: list[str] = []
    stack: list[str] = []
    for token in expression:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    while stack:
        if (token := stack.pop()) == "(":
            return None
        out.append(token)
    return out


def evaluate(rpn: Sequence[str]) -> tuple[list[str], float]:
    """Identifiers (lower case) of licences and exceptions, and the freedom that the expression leaves: or gives the freer side, and the stricter, an exception half of what is missing."""
    labels: list[str] = []
    stack: list[float] = []
    for token in rpn:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "or" else min(left, right) if token == "and" else left + (1 - left) / 2)
        else:
            label = token.lower()
            labels.append(label)
            stack.append(FREEDOM.get(label.split("-")[0], UNKNOWN))
    return labels, stack[0] if stack else UNKNOWN


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG}:
        found.add_word(f" {phrase} ", (len(phrase.split()), base.get(phrase), notices.get(phrase), phrase == TAG))
    found.make_automaton()
    return found


def scan(text: str, machine: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, expressions."""
    words = text.encode().translate(_WORDS).split()
    n_base, first, last, spaces, at, tagged = 0, None, None, 0, 0, False
    base: set[str] = set()
    more: set[str] = set()
    joined = f" {b' '.join(words).decode('latin-1')} "
    for end, (n, own, notice, is_tag) in machine.iter(joined):
        spaces += joined.count(" ", at, end + 1)
        at = end + 1
        if own is not None:
            start = spaces - 1 - n
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(own)
        if notice is not None:
            more.add(notice)
        tagged |= is_tag
    expressions: list[str] = []
    freedom: float | None = None
    tags: set[str] = set()
    for m in _TAG.finditer(text) if tagged else ():
        expression = tokens(m[1])
        rpn = postfix(expression)
        if rpn:
            labels, value = evaluate(rpn)
            tags.update(labels)
            freedom = value if freedom is None else min(freedom, value)
            expressions.append(" ".join(expression))
    labels = base | more | tags
    if labels and freedom is None:
        freedom = min(FREEDOM.get(x, UNKNOWN) for x in labels)
    score = 1 - (1 - PHRASE_WEIGHT) ** len(base | more) * (1 - TAG_WEIGHT) ** len(expressions)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, freedom, sorted(set(expressions))


_FIELDS = (("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("freedom", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>"))


def _scan_batches(batches: Iterator[pa.RecordBatch], base: dict[str, str], notices: dict[str, str]) -> Iterator[pa.RecordBatch]:
    machine = automaton(base, notices)
    for batch in batches:
        rows = [scan(text.as_py() or "", machine) for text in batch.column("text")]
        columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, kind) for c, (_, kind, _) in zip(columns, _FIELDS, strict=True))], names=["id", *(name for name, _, _ in _FIELDS)])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, expressions), one row per row of docs."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = ", ".join([f"id {texts.schema['id'].dataType.simpleString()}", *(f"{name} {kind}" for name, _, kind in _FIELDS)])
    return texts.mapInArrow(partial(_scan_batches, base=base, notices=notices), schema)
