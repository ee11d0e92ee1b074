"""Operator 9, licence scans: Aho-Corasick phrases and licence expressions.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII
characters.  One Aho-Corasick pass over the words joined by spaces finds the
notice phrases; where it meets an identifier tag, a second pass over the raw
text finds the tags' places and a shunting-yard parser evaluates the
and/or/with expression up to the end of the line.  What it evaluates to is
part of the result: ``binding`` are the labels that bind whichever alternative
is chosen (``and`` binds both sides, ``or`` what both have, ``with`` its
licence), ``expressions`` the evaluated expressions in a normal form (operands
sorted, repeats left out, exceptions kept), so "MIT OR GPL-2.0" and "MIT AND
GPL-2.0" differ in both.

``score`` is 1 - prod(1 - weight) over the distinct kinds of evidence in the
document (each phrase, each tagged licence), so it is 0 without any.

Defined cases: a null text is an empty one (0 words, no labels, score 0);
overlapping phrases all count; an expression that does not parse gives the
labels of its identifiers but no weight as a tag; repeated rows give repeated
results; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_columns, whole_text

#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
        "mit license": "mit"}
#: Further notices, the method's own.
NOTICES = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
           "mozilla public license": "mpl", "bsd license": "bsd", "cc0": "cc0",
           "creative commons attribution": "cc-by", "isc license": "isc",
           "eclipse public license": "epl", "permission is hereby granted free of charge": "mit",
           "redistribution and use in source and binary forms": "bsd", "all rights reserved": "reserved"}
#: Identifier tags, as words and as raw text.
TAGS = {"spdx license identifier": "spdx-license-identifier:"}
#: Identifier prefixes of expressions -> label; the longest that fits counts.
FAMILIES = ["agpl", "apache", "bsd", "cc-by", "cc0", "epl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense"]

BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT = 0.8, 0.6, 0.95

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """Label of an identifier; one of no known family is its own label."""
    fits = [f for f in FAMILIES if identifier.startswith(f)]
    return max(fits, key=len) if fits else identifier.rstrip("+")


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operators by precedence, left-associative; None when the
    tokens are no expression."""
    out, stack, operand = [], [], False
    for t in tokens:
        if t in _PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[frozenset, frozenset, str]:
    """(labels of all licences named, labels that bind whatever is chosen,
    normal form)."""
    stack = []
    for t in postfix:
        if t not in _PRECEDENCE:
            one = frozenset([family(t)])
            stack.append((one, one, None, frozenset([family(t)])))
            continue
        (right, r, rop, rparts), (left, m, lop, lparts) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left, m, None, frozenset([f"{_form(lop, lparts, True)} WITH {_form(rop, rparts, True)}"])))
            continue
        # operands of the same operator join one set, in any order and once
        parts = [p if op in (t, None) else frozenset([_form(op, p, True)]) for op, p in ((lop, lparts), (rop, rparts))]
        both = parts[0] | parts[1]
        stack.append((left | right, m | r if t == "and" else m & r, t if len(both) > 1 else None, both))
    labels, binds, op, parts = stack[0]
    return labels, binds, _form(op, parts, False)


def _form(op: str | None, parts: frozenset, inside: bool) -> str:
    text = f" {op.upper()} ".join(sorted(parts)) if op else next(iter(parts))
    return f"({text})" if inside and op else text


def expression(line: str) -> tuple[frozenset, frozenset, str | None]:
    """(labels, labels that bind, normal form); the form is None where the line
    holds no expression.  What follows an expression on its line, such as a
    comment's end, is not part of it."""
    tokens = _TOKEN.findall(line.lower())
    whole = tokens
    while whole and (post := to_postfix(whole)) is None:
        whole = whole[:-1]
    if whole:
        return evaluate(post)
    return frozenset(family(t) for t in tokens[:1] if t not in _PRECEDENCE and t not in "()"), frozenset(), None


@functools.lru_cache(1)
def automata():
    import ahocorasick
    phrases = ahocorasick.Automaton()
    for kind, names in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for p, label in names.items():
            phrases.add_word(f" {p} ", (kind, label, len(p) + 2))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for t in TAGS.values():
        tags.add_word(t, t)
    tags.make_automaton()
    return phrases, tags


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score,
    binding, expressions)."""
    phrases, tags = automata()
    words = text.encode("utf-8").translate(_LOWER).split()
    norm = f" {b' '.join(words).decode('utf-8')} "
    found, evidence, tagged = [], {}, False
    for end, (kind, label, n) in phrases.iter(norm):
        if kind == "base":
            found.append((end - n + 1, label))
            evidence["base", label] = BASE_WEIGHT
        elif kind == "notice":
            evidence["notice", label] = NOTICE_WEIGHT
        else:
            tagged = True
    first = last = None
    if found:
        found.sort()
        first = norm.count(" ", 0, found[0][0] + 1) - 1
        last = first + norm.count(" ", found[0][0] + 1, found[-1][0] + 1)
    binding, forms = set(), set()
    if tagged:
        low = text.lower()
        for end, _ in tags.iter(low):
            stop = low.find("\n", end)
            labels, binds, form = expression(low[end + 1:stop if stop >= 0 else len(low)])
            if form is not None:
                binding |= binds
                forms.add(form)
            for label in labels:
                key = "tag", label
                evidence[key] = max(evidence.get(key, 0.0), TAG_WEIGHT if form is not None else 0.0)
    miss = 1.0
    for key in sorted(evidence):
        miss *= 1 - evidence[key]
    base = {label for _, label in found}
    every = base | {label for _, label in evidence}
    return (len(words), len(found), first, last, ",".join(sorted(base)), ",".join(sorted(every)),
            round(1 - miss, 9), ",".join(sorted(binding)), "; ".join(sorted(forms)))


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, binding string, expressions string")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; a map over rows, no shuffle."""
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def run(rows):
        found = [scan(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], **{n: [f[i] for f in found] for i, n in enumerate(names)}}
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_columns(picked, run, SCHEMA)
