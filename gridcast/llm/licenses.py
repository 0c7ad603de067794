"""License scans: Aho-Corasick over words finds notices and identifier tags, a shunting-yard parser reads expressions.

Words are maximal runs of digits, lower-cased ASCII letters and characters
beyond ASCII. Notice phrases match where their words stand consecutively; the
whole text is scanned once by one automaton over the word-normalised bytes.
A tag (``SPDX-License-Identifier:``) is followed by an expression of licence
names joined by AND, OR and WITH; a small shunting-yard parser turns it into
postfix order and evaluates it to the set of names it mentions and to whether
some choice of it is permissive. Malformed expressions count by their names.

Edge cases: a null text is an empty one (no words, score 0); repeated rows give
repeated results; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gridcast.llm.common import byte_texts, words_of

# The notice phrases asked for and the label of each.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, in words as they stand in common licence texts.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_IN_TEXT = re.compile(rb"(?i)spdx[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+identifier[\x00-\x09\x0b-\x20:=\"']*")
TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+\-]+")
#: Restrictive families by the start of the name; every other name counts as permissive.
RESTRICTIVE = ("gpl", "lgpl", "agpl", "cc-by-nc", "cc-by-nd", "cc-by-sa", "all-rights-reserved", "sspl", "busl", "proprietary")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "n_tags long, permissive boolean, score double"
)


def postfix(expression: bytes) -> list[str] | None:
    """Names and operators of a licence expression in postfix order; None if it isn't well formed.

    The expression ends at the first token that can't continue it, so prose
    after a tag is left out.
    """
    out: list[str] = []
    waiting: list[str] = []
    name_next = True
    depth = 0
    for match in TOKEN.finditer(expression):
        token = match.group().decode().lower()
        if token == "(" and name_next:
            waiting.append(token)
            depth += 1
        elif token == ")" and not name_next and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif token in PRECEDENCE and not name_next:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            name_next = True
        elif name_next and token not in PRECEDENCE and token not in "()":
            out.append(token)
            name_next = False
        else:
            break
    if name_next or depth:
        return None
    return out + waiting[::-1]


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """Names mentioned, and whether the reader may choose permissive terms only.

    OR offers a choice, AND binds to both sides, WITH adds an exception, which
    keeps the terms of its left side and is labelled after it.
    """
    stack: list[tuple[set[str], bool, str]] = []
    for token in order:
        if token in PRECEDENCE:
            (right, free_r, name_r), (left, free_l, name_l) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left | {f"{name_l}-with-{name_r}"}, free_l, name_l))
            else:
                free = free_l or free_r if token == "or" else free_l and free_r
                stack.append((left | right, free, ""))
        else:
            stack.append(({token}, not token.startswith(RESTRICTIVE), token))
    names, free, _ = stack[0]
    return names, free


def automaton(phrases) -> ahocorasick.Automaton:
    """Phrases bounded by single spaces, so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: bytes | None, phrases: ahocorasick.Automaton) -> tuple:
    """One result row without its doc_id."""
    words = words_of(text)
    if not words:
        return 0, 0, None, None, "", "", 0, None, 0.0
    # Latin-1 keeps one character a byte, so positions in the joined words stay byte positions.
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    tags = 0
    at, seen = 0, 0
    for end, phrase in phrases.iter(joined):
        if phrase == TAG:
            tags += 1
        elif phrase in BASE:
            start = end - len(phrase) - 1
            # Matches come in order of their ends; a later one may start a few words earlier.
            seen = seen + joined.count(" ", at, start) if start >= at else joined.count(" ", 0, start)
            at = start
            base.append((seen, BASE[phrase]))
        else:
            labels.add(NOTICES[phrase])
    base_labels = {label for _, label in base}
    permissive: bool | None = None
    if tags:
        found = list(TAG_IN_TEXT.finditer(text))
        # An expression ends at the next tag or at the end of its line.
        for match, until in zip(found, [*(m.start() for m in found[1:]), len(text)]):
            expression = text[match.end() : until].split(b"\n", 1)[0]
            order = postfix(expression)
            if order is None:
                labels.update(t.decode().lower() for t in TOKEN.findall(expression)[:1] if t not in b"()")
            else:
                names, free = evaluate(order)
                labels |= names
                permissive = free if permissive is None else permissive and free
    labels |= base_labels
    if permissive is None and labels:
        permissive = not any(label.startswith(RESTRICTIVE) for label in labels)
    # A tag or a notice is near certain evidence; each further piece halves what doubt is left.
    pieces = len(base) + tags + len(labels - base_labels)
    places = [word for word, _ in base]
    return (
        len(words),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        tags,
        permissive,
        1.0 - 0.5 ** min(pieces, 50),
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: places and labels of the base phrases, all labels, tags, and a score from 0 to 1."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton([*BASE, *NOTICES, TAG])
        for batch in batches:
            rows = [scan_text(t, phrases) for t in byte_texts(batch, "text")]
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.bool_(), pa.float64()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    read = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return read.mapInArrow(per_batch, RESULT)
