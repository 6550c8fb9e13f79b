"""Secrets: fixed patterns, and an assignment-aware lexer with constant propagation.

The patterns give the base spans. The lexer reads source and configuration syntax into
name-literal pairs: assignments (``=``, ``:``, ``:=``, ``=>``, ``+=``, chains; comparisons are none),
targets that are plain, quoted or indices, types between a name and its value, strings
with prefixes and in triple quotes, unquoted values, literals in calls, blocks below a key,
elements and key-value attributes. Names and ``+`` joins carry literals on, by reference,
and the literals that reach a name which says that it holds a secret are added (kind
``literal``: the literal's content): those of ``LEAST`` characters and ``DIFFERENT`` different
ones at least that stand for no placeholder, and where unquoted have a digit or a capital
inside. Time and memory follow the text's length.

Defined results: null and empty texts have no spans; offsets are code points, the end is
exclusive; a value ends at its line's end, but for triple quotes and blocks; a name means
what was last assigned to it before, wherever that was; a text is read whole; rows that
repeat a doc_id are scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pairsight.llm.common import frugal, texts

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
OPERATOR = re.compile(r"===?|!==?|<=|>=|\+=|:=|=>|=~|::|[:=]")
COMPARING = frozenset(("==", "===", "!=", "!==", "<=", ">=", "=~", "::"))
NAME_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
BLANKS = re.compile(r"[ \t]*")
STRING = re.compile(r"""[A-Za-z@$]{0,2}(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*)\"\"\"|\'\'\'((?:[^'\\]|\\.|'(?!''))*)\'\'\'|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)""", re.S)
NAME = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z0-9_$]+)*)\}?")
BARE = re.compile(r"[A-Za-z0-9+/_.~$\-]+={0,2}(?![A-Za-z0-9+/_.~$\-])|[A-Za-z0-9+/_.~$\-]+")
#: What may stand between a name and its value: a type.
ANNOTATION = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:[<\[][\w., <>\[\]|]{0,60}[>\]])?[ \t]+=[ \t]+")
BLOCK = re.compile(r"[ \t]*[|>][+\-]?[0-9]?[ \t]*\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:[ \t\n][^<>]*)?>[ \t\n]*([^<>\n]*[^<>\s])[ \t\n]*</")
ATTRIBUTES = re.compile(r"""\b(?:key|name)[ \t]*=[ \t]*["']([^"'\n]*)["'][ \t]+value[ \t]*=[ \t]*["']([^"'\n]*)["']""", re.I)
#: Parts of names whose values are secrets, and values that stand for none.
SENSITIVE = re.compile(r"passw|passwd|pwd|passphrase|secret|token|api[_.\-]?key|access[_.\-]?key|private[_.\-]?key|auth[_.\-]?key|credential|signing[_.\-]?key|encryption[_.\-]?key", re.I | re.A)
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|changeme|change_me|example|password|secret|none|null|true|false|todo|your[_\- ].*)$", re.I | re.A)
#: A value has so many characters, of which so many different, at least.
LEAST, DIFFERENT = 8, 4

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def target_before(text: str, at: int, floor: int) -> str:
    """The name that ends before the operator at ``at``, plain, quoted or an index in quotes; empty if there is none after ``floor`` on the line."""
    while at > floor and text[at - 1] in " \t?":
        at -= 1
    if at > floor and text[at - 1] == "]":
        at -= 1
    quote = text[at - 1] if at > floor else ""
    if quote and quote in "\"'`":
        start = text.rfind(quote, floor, at - 1)
        name = text[start + 1 : at - 1] if start >= 0 else ""
        return "" if "\n" in name else name
    start = at
    while start > floor and text[start - 1] in NAME_CHAR:
        start -= 1
    return text[start:at].lstrip("-.$0123456789")


class Values:
    """Literals and joins of them, each held once: a join refers to its parts, so work and memory follow the text's length.

    A value's length, its kinds of characters and its different characters (a set of bits) are summed up from its parts.
    """

    def __init__(self, text: str):
        self.text = text
        self.parts: list[tuple[int, ...]] = []
        self.span: list[tuple[int, int]] = []
        self.sums: list[tuple[int, bool, bool, bool, int]] = []  # length, quoted, digit, upper after lower, different

    def literal(self, start: int, end: int, quoted: bool) -> int:
        body = self.text[start:end]
        bits = 0
        for c in set(body):
            bits |= 1 << (ord(c) & 127)
        inner = any(x.islower() and y.isupper() for x, y in itertools.pairwise(body))
        return self.put((), (start, end), (len(body), quoted, any(map(str.isdigit, body)), inner, bits))

    def put(self, parts: tuple[int, ...], span: tuple[int, int], sums: tuple) -> int:
        self.parts.append(parts)
        self.span.append(span)
        self.sums.append(sums)
        return len(self.parts) - 1

    def join(self, parts: list[int]) -> int:
        if len(parts) == 1:
            return parts[0]
        length, quoted, digit, inner, bits = zip(*(self.sums[p] for p in parts))
        every = 0
        for x in bits:
            every |= x
        return self.put(tuple(parts), (0, 0), (min(sum(length), 1 << 40), any(quoted), any(digit), any(inner), every))

    def secret(self, value: int) -> bool:
        """Whether a value under a sensitive name looks like a secret; quoted ones need no digit."""
        length, quoted, digit, inner, bits = self.sums[value]
        if length < LEAST or bits.bit_count() < DIFFERENT or (not self.parts[value] and PLACEHOLDER.match(self.text, *self.span[value])):
            return False
        return quoted or digit or (inner and length >= LEAST + 2)

    def places(self, values: set[int]) -> set[Span]:
        """The literals that these values are made of."""
        found: set[Span] = set()
        left, seen = list(values), set(values)
        while left:
            at = left.pop()
            start, end = self.span[at]
            if end > start:
                found.add((start, 3, end))
            for part in self.parts[at]:
                if part not in seen:
                    seen.add(part)
                    left.append(part)
        return found


class Scanner:
    """Reads name-literal pairs of a text from left to right; what is read as a value, but for the inside of strings, is not read again."""

    def __init__(self, text: str):
        self.text, self.values = text, Values(text)
        self.known: dict[str, int] = {}
        self.wanted: set[int] = set()

    def string(self, at: int) -> tuple[int, int, int] | None:
        """(content's start and end, end) of the string literal here."""
        found = STRING.match(self.text, at)
        return (*found.span(found.lastindex), found.end()) if found else None

    def call(self, at: int) -> tuple[list[int], int]:
        """The string literals between a call's parentheses, on one line; ``at`` is after the opening one."""
        parts, depth, text = [], 1, self.text
        while at < len(text) and depth and text[at] != "\n":
            found = self.string(at) if text[at] in "\"'`" else None
            if found:
                parts.append(self.values.literal(found[0], found[1], True))
                at = found[2]
                continue
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        return parts, at

    def expression(self, at: int) -> tuple[list[int], int, bool]:
        """The values joined here, where to read on, and whether this is the name of another assignment."""
        text, parts, inside = self.text, [], -1
        while True:
            at = BLANKS.match(text, at).end()
            found = self.string(at)
            if found:
                parts.append(self.values.literal(found[0], found[1], True))
                inside, at = (found[0] if inside < 0 else inside), found[2]
            else:
                name = NAME.match(text, at)
                after = BLANKS.match(text, name.end()).end() if name else at
                follows = text[after : after + 1]
                if name and follows == "=" and text[after + 1 : after + 2] not in ("=", ">", "~", "") and not parts:
                    return [], at, True
                if name and follows == "(":
                    more, at = self.call(after + 1)
                    parts += more
                elif name and (name[1] in self.known or (follows == "+" and text[BLANKS.match(text, after + 1).end() :][:1] in ("'", '"', "`"))):
                    if name[1] in self.known:
                        parts.append(self.known[name[1]])
                    at = name.end()
                else:
                    bare = BARE.match(text, at)
                    if not bare:
                        break
                    if name is None or bare.end() > name.end() or any(map(str.isdigit, bare[0])) or any(x.islower() and y.isupper() for x, y in itertools.pairwise(bare[0])):
                        parts.append(self.values.literal(*bare.span(), False))
                    at = bare.end()
            plus = BLANKS.match(text, at).end()
            if text[plus : plus + 1] != "+" or text[plus + 1 : plus + 2] == "=":
                break
            at = plus + 1
        return parts, (inside if inside >= 0 else at), False

    def block(self, at: int, line: int) -> tuple[list[int], int]:
        """The lines below that are further in than the line that begins at ``line``."""
        text, parts = self.text, []
        margin = BLANKS.match(text, line).end() - line
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            start = BLANKS.match(text, at).end()
            if start < end:
                if start - at <= margin:
                    break
                parts.append(self.values.literal(start, len(text[start:end].rstrip()) + start, True))
            at = end + 1
        return parts, min(at, len(text))

    def bind(self, names: list[str], parts: list[int], more: bool) -> None:
        value = self.values.join(parts)
        for name in names:
            own = self.values.join([self.known[name], value]) if more and name in self.known else value
            self.known[name] = own
            if own not in self.wanted and SENSITIVE.search(name) and self.values.secret(own):
                self.wanted.add(own)

    def spans(self) -> list[Span]:
        text, at, line, names = self.text, 0, 0, []
        while found := OPERATOR.search(text, at):
            op, floor, at = found[0], at, found.end()
            name = target_before(text, found.start(), floor) if op not in COMPARING else ""
            if not name:
                names = []
                continue
            names.append(name)
            if op == ":":
                line = max(line, text.rfind("\n", line, found.start()) + 1)
                if below := BLOCK.match(text, at):
                    parts, _ = self.block(below.end(), line)
                    at = below.end()
                    if parts:
                        self.bind(names, parts, False)
                    names = []
                    continue
                if typed := ANNOTATION.match(text, at):
                    at = typed.end()
            parts, at, chained = self.expression(at)
            if chained:
                continue
            if parts:
                self.bind(names, parts, op == "+=")
            names = []
        for pair in (*ELEMENT.finditer(text), *ATTRIBUTES.finditer(text)):
            self.bind([pair[1]], [self.values.literal(*pair.span(2), True)], False)
        return sorted(self.values.places(self.wanted))


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names."""
    return Scanner(text).spans() if SENSITIVE.search(text) else []


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, all_spans = [], [], []
        for body in batch.column("text").to_pylist():
            text = body.decode("utf-8", "replace")
            base = base_spans(text)
            kinds = Counter(k for _, k, _ in base)
            counts.append((kinds[0], kinds[1], kinds[2]))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            all_spans.append(written(sorted(base + literal_spans(text))))
        n = list(zip(*counts)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of ``docs``; no shuffle."""
    return texts(docs).mapInArrow(frugal(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
