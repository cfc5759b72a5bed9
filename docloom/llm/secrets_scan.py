"""Secret scans by assignment-aware lexing.

Beside the base expressions, a lexer reads source and configuration syntax: comments, strings with escapes, strings
and heredocs of several lines, YAML blocks, names, operators and brackets. From its tokens come name-literal pairs:
assignments, key-value lines, JSON and YAML entries, INI keys, XML elements and attributes, command-line options,
calls with a name and a literal, and passwords in addresses. A name stands for its literals in its scope (braces,
indented blocks, sections, comments) and those inside; constants are propagated through names and concatenation, so
that a literal has every name that reaches it. A literal is scored by how sensitive its names are and by its form.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import sha256_hex

KINDS = ("assign", "access", "hex")
THRESHOLD = 1.0
_assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "api")
#: Words of names, and how much each says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.8, "credentials": 0.8,
    "pw": 0.8, "private": 0.4, "auth": 0.4, "authorization": 0.6, "access": 0.3, "api": 0.4, "key": 0.4, "bearer": 0.6, "signing": 0.4, "encryption": 0.4, "session": 0.2, "pass": 0.6,
}
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{?.*\}?|%.*%|null|none|true|false|undefined|changeme|example|redacted|your.*|todo|n/?a)$", re.IGNORECASE)
_PHRASE = re.compile(r"[A-Za-z]?[a-z]*(?:[_.\-/ ][A-Za-z]?[a-z]+)*")
_ARMOUR = re.compile(r"-----[A-Z ]+-----|\s+")
_base64 = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
_name_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_identifier = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?", re.ASCII)
_STRING = r""""[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|(?<!\w)'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`"""
_lexeme = re.compile(
    rf"""(?P<line>\n[\x20\t]*)|(?P<long>\"\"\"|\'\'\'|/\*|<!--)|(?P<remark>(?<![^\s;])\#|(?<![^\s;{{}}()])//)|(?P<string>{_STRING})
    |(?P<assign>=>|:=|=(?![=~>])|:(?!//|:))|(?P<other>[=!<>]=+|=~|::|:)|(?P<option>(?<!\S)--?(?P<flag>[A-Za-z][\w-]*)(?:=|(?=\x20+[^\s-])))
    |(?P<name>[A-Za-z_$][\w.$-]*)|(?P<mark>.)""",
    re.ASCII | re.VERBOSE,
)
_string = re.compile(_STRING)
_prefix = re.compile(r"[A-Za-z]{0,2}(?=[\"'`])", re.ASCII)
_bare = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_scheme = re.compile(r"(?:Bearer|Basic|Token)\x20+(?=\S)", re.IGNORECASE)
_block = re.compile(r"[|>][+-]?[0-9]?\x20*(?=\n)")
_heredoc = re.compile(r"<<[-~]?([\"']?)([A-Za-z_]\w*)\1[^\n]*\n", re.ASCII)
_joint = re.compile(r"\x20*(?:\+|\.(?=\x20)|(?:\\\n\x20*)?(?=[\"'`]))\x20*")
_section = re.compile(r"\[{1,2}([^\[\]\n\"']+)\]{1,2}[\x20\t]*(?=\n|$)")
_call = re.compile(rf"\(\s*({_STRING})\s*(?:,\s*({_STRING})\s*)?\)")
_element = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>(?:<!\[CDATA\[)?([^<]+?)(?:\]\]>)?</\1\s*>", re.ASCII)
_address = re.compile(r"://[^\s:/@\"']*:([^\s:/@\"']+)@")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base matches by start, then kind; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _assign.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _hex.finditer(text)]
    return _sorted(out)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if len(spans) > 1 else spans


def sensitivity(name: str) -> float:
    """The sum of what a name's words say, 1 at most for each word."""
    words = [w if w in SENSITIVE else w.removesuffix("s") for w in map(str.lower, _name_words.findall(name))]
    both = {a + b for a, b in zip(words, words[1:], strict=False)}
    return max(sum(SENSITIVE.get(w, 0.0) for w in set(words)), *(SENSITIVE.get(w, 0.0) for w in both | {"".join(words)}))


def literal_score(value: str) -> float:
    """0 for short literals, placeholders and plain words; up to 1 by entropy and mixed characters."""
    if "\n" in value and _base64.fullmatch(bare := _ARMOUR.sub("", value)):
        value = bare  # a key over several lines
    if len(value) < 8 or _PLACEHOLDER.match(value) or _PHRASE.fullmatch(value) or re.search(r"\s", value):
        return 0.0
    counts, n = Counter(value), len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return 0.0 if kinds == 1 and not value.isdigit() and entropy < 3.5 else min(1.0, entropy / 4) * (0.6 + 0.2 * min(2, kinds - 1))


@dataclass
class _Scope:
    """Names and the spans that they stand for; name: of the container; it ends at a bracket, a lesser indent, a place, or the next section."""

    kind: str
    name: str = ""
    indent: int = -1
    end: int | None = None
    holds: dict[str, set[tuple[int, int]]] = field(default_factory=dict)


class _Lexer:
    """Name-literal pairs of one text, in one pass."""

    def __init__(self, text: str) -> None:
        self.text, self.scopes = text, [_Scope("text")]
        self.found: dict[tuple[int, int], tuple[str, set[str]]] = {}
        self.indent = self._indent_at(0)
        self.absent: set[str] = set()
        self.lines: dict[str, list[int]] | None = None

    def _indent_at(self, at: int) -> int:
        end = at
        while end < len(self.text) and self.text[end] in " \t":
            end += 1
        return end - at

    def _closing(self, mark: str, at: int) -> int:
        """Where a mark next occurs, -1 if nowhere; what is absent once is absent later."""
        if mark in self.absent:
            return -1
        end = self.text.find(mark, at)
        if end < 0:
            self.absent.add(mark)
        return end

    def _line_of(self, word: str, at: int) -> int:
        """Where the next line begins that holds a word alone, -1 if none does."""
        if self.lines is None:
            self.lines, start = {}, 0
            for line in self.text.split("\n"):
                self.lines.setdefault(line.strip(), []).append(start)
                start += len(line) + 1
        own = self.lines.get(word, [])
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1

    def literal(self, start: int, end: int) -> set[tuple[int, int]]:
        if start >= end:
            return set()
        self.found.setdefault((start, end), (self.text[start:end], set()))
        return {(start, end)}

    def held(self, name: str) -> set[tuple[int, int]] | None:
        """What a name stands for, in the innermost scope that has it."""
        return next((s.holds[name] for s in reversed(self.scopes) if name in s.holds), None)

    def assign(self, name: str, reached: set[tuple[int, int]]) -> None:
        self.scopes[-1].holds[name] = reached
        container = next((s.name for s in reversed(self.scopes) if s.name), "")
        for span in reached:
            self.found[span][1].add(f"{container} {name}" if container else name)

    def value(self, at: int) -> tuple[set[tuple[int, int]], int, bool]:
        """(spans of the literals of the value that begins here, where it ends, whether it is a container)."""
        text, reached = self.text, set()
        while at < len(text) and text[at] in " \t":
            at += 1
        if m := _block.match(text, at):
            begin = stop = m.end() + 1
            while stop < len(text):
                line = text.find("\n", stop)
                line = len(text) if line < 0 else line
                if text[stop:line].strip() and self._indent_at(stop) <= self.indent:
                    break
                stop = line + 1
            stop = min(stop, len(text))
            own = text[begin:stop]
            return self.literal(begin + len(own) - len(own.lstrip()), begin + len(own.rstrip())), stop - (stop > begin and text[stop - 1] == "\n"), False
        if (m := _heredoc.match(text, at)) and (end := self._line_of(m[2], m.end())) >= 0:
            return self.literal(m.end(), end - 1), end + len(m[2]), False
        if at >= len(text) or text[at] in "\n{":
            return reached, at, True
        if m := _scheme.match(text, at):
            at = m.end()
        while True:
            at = _prefix.match(text, at).end() if _prefix.match(text, at) else at
            quote = text[at : at + 3]
            if quote in ('"""', "'''") and (end := self._closing(quote, at + 3)) >= 0:
                reached |= self.literal(at + 3, end)
                at = end + 3
            elif m := _string.match(text, at):
                reached |= self.literal(at + 1, m.end() - 1)
                at = m.end()
            elif m := _bare.match(text, at):
                end = m.end()
                whole = m[0]
                if "+" in whole and (text[end : end + 1] in "\"'`" and whole.endswith("+") or _identifier.fullmatch(whole.split("+")[0]) and self.held(whole.split("+")[0].lstrip("$")) is not None):
                    whole = whole.split("+")[0]  # a name, and more after +
                    end = at + len(whole)
                if text[end : end + 1] == "(":  # what a call is given reaches the name
                    if call := _call.match(text, end):
                        last = 2 if call[2] is not None else 1
                        reached |= self.literal(call.start(last) + 1, call.end(last) - 1)
                    return reached, end, False
                ref = _identifier.fullmatch(whole)
                if ref and (own := self.held(ref[1])) is not None:
                    reached |= own  # a constant seen before
                elif not ref or any(c.isdigit() for c in whole):
                    reached |= self.literal(at, at + len(whole.rstrip(".,;")))
                at = end
            else:
                return reached, at, False
            joint = _joint.match(text, at)
            if not joint or joint.end() >= len(text):
                return reached, at, False
            at = joint.end()

    def run(self) -> list[tuple[str, tuple[int, int], set[str]]]:
        text, at, last, begins = self.text, 0, None, True
        while at < len(text):
            while self.scopes[-1].end is not None and at >= self.scopes[-1].end:
                self.scopes.pop()
            if begins and (m := _section.match(text, at)):
                while len(self.scopes) > 1:
                    self.scopes.pop()
                self.scopes.append(_Scope("section", m[1].strip()))
                at, last, begins = m.end(), None, False
                continue
            m = _lexeme.match(text, at)
            kind, at = m.lastgroup, m.end()
            if kind == "mark" and m[0] in " \t\r":
                continue
            begins = kind == "line"
            if kind == "line":
                last = None
                if at < len(text) and text[at] != "\n":
                    self.indent = at - m.start() - 1
                    while self.scopes[-1].kind == "block" and self.indent <= self.scopes[-1].indent:
                        self.scopes.pop()
            elif kind == "long":
                closing = {"/*": "*/", "<!--": "-->"}.get(m[0], m[0])
                end = self._closing(closing, at)
                if end >= 0 and m[0] in ("/*", "<!--"):
                    self.scopes.append(_Scope("remark", end=end))
                elif end >= 0:
                    last, at = (text[at:end], at), end + 3
            elif kind == "remark":
                end = text.find("\n", at)
                self.scopes.append(_Scope("remark", end=len(text) if end < 0 else end))
            elif kind == "string":
                last = (m[0][1:-1], m.start() + 1)
            elif kind == "name":
                last = (m[0], m.start())
            elif kind in ("option", "flag"):
                reached, at, _ = self.value(at)
                self.assign(m["flag"], reached)
                last = None
            elif kind == "assign" and last is not None:
                name, (reached, at, container) = last[0], self.value(at)
                last = None
                if not container:
                    after = re.compile(r"\x20*=(?!=)").match(text, at)
                    if m[0] == ":" and after and not reached:  # name: type = value
                        reached, at, _ = self.value(after.end())
                    self.assign(name, reached)
                elif text[at : at + 1] == "{":
                    self.scopes.append(_Scope("brace", name))
                    at += 1
                elif m[0] == ":":
                    self.scopes.append(_Scope("block", name if "(" not in name else "", self.indent))
            elif m[0] == ":" and text[at : at + 1] in ("\n", ""):  # the head of an indented block
                self.scopes.append(_Scope("block", "", self.indent))
            elif kind == "mark" and m[0] == "(" and last is not None:
                if call := _call.match(text, m.start()):
                    own = 2 if call[2] is not None else 1
                    self.assign(call[1][1:-1] if own == 2 else last[0], self.literal(call.start(own) + 1, call.end(own) - 1))
                    at = call.end()
                last = None
            elif kind == "mark" and m[0] == "{":
                self.scopes.append(_Scope("brace"))
                last = None
            elif kind == "mark" and m[0] == "}":
                if any(s.kind == "brace" for s in self.scopes):
                    while self.scopes.pop().kind != "brace":
                        pass
                last = None
            elif kind == "mark" and m[0] == "]" and last is not None:
                pass  # map["name"] = value
            else:
                last = None
        for m in _element.finditer(text):
            own = m[2].strip()
            for span in self.literal(m.start(2) + m[2].index(own[0]), m.start(2) + m[2].index(own[0]) + len(own)) if own else ():
                self.found[span][1].add(m[1])
        for m in _address.finditer(text):
            for span in self.literal(*m.span(1)):
                self.found[span][1].add("password")
        return [(literal, span, names) for span, (literal, names) in self.found.items() if names]


def literals(text: str) -> list[tuple[str, tuple[int, int], set[str]]]:
    """(literal, span, names that reach it), with constants propagated in the order of the text and within their scopes."""
    return _Lexer(text).run()


def added_spans(text: str, base: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Spans of literals whose score reaches the threshold, of kind assign; none touches a base span or an earlier one."""
    if not any(c in text for c in ("=", ":", "</", "--", "(")):
        return []
    low = text.lower()
    if not any(s in low for s in SENSITIVE) and "://" not in low:
        return []
    found = []
    for literal, (start, end), names in literals(text):
        value = literal_score(literal)
        if value and max(map(sensitivity, names), default=0.0) + 0.5 * value >= threshold:
            found.append((start, end))
    out, taken, at, last = [], sorted((s, e) for _, s, e in base), 0, 0
    for start, end in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and (at == len(taken) or taken[at][0] >= end):
            out.append(("assign", start, end))
            last = end
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex (base matches), base_sha256, spans, n_added.

    Null and empty texts have no spans: counts of 0, the digest of "" and "". Texts and literals of any length are
    read whole, in time that grows with the length. Base matches of different kinds may overlap and all count; an added
    span touches none, and of literals that overlap the first stays. Repeated rows give a row each; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, threshold) if text else []
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), sha256_hex(joined(base)), joined(_sorted(base + more) if more else base), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
