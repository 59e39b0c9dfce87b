"""Secret scans: fixed patterns, and a lexer that follows literals to the names they are assigned to.

The lexer reads source and configuration syntax into pairs of a name and the literals its expression stands for:
assignments (``name = "x"``, ``name: str = "x"``, ``var name string = "x"``, ``a["name"] = "x"``, ``name := "x"``, ``$n => "x"``),
mappings (``"name": "x"``, ``name: x``, block scalars after ``name: |``), ``NAME=x``, ``<name>x</name>``,
``<entry key="name">x</entry>``, ``<add key="name" value="x"/>`` and ``call("name", "x")``. An expression is a literal, neighbouring or added
literals, arguments of a call, items of a list, or alternatives. Names that hold a constant stand for it, alone, in a sum or inside
``${...}``, so a literal is judged by every name it reaches, not only by the one it is written next to. Calls, types
and unknown names are never literals; the key of a lookup (``environ.get("KEY", "x")``, ``a["KEY"]``) is a name; a value without quotes
is a literal only in configuration syntax, alone on its line or after ``=`` without blanks. A literal that reaches a sensitive name is scored by
that name and by its own looks.

Texts are read whole in time that grows with their length: an expression ends where the next pair begins. An empty or NULL text has
no spans; rows never meet, so repeated rows, ties and clashing columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, task, texts

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
INDENT = 1000  # white space looked through before a name, to tell whether it leads its line
KINDS = ("assign", "access", "hex", "literal", "flow")

# Words of sensitive names, pairs of words that are sensitive together, words that make a name harmless,
# and literals that stand for a secret without being one.
SENSITIVE = {"password", "passwords", "passwd", "pwd", "passphrase", "secret", "secrets", "token", "apikey", "credential", "credentials", "privatekey", "authkey"}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("auth", "key"), ("signing", "key"), ("encryption", "key"), ("secret", "key"), ("session", "key")}
HARMLESS = {"length", "len", "count", "policy", "name", "file", "path", "url", "type", "ttl", "expiry", "field", "label", "hint", "prompt", "regex", "pattern", "limit", "max", "min"}
LOOKUPS = {"get", "getenv", "env", "environ", "getproperty", "property", "lookup", "fetch", "read", "load", "open", "input", "prompt", "getpass", "find", "resolve", "config", "option", "param"}
READS = {"print", "printf", "println", "format", "log", "info", "debug", "warn", "warning", "error", "assert", "raise", "replace", "split", "join", "encode", "decode", "match", "compile", "startswith", "endswith"}
KEYWORDS = {"new": "", "await": "", "const": "", "static": "", "or": "other", "if": "other", "else": "other"}
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|dummy|your[_\- ]|x{4,}|\*{3,}|\.{3,}|^<.*>$|^(?:none|null|true|false|todo|test|redacted|undefined)$")

STRING = r'(?:[rbuf]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`\n]*+`))'
NAME = r"[A-Za-z_$][\w$]*+(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*+)*+"
TYPE = r"(?:&(?:'\w++[ \t]+)?(?:mut[ \t]+)?|\*+)?[A-Za-z_]\w*+(?:(?:\.|::)\w++)*+(?:\[[^\]\n]{0,60}\]|<[^>\n=]{0,60}>)?[?!]?(?:[ \t]*\|[ \t]*\w++)*+"
PAIR = re.compile(
    r"(?<![\w.\-])-{0,2}+(?P<name>[A-Za-z_][\w.\-]*+)(?P<close>[\"']?\]|[\"']|\[\d*\])?[ \t]*+"
    rf"(?P<op>=>|:=|\+=|=(?![=~>])|:[ \t]*+{TYPE}[ \t]*+=(?![=~>])|:(?!:|//))[ \t]*+")
TAGGED = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)>(?P<value>[^<>\n]++)</(?P=name)>")
TAG = re.compile(r"<[A-Za-z][\w:.\-]*+(?=\s)(?P<attributes>[^<>]*+)>(?:(?P<value>[^<>\n]++)</)?")
ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.\-]*+)\s*+=\s*+(?:\"([^\"<>]*+)\"|'([^'<>]*+)')")
ARGUMENTS = re.compile(rf"\(\s*+(?P<q>[\"'])(?P<name>[A-Za-z_][\w.\-]*+)(?P=q)\s*+,\s*+(?:(?P<literal>{STRING})|(?P<known>{NAME}))\s*+[,)]", re.DOTALL)
TOKEN = re.compile(
    rf"(?P<blank>[ \t]++|\\\r?\n|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<line>\r?\n)|(?P<literal>{STRING})|(?P<name>{NAME}!?(?=(?P<call>[ \t]*+\()?))|(?P<number>\d[\w.]*+)"
    rf"|(?P<member>\??\.[A-Za-z_]\w*+)|(?P<join>\+(?!=)|\.\.|\.)|(?P<open>[(\[])|(?P<close>[)\]])|(?P<other>,|\|\||\?\??)|(?P<pair>=>?|:)|(?P<rest>.)", re.DOTALL)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#]++")
ALONE = re.compile(r"[ \t]*+(?:[;,][ \t]*+)?(?:#[^\n]*+)?(?:\r?\n|$)")
LEADS = re.compile(r"[ \t]*+(?:(?:#|//)[ \t]*+)?(?:(?:export|set|setx|ENV|ARG)[ \t]++|-[ \t]++|--?|-D)?[\"']?$")
SCALAR = re.compile(r"[|>][+\-\d]*+[ \t]*+(?:#[^\n]*+)?\r?\n")
GOES_ON = re.compile(r"[ \t]++(?:\+[ \t]|\.\.|\|\||\?\?)|[ \t]*+[\"'`](?![^\n]*?[\"'`][ \t]*+[:=])")
SHELL = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?")
INSIDE = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)")
SUBWORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    """``start`` and ``end`` in code points, the end exclusive; ``value``: where the secret itself begins."""

    kind: str
    start: int
    end: int
    value: int


class Constant(NamedTuple):
    text: str
    spans: tuple[tuple[int, int], ...]


def name_score(name: str) -> float:
    """How sensitive a name is: 0, or more than half."""
    words = [w.lower() for w in SUBWORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    if any(w in SENSITIVE for w in words) or any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])):
        return 0.6
    return 0.0


def literal_score(text: str) -> float:
    """How much a literal looks like a secret: length, variety of characters, no placeholder."""
    if len(text) < 6 or PLACEHOLDER.search(text):
        return -1.0
    counts = Counter(text)
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    mixed = any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    return 0.15 * (len(text) >= 8) + 0.15 * (bits >= 2.75) + 0.1 * mixed - 0.2 * any(c.isspace() for c in text)


def _literal(raw: str, start: int) -> Constant:
    head = len(raw) - len(raw.lstrip("rbuf"))
    quotes = 3 if raw[head:head + 3] == '"""' else 1
    return Constant(raw[head + quotes:len(raw) - quotes], ((start + head + quotes, start + len(raw) - quotes),))


class Known(dict):
    """What the names of a text hold: for each, the constants that it may stand for."""

    def inside(self, literal: Constant) -> tuple[Constant, bool]:
        """A literal with the constants that it names in ``${...}``; without them, only its own words count."""
        if "$" not in literal.text and "{" not in literal.text:
            return literal, False
        names = [a or b for a, b in INSIDE.findall(literal.text)]
        held = [self[n][0] for n in names if n in self]
        if held:
            return Constant(literal.text + "".join(c.text for c in held), tuple(s for c in held for s in c.spans)), True
        return (Constant(INSIDE.sub("", literal.text), literal.spans) if names else literal), False


class Expression:
    """The constants that an expression may stand for, taken in from left to right: neighbours and sums are one constant."""

    def __init__(self, known: Known):
        self.known, self.constants, self.parts, self.through, self.flows = known, [], [], False, []

    def add(self, constants: list[Constant], through: bool):
        if len(constants) > 1 and not self.parts:
            self.constants += constants
            self.flows += [through] * len(constants)
        else:
            self.parts += constants[:1]
            self.through = self.through or through

    def finish(self):
        """What was read so far is one constant; another one may follow."""
        if self.parts:
            self.constants.append(Constant("".join(p.text for p in self.parts), tuple(s for p in self.parts for s in p.spans)))
            self.flows.append(self.through)
        self.parts, self.through = [], False


def _bare(text: str, m: re.Match, known: Known) -> tuple[list[Constant], bool]:
    """A value without quotes that is a literal, since the pair stands in configuration syntax, or a shell variable."""
    at = m.end()
    value = BARE.match(text, at)
    shell = SHELL.match(text, at)
    if shell and (not value or shell.end() >= value.end()):
        return known.get(shell[1], []), True
    if value is None or value[0] in known:
        return [], False
    word, end = value[0], value.end()
    if text[end:end + 1] in ("(", "[", "{", "<", '"', "'", "`"):
        return [], False
    blanks = m["op"] == ":" or text[m.start("op") - 1] in " \t" or text[at - 1] in " \t"
    if m["op"] not in ("=", ":") or m["close"]:
        return [], False
    before = max(text.rfind("\n", max(0, m.start() - INDENT), m.start()) + 1, m.start() - INDENT, 0)
    leads = LEADS.match(text, before, m.start()) is not None and ALONE.match(text, end) is not None
    if not leads and blanks:
        return [], False
    if re.fullmatch(NAME, word):  # a name, unless nothing but a value can stand there
        digits = any(c.isdigit() for c in word) and "_" not in word
        if "." in word or "::" in word or "->" in word or not leads or blanks and not digits and (m["op"] == "=" or word[0].isupper()):
            return [], False
    return [Constant(word, ((at, end),))], False


def _scalar(text: str, m: re.Match) -> list[Constant]:
    """The lines of a block scalar: those after ``name: |`` that are indented deeper than the name."""
    first = SCALAR.match(text, m.end())
    if m["op"] != ":" or not first:
        return []
    begins = text.rfind("\n", 0, m.start()) + 1
    depth = len(text[begins:m.start()]) - len(text[begins:m.start()].lstrip(" "))
    at, lines, spans = first.end(), [], []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            indent = len(line) - len(line.lstrip(" "))
            if indent <= depth:
                break
            lines.append(line.strip())
            spans.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
        at = end + 1
    return [Constant("\n".join(lines), tuple(spans))] if lines else []


def _expression(text: str, m: re.Match, known: Known) -> tuple[list[Constant], list[bool], bool]:
    """The constants after a pair's sign, whether each came through names, and whether the value is the next pair's.

    Brackets are a stack of what they open: a call whose first argument is a key, one that makes nothing of its literals, a
    subscript, or a plain group. The text is read up to the end of the statement or to the next pair.
    """
    out, stack, at, last, condition, opening = Expression(known), [], m.end(), "", False, ""
    while at < len(text):
        t = TOKEN.match(text, at)
        kind = t.lastgroup if t.lastgroup != "call" else "name"
        at = t.end()
        if kind == "blank":
            continue
        if kind == "line":
            if stack or last in ("join", "other"):
                continue
            if not last and (m["op"] != ":" or m["close"]) and text[at:at + 200].lstrip()[:1] in ("'", '"', "`", "(", "["):
                continue
            if last and m["op"] != ":" and GOES_ON.match(text, at):
                continue
            break
        if kind == "literal":
            after = text[at:at + 2].lstrip()[:1]
            if after in (":", "=") and not condition:  # a key: the next pair begins
                break
            role = stack[-1] if stack else ""
            if role == "key":
                stack[-1] = "group"
            elif "skip" not in stack and "key" not in stack:
                constant, through = known.inside(_literal(t["literal"], t.start()))
                if not (role == "group" and re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", constant.text)):
                    out.add([constant], through)
        elif kind == "name":
            word = t["name"].lstrip("$")
            if word in KEYWORDS:
                kind = KEYWORDS[word] or last
                condition = condition or word == "if"
                if kind == "other":
                    out.finish()
            elif t["call"] is not None:
                tail = re.split(r"\W+", word.rstrip("!"))[-1].lower()
                opening = "skip" if tail in READS else "key" if tail in LOOKUPS else "group"
            elif text[at:at + 1] == "[":
                opening = "skip"
            elif not stack and last in ("literal", "name", "close"):
                break
            elif word in known and "skip" not in stack and "key" not in stack[-1:]:
                out.add(known[word], True)
        elif kind == "member":
            tail = t["member"].lstrip("?.").lower()
            opening = "key" if tail in LOOKUPS else "skip"
            kind = "name"
        elif kind == "open":
            stack.append(opening or ("skip" if last in ("name", "close", "literal") and t["open"] == "[" else "group"))
            opening = ""
            if last != "join":
                out.finish()
        elif kind == "close":
            if not stack:
                break
            stack.pop()
        elif kind == "other":
            if t["other"] == "," and not stack:
                break
            condition = condition or t["other"] == "?"
            out.finish()
        elif kind == "pair":
            if not condition or t["pair"] != ":":
                return out.constants, out.flows, last == "name" and not stack and not out.constants and t["pair"] == "=" and text[at:at + 1] != "="
            condition = False
            out.finish()
        elif kind in ("number", "rest"):
            if not stack or t[0] in ";{}":
                break
            out.finish()
        last = kind
    out.finish()
    return out.constants, out.flows, False


def _pairs(text: str):
    """All matches that give a name and a value, in order."""
    pairs = [*PAIR.finditer(text)] if ":" in text or "=" in text else []
    if "</" in text or "/>" in text:
        pairs += [*TAGGED.finditer(text), *TAG.finditer(text)]
    if "(" in text and "," in text:
        pairs += ARGUMENTS.finditer(text)
    return sorted(pairs, key=lambda m: m.start())


def _tagged(m: re.Match) -> tuple[str | None, list[Constant]]:
    """The name that a tag's ``key``, ``name`` or ``id`` gives, and the value attribute or the text behind the tag."""
    at, attributes = m.start("attributes"), {}
    for a in ATTRIBUTE.finditer(m["attributes"]):
        group = 2 if a[2] is not None else 3
        attributes[a[1].lower()] = Constant(a[group], ((at + a.start(group), at + a.end(group)),))
    name = next((attributes[k].text for k in ("key", "name", "id") if k in attributes), None)
    if "value" in attributes:
        return name, [attributes["value"]]
    return name, [Constant(m["value"], (m.span("value"),))] if m["value"] else []


def assigned(text: str) -> list[Span]:
    """Literals that reach a sensitive name: ``literal`` beside the name, ``flow`` through other names."""
    found, known, waiting = {}, Known(), []
    for m in _pairs(text):
        awaits, names = False, []
        if m.re is PAIR:
            name = m["name"]
            if name in ("string", "String"):  # ``var name string = "x"``: the type stands before the sign
                declared = re.search(r"\b(?:var|const)[ \t]+(\w+)[ \t]+$", text[max(0, m.start() - 200):m.start()])
                name = declared[1] if declared else name
            waiting.append(name)
            names = waiting
            constants, through = _scalar(text, m), False
            if not constants:
                constants, through = _bare(text, m, known)
            flows = [through] * len(constants)
            if not constants and text[m.end():m.end() + 1] not in ("", "{"):
                constants, flows, awaits = _expression(text, m, known)
            if m["op"] == "+=" and name in known and constants:
                old = known[name][0]
                constants = [Constant(old.text + c.text, old.spans + c.spans) for c in constants]
        elif m.re is TAG:
            name, constants = _tagged(m)
            names, flows = [name] if name else [], [False] * len(constants)
        elif m.re is TAGGED:
            names, constants, flows = [m["name"]], [Constant(m["value"], (m.span("value"),))], [False]
        else:
            names = [m["name"]]
            constant, through = known.inside(_literal(m["literal"], m.start("literal"))) if m["literal"] else (None, True)
            constants = [constant] if constant else known.get(m["known"], [])
            constants = [c for c in constants if not any(x.isspace() for x in c.text)]
            flows = [through] * len(constants)
        waiting = waiting if awaits else []
        for name in names if not awaits else []:
            if m.re is not ARGUMENTS:
                if constants:
                    known[name] = constants
                else:
                    known.pop(name, None)
            score = name_score(name)
            for constant, through in zip(constants, flows) if score else ():
                if score + literal_score(constant.text) >= 0.7:
                    for start, end in constant.spans:
                        found.setdefault((start, end), Span("flow" if through else "literal", start, end, start))
    return [*found.values()]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind, by start and then kind."""
    spans = [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    spans += [Span("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    spans += [Span("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return _ordered(spans)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: the lexer's are added unless a base span covers them."""
    base = base_spans(text)
    more = [s for s in assigned(text) if s.start < s.end and not any(b.start <= s.start and s.end <= b.end for b in base)]
    return base, _ordered([*base, *more])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every secret value replaced by ``[SECRET]``; overlapping spans become one."""
    out, at = [], 0
    for start, end in sorted((s.value, s.end) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPAN = "struct<kind:string,start:long,end:long,value:long>"


def _scanned(batches):
    arrow_span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])
    for batch in in_batches(batches):
        counts, digests, joined, found = {k: [] for k in KINDS[:3]}, [], [], []
        for text in batch.column("text").to_pylist():
            base, every = find_secrets(text)
            for k in counts:
                counts[k].append(sum(s.kind == k for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(every))
            found.append([s._asdict() for s in every])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(found, pa.list_(arrow_span))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` (NULL text: empty): doc_id, n_assign, n_access, n_hex, base_sha256, spans and found,
    the spans as structs. Rows never meet, so no skew, repeated id or NULL id matters."""
    return texts(docs, id_col, text_col).mapInArrow(
        task(_scanned), f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<{SPAN}>")


def _cleaned(batches, column: str):
    for batch in in_batches(batches, column=column):
        new = [None if t is None else redacted(t, s) if (s := find_secrets(t)[1]) else t for t in batch.column(column).to_pylist()]
        yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(new, pa.string()))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secret values replaced; ``length_col`` is counted anew where it is present and not NULL."""
    rows = docs.withColumn("_lakeops_old", F.length(text_col)) if length_col in docs.columns else docs
    clean = rows.mapInArrow(task(_cleaned, text_col), rows.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changed = F.length(text_col) != F.col("_lakeops_old")
        clean = clean.withColumn(length_col, F.when(changed & F.col(length_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(length_col))).drop("_lakeops_old")
    return clean.select(*docs.columns)
