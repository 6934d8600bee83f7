"""Scanners over source text (fileId, text), for review evidence.

Patterns over the whole text find names. What needs the structure of a file goes through one lexer: it turns a text
into rows of events, each with its offset and the innermost named block around it, and the scanners are aggregates over
these rows. Comments and the insides of strings give no events.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import ids

# Names that register a listener and names that release one; the first of each also count without a receiver.
REGISTERS = ["addEventListener", "subscribe", "on", "observe", "connect", "watch"]
RELEASES = ["removeEventListener", "unsubscribe", "off", "disconnect", "unobserve", "dispose"]
BARE = ["addEventListener", "removeEventListener", "unsubscribe"]
# Names by which messages come in or go out, types that say nothing, names that check a message.
SINKS, SINK_PROPERTY, SINK_EVENT = ["onDidReceiveMessage", "postMessage"], "onmessage", "message"
UNTYPED = ["any", "unknown"]
CHECKS = ["parse", "validate", "decode", "isValid", "safeParse"]
# How facts are read from a page.
SELECTORS, FACTS, ATTRIBUTE, DATA = ["querySelector", "querySelectorAll"], ["textContent", "innerText", "value", "dataset"], "getAttribute", "dataset"
# Members from which a declaration is wide, and from which it is if half of them are optional.
WIDE, WIDE_OPTIONAL = 7, 5


def ambient(sources: DataFrame, names: list[str], objects: tuple[str, ...] = ("window", "globalThis")) -> DataFrame:
    """(fileId, name): the given globals a file reads through one of the objects."""
    found = F.regexp_extract_all("text", F.lit(rf"\b(?:{'|'.join(map(re.escape, objects))})\.([A-Za-z_$][\w$]*)"), F.lit(1))
    return sources.select("fileId", F.explode(F.array_distinct(found)).alias("name")).where(F.col("name").isin(names)).distinct()


def payload_owners(sources: DataFrame, types: list[str]) -> DataFrame:
    """(type, files): types declared as a field or variable in two or more files."""
    found = F.regexp_extract_all("text", F.lit(rf"[\w$]+\s*:\s*({'|'.join(map(re.escape, types))})\b"), F.lit(1))
    per = sources.select("fileId", F.explode(F.array_distinct(found)).alias("type")).distinct()
    return per.groupBy("type").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= 2)


def unregistered(sources: DataFrame, declared: str, registered: str) -> DataFrame:
    """(name): names the first pattern's group finds anywhere and the second's nowhere."""
    of = lambda p: sources.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("name")).distinct()
    return of(declared).join(of(registered), "name", "left_anti")


def dormant_routes(sources: DataFrame) -> DataFrame:
    """(name): members of view, route, page and mode unions that no register call names; mode and page unions count whole as well."""
    bodies = F.explode(F.regexp_extract_all("text", F.lit(r"\btype\s+\w*(?:View|Route|Page|Mode)\w*\s*=\s*([^;\n]+)"), F.lit(1)))
    members = sources.select(bodies.alias("b")).select(F.explode(F.regexp_extract_all("b", F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))).alias("name")).distinct()
    done = sources.select(F.explode(F.regexp_extract_all("text", F.lit(r"""\bregister\w*\s*\(\s*['"]([^'"]+)['"]"""), F.lit(1))).alias("name")).distinct()
    return members.join(done, "name", "left_anti")


# ---- events --------------------------------------------------------------------------------------------------------------


class Lexeme(NamedTuple):
    kind: str
    text: str
    at: int


_lexer = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`)|(?P<word>[^\W\d]\w*|\$[\w$]*)|(?P<line>\n)|(?P<mark>=>|\?\.|[^\s\w])", re.S)


def lexemes(text: str) -> list[Lexeme]:
    """Words, strings, marks and line ends, in order."""
    return [Lexeme(m.lastgroup, m[0], m.start()) for m in _lexer.finditer(text) if m.lastgroup]


class Block(NamedTuple):
    """An open brace: the entity it belongs to (None for a plain block), whether that is a class, and where its head begins."""

    entity: str | None
    is_class: bool
    at: int


def _block(head: list[Lexeme], around: list[Block], brace: Lexeme) -> Block:
    """What a brace opens, told from the lexemes since the last statement or block ended."""
    words = [i for i, x in enumerate(head) if x.kind == "word"]
    after = lambda name: next((head[j].text for i, j in zip(words, words[1:]) if head[i].text == name), None)
    outer = next((b.entity for b in reversed(around) if b.is_class), None)
    for name in ("class", "interface"):
        if (entity := after(name)) and not any(x.text in ("=", "(") for x in head[: words[0]]):
            return Block(entity, True, head[words[0]].at)
    if entity := after("function"):
        return Block(entity, False, head[words[0]].at)
    call = next((i for i, x in enumerate(head) if x.text == "("), 0)
    if around and around[-1].is_class and call and head[call - 1].kind == "word" and not any(x.text == "=" for x in head[:call]):
        return Block(f"{outer}.{head[call - 1].text}", False, head[words[0]].at)
    return Block(None, False, brace.at)


def _members(body: list[Lexeme]) -> tuple[int, int]:
    """(members, optional ones) of a declaration's body."""
    members = optional = depth = 0
    fresh, i = True, 0
    while i < len(body):
        x = body[i]
        if depth == 0 and fresh and x.kind != "line":
            j = i + (x.text == "readonly" and i + 1 < len(body) and body[i + 1].kind in ("word", "string"))
            if body[j].text == "[":
                while j + 1 < len(body) and body[j].text != "]":
                    j += 1
            may = j + 1 < len(body) and body[j + 1].text == "?"
            follow = body[j + 1 + may].text if j + 1 + may < len(body) else ""
            if (body[j].kind in ("word", "string") or body[j].text == "]") and follow in (":", "(", "<"):
                members, optional, i = members + 1, optional + may, j
                x = body[i]
            fresh = False
        if x.text in ("{", "(", "[", "<") and x.kind == "mark":
            depth += 1
        elif x.text in ("}", ")", ">") or x.text == "]" and not (i and fresh):
            depth = max(0, depth - 1)
        elif depth == 0 and (x.kind == "line" or x.text in (";", ",")):
            fresh = True
        i += 1
    return members, optional


class Event(NamedTuple):
    """at: offset. entity: innermost named block, None for the file. kind: register, release, sink, check, untyped, page or declared."""

    at: int
    entity: str | None
    kind: str
    name: str
    members: int = 0
    optional: int = 0


def blocks_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(entity, start, end) of every named block, in the order in which they close."""
    for e in _walk(lexemes(text)):
        if e.kind == "block":
            yield e.name, e.members, e.optional


def events_of(text: str) -> list[Event]:
    return [e for e in _walk(lexemes(text), text) if e.kind != "block"]


def _walk(lex: list[Lexeme], text: str = "") -> Iterator[Event]:
    code = [x for x in lex if x.kind != "line"]
    around: list[Block] = []
    head: list[Lexeme] = []
    selected: Lexeme | None = None
    for i, x in enumerate(code):
        entity = next((b.entity for b in reversed(around) if b.entity), None)
        prev, nxt = code[i - 1] if i else None, code[i + 1] if i + 1 < len(code) else None
        dotted = prev is not None and prev.text in (".", "?.")
        if x.kind == "word":
            called = nxt is not None and nxt.text == "("
            if called and (dotted or x.text in BARE):
                if x.text in REGISTERS:
                    yield Event(x.at, entity, "register", x.text)
                elif x.text in RELEASES:
                    yield Event(x.at, entity, "release", x.text)
            if called and x.text == REGISTERS[0] and i + 2 < len(code) and code[i + 2].text[1:-1] == SINK_EVENT or called and x.text in SINKS or dotted and x.text == SINK_PROPERTY:
                yield Event(x.at, entity, "sink", x.text)
            if called and x.text in CHECKS:
                yield Event(x.at, entity, "check", x.text)
            if x.text in UNTYPED and prev is not None and prev.text == ":":
                yield Event(x.at, entity, "untyped", x.text)
            if called and x.text in SELECTORS:
                selected = x
            elif dotted and selected is not None and x.text in FACTS:
                yield Event(selected.at, entity, "page", text[selected.at : x.at + len(x.text)])
            if dotted and called and x.text == ATTRIBUTE:
                yield Event(prev.at, entity, "page", f".{ATTRIBUTE}(")
            if dotted and x.text == DATA and nxt is not None and nxt.text == "." and i + 2 < len(code) and code[i + 2].kind == "word":
                yield Event(prev.at, entity, "page", f".{DATA}.{code[i + 2].text}")
        if x.text == "{" and x.kind == "mark":
            around.append(_block(head, around, x))
            head = []
        elif x.text == "}":
            if around and (b := around.pop()).entity:
                yield Event(b.at, None, "block", b.entity, b.at, x.at + 1)
            head = []
        elif x.text == ";":
            head, selected = [], None
        else:
            head.append(x)
    yield from _declared(lex)


def _declared(lex: list[Lexeme]) -> Iterator[Event]:
    """Interfaces and object types with the number of their members."""
    i = 0
    while i + 1 < len(lex):
        if lex[i].kind == "word" and lex[i].text in ("interface", "type") and lex[i + 1].kind == "word":
            j = i + 2
            while j < len(lex) and lex[j].text not in ("{", "=", ";"):
                j += 1
            alias = lex[i].text == "type"
            if alias and j < len(lex) and lex[j].text == "=":
                j += 1
                while j < len(lex) and lex[j].kind == "line":
                    j += 1
            if j < len(lex) and lex[j].text == "{" and alias == (any(x.text == "=" for x in lex[i:j])):
                depth, k = 1, j + 1
                while k < len(lex) and depth:
                    depth += (lex[k].text == "{") - (lex[k].text == "}")
                    k += 1
                if not depth:
                    yield Event(lex[i].at, None, "declared", lex[i + 1].text, *_members(lex[j + 1 : k - 1]))
                    i = k
                    continue
        i += 1


def text_events(sources: DataFrame) -> DataFrame:
    """(fileId, copy, at, entity, kind, name, members, optional) of every text; copy tells the texts of a file apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, c, *e) for f, c, t in zip(*(b.column(i).to_pylist() for i in range(3))) for e in events_of(t)]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["fileId", "copy", "at", "entity", "kind", "name", "members", "optional"])

    rows = sources.where(F.col("fileId").isNotNull() & F.col("text").isNotNull()).select("fileId", F.xxhash64("text").alias("copy"), "text").distinct()
    return rows.mapInArrow(run, "fileId string, copy long, at int, entity string, kind string, name string, members int, optional int")


def listener_balance(events: DataFrame) -> DataFrame:
    """(fileId, entity, registered, released) where more is registered than released; a null entity stands for the file itself."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    per = events.where(F.col("kind").isin("register", "release")).groupBy("fileId", "copy", "entity").agg(n("register").alias("registered"), n("release").alias("released"))
    return per.where(F.col("registered") > F.col("released")).drop("copy")


def transport_sinks(events: DataFrame) -> DataFrame:
    """(fileId, entity, untyped, checked): where messages first come in or go out; the flags hold for the whole file."""
    kind = F.col("kind")
    per = events.where(kind.isin("sink", "untyped", "check")).groupBy("fileId", "copy").agg(
        F.min(F.when(kind == "sink", F.struct("at", "entity"))).alias("first"), F.bool_or(kind == "untyped").alias("untyped"), F.bool_or(kind == "check").alias("checked")
    )
    return per.where(F.col("first").isNotNull()).select("fileId", F.col("first.entity").alias("entity"), "untyped", "checked")


def wide_declarations(events: DataFrame) -> DataFrame:
    """(fileId, name, members, optional) of interfaces and object types with seven members, or five of which half are optional."""
    half = (F.col("members") >= WIDE_OPTIONAL) & (2 * F.col("optional") >= F.col("members"))
    return events.where((F.col("kind") == "declared") & ((F.col("members") >= WIDE) | half)).select("fileId", "name", "members", "optional")


def dom_sources(events: DataFrame) -> DataFrame:
    """(fileId, snippet): the first place where a text reads facts from the page."""
    first = events.where(F.col("kind") == "page").groupBy("fileId", "copy").agg(F.min(F.struct("at", "name")).alias("first"))
    return first.select("fileId", F.col("first.name").alias("snippet")).distinct()


def text_signals(events: DataFrame) -> DataFrame:
    """(query, ref, note) of the scanners that need a file's structure: lifecycle, transport and wide declarations."""
    place = F.concat("fileId", F.coalesce(F.concat(F.lit(ids.SEP), "entity"), F.lit("")))
    life = listener_balance(events).select(F.lit("lifecycle").alias("query"), place.alias("ref"), F.format_string("%d registered, %d released", "registered", "released").alias("note"))
    sinks = transport_sinks(events).select(F.lit("transport").alias("query"), place.alias("ref"), F.format_string("untyped=%s checked=%s", F.col("untyped").cast("string"), F.col("checked").cast("string")).alias("note"))
    wide = wide_declarations(events).select(F.explode(F.array(F.lit("interface-decl"), F.lit("interface-width"))).alias("query"), F.concat("fileId", F.lit(":"), "name").alias("ref"), F.format_string("%d members, %d optional", "members", "optional").alias("note"))
    return life.unionByName(sinks).unionByName(wide)
