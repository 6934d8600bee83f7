"""Bodies of functions as text: a form that forgets names and literal values, and the literal payloads they hold.

One pattern cuts a body into lexemes, in Spark as well as in Python. It has no look-around, so SQL engines can share it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of the language that keep their form.
KEYWORDS = [
    "abstract", "accessor", "any", "as", "assert", "asserts", "async", "await", "bigint", "boolean", "break", "case", "catch", "class", "const", "constructor", "continue", "debugger", "declare", "default",
    "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "from", "function", "get", "global", "if", "implements", "import", "in", "infer", "instanceof", "interface", "intrinsic", "is",
    "keyof", "let", "module", "namespace", "never", "new", "null", "number", "object", "of", "out", "override", "package", "private", "protected", "public", "readonly", "require", "return", "satisfies", "set",
    "static", "string", "super", "switch", "symbol", "this", "throw", "true", "try", "type", "typeof", "undefined", "unique", "unknown", "using", "var", "void", "while", "with", "yield",
]
# Placeholders, and the tags of literal payloads.
NAME, LITERAL = "$ID", "$LIT"
STRING, NUMBER, REGEX, ARRAY = "str", "num", "re", "arr"

_QUOTED = r""" "[^"\\\n]*(?:\\.[^"\\\n]*)*" | '[^'\\\n]*(?:\\.[^'\\\n]*)*' | `[^`\\]*(?:\\.[^`\\]*)*` """.replace(" ", "")
_SET = r"\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*\]"
#: A slash after one of these begins a regular expression; the lexeme holds both.
_BEFORE = r"[(,=:\[!&|?{};]"
_OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
PATTERN = rf"//[^\n]*|(?s:/\*.*?\*/)|{_QUOTED}|{_BEFORE}[ \t]*/(?:[^/*\\\n\[]|\\.|{_SET})(?:[^/\\\n\[]|\\.|{_SET})*/[a-z]*|[0-9][A-Za-z0-9_.]*|[A-Za-z_$][A-Za-z0-9_$]*|{_OPERATORS}|[^ \t\r\n\f\x0BA-Za-z0-9_$]"
IS_REGEX = rf"^{_BEFORE}[ \t]*/."

_lexeme, _is_regex = re.compile(PATTERN), re.compile(IS_REGEX, re.S)


def code_lexemes(body: Column) -> Column:
    """The body's lexemes without comments; a regular expression comes with the sign before it."""
    return F.filter(F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*"))


def normalized_body(body: Column | str) -> Column:
    """struct(text, tokenCount): names as $ID, literals as $LIT, all else as it is, joined by spaces."""
    lexemes = code_lexemes(F.col(body) if isinstance(body, str) else body)
    form = F.transform(
        lexemes,
        lambda t: F.when(t.rlike("^[\"'`0-9]"), LITERAL).when(t.rlike(IS_REGEX), F.concat(F.substring(t, 1, 1), F.lit(" " + LITERAL))).when(t.rlike("^[A-Za-z_$]") & ~t.isin(KEYWORDS), NAME).otherwise(t),
    )
    n = F.size(lexemes) + F.size(F.filter(lexemes, lambda t: t.rlike(IS_REGEX)))
    return F.struct(F.array_join(form, " ").alias("text"), n.alias("tokenCount"))


def normalized_sql(text: str) -> str:
    """The same as SQL: a struct of text and tokenCount."""
    p, r, k = PATTERN.replace("'", "''"), IS_REGEX.replace("'", "''"), ", ".join(f"'{x}'" for x in KEYWORDS)
    lex = f"list_filter(regexp_extract_all({text}, '{p}'), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*'))"
    form = f"list_transform({lex}, lambda t: CASE WHEN regexp_matches(t, '^[\"''`0-9]') THEN '{LITERAL}' WHEN regexp_matches(t, '{r}') THEN t[1] || ' {LITERAL}' WHEN regexp_matches(t, '^[A-Za-z_$]') AND t NOT IN ({k}) THEN '{NAME}' ELSE t END)"
    return f"struct_pack(text := array_to_string({form}, ' '), tokenCount := len({lex}) + len(list_filter({lex}, lambda t: regexp_matches(t, '{r}'))))"


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_escape = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|(.))", re.S)


def _value(lexeme: str) -> str:
    """What a quoted lexeme or a number stands for; any other lexeme as it is."""
    if lexeme[0] in "\"'`":
        return _escape.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16) % 0x110000) if not m[4] else _ESCAPES.get(m[4], m[4]), lexeme[1:-1])
    return lexeme.replace("_", "") if lexeme[0].isdigit() else lexeme


def literal_payloads(body: str) -> list[tuple[str, str]]:
    """(tag, payload) of a body's literals: strings, numbers and expressions of two characters or more, and arrays of two elements or more.

    What is inside brackets belongs to the array and is no payload of its own. Templates with ${..} are none.
    """
    flat: list[str] = []
    for t in _lexeme.findall(body):
        if t.startswith(("//", "/*")):
            continue
        flat.extend((t[0], t[1:].lstrip(" \t")) if _is_regex.match(t) else (t,))
    # depth before every lexeme; an array begins where the depth of brackets of all kinds leaves the ground by a [
    out, array, depth, commas = [], None, 0, 0
    for t in flat:
        if array is None:
            if t == "[":
                array, depth, commas = [], 1, 0
            elif t[0] in "\"'`":
                if not (t[0] == "`" and "${" in t) and len(v := _value(t)) >= 2:
                    out.append((STRING, v))
            elif t[0].isdigit():
                if len(v := _value(t)) >= 2:
                    out.append((NUMBER, v))
            elif t[0] == "/" and len(t) > 2 and t[1] not in "/*":
                out.append((REGEX, t))
            continue
        depth += (t in ("[", "{", "(")) - (t in ("]", "}", ")"))
        if depth == 0 and t == "]":
            if array and commas:
                out.append((ARRAY, "".join(array)))
            array = None
            continue
        commas += t == "," and depth == 1
        array.append(_value(t))
    if array and commas:
        out.append((ARRAY, "".join(array)))
    return out


def literal_hashes(body: str) -> list[str]:
    return sorted(f"{tag}:{hashlib.sha256(v.encode('utf-8', 'surrogatepass')).hexdigest()}" for tag, v in literal_payloads(body))


def entity_hashes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with normalizedHash, tokenCount and literalHashes: what clone clusters are built from. A null body has nulls and no literals."""
    n = bodies.withColumn("__n", normalized_body(body))
    n = n.withColumns({"normalizedHash": F.sha2("__n.text", 256), "tokenCount": F.when(F.col(body).isNotNull(), F.col("__n.tokenCount").cast("long"))}).drop("__n")
    schema = T.StructType([*n.schema.fields, T.StructField("literalHashes", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([literal_hashes(t) if t else [] for t in b.column(body).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "literalHashes"])

    return n.mapInArrow(run, schema)
