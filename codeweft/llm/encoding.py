"""Text decoded with a wrong character encoding: found and restored as a noisy channel.

The source model is the corpus itself: how many distinct texts hold each whitespace-separated token with a non-ASCII character,
and each word or symbol in such tokens; copies of a text say nothing new. A channel writes a text in its true encoding and
reads it in a wrong one. For every distinct token the observed characters are turned back into a byte lattice under each
channel that its characters allow: a character is its byte in the wrong encoding, a U+FFFD is a wildcard for one lost byte or
character, and every character may also stay as it is. The words that a lattice can spell are looked up in the model by a key of what
is known of them, and a Viterbi search over (byte position, word prefix) takes the path whose words are most frequent; the
single characters' frequencies decide only where no known word fits. The token's gain is the logarithm of how much likelier
the restored token is than the observed one, plus the odds that so many bytes form proper characters by chance.

A document is damaged if the gains of its tokens under one channel sum up to MIN_GAIN, or if it has lost characters: a U+FFFD next to a
letter, or several in a row. A U+FFFD that stands alone is a character like any other, and stays.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import parallelism, small, staged

MIN_GAIN = 2.0
#: Log-odds that a multi-byte character is spelled by chance: in general, and where it mends the letters around it.
JOINED, MENDING = 3.0, 5.0
WHOLE_ONLY = -1e3
LOST = "�"
TOKEN = r"[^ \t\r\n]*[^\x00-\x7F][^ \t\r\n]*"
#: Letters of a word that is looked up by all that is known of it; longer ones are looked up by what is known of their beginning.
WORD = 40
#: Log-probability of a letter in a word the model lacks, of a lost byte that stays, of a character that stays though its
#: bytes spell another one, and of several lost characters for one.
LETTER, KEPT, STAYS, SEVERAL = -3.5, -30.0, -12.0, -6.0

#: (wrong, true): read as wrong, written as true.
MULTIBYTE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]
LATIN = ["cp1252", "cp1250", "iso8859_2", "cp852", "mac_roman", "cp437", "cp850"]
CYRILLIC = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]
ASIAN = ["shift_jis", "euc_jp", "gb18030", "big5"]
#: Within a script, every pair; between scripts, the usual defaults as the wrong one.
LEGACY = list(
    dict.fromkeys(
        [(w, t) for group in (LATIN, CYRILLIC) for w in group for t in group if w != t]
        + [(w, t) for w in ("cp1252", "mac_roman", "cp437", "cp850") for t in CYRILLIC + ASIAN]
        + [(w, t) for w in ("cp1251", "koi8_r", "cp866") for t in ("cp1252", "cp1250", *ASIAN)]
    )
)
LOST_CHANNEL = "lost characters"

_unit = re.compile(r"[^\W\d_]+|[^\x00-\x7f]")
_high = re.compile(r"[^\x00-\x7f]+")
_ascii = re.compile(r"[\x00-\x7f]+")
_damage = re.compile(rf"[^\W\d_]{LOST}|{LOST}[^\W\d_]|{LOST}{LOST}")


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes the codec leaves undefined stand for their C1 control, as lenient decoders have it."""
    out = {chr(b): b for b in range(0x80)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


_tables = {c: _table(c) for c in {w for w, _ in LEGACY} | set(MULTIBYTE)}


def units(token: str) -> list[str]:
    """Words and non-ASCII symbols of a token."""
    return _unit.findall(token)


def lost_evidence(token: str) -> bool:
    """Whether characters got lost in the token: a U+FFFD next to a letter, or more than one in a row."""
    return LOST in token and _damage.search(token) is not None


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


@lru_cache(1 << 16)
def _assigned(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


class Known:
    """The characters of the corpus with their frequencies, and those that fit a byte pattern."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.n = counts
        self.total = sum(counts.values()) + 1
        self._by_lead: dict[int, list[tuple[bytes, str]]] = {}
        for c in sorted(counts):
            b = c.encode("utf-8", "surrogatepass")
            if len(b) > 1:
                self._by_lead.setdefault(b[0], []).append((b, c))
        self._cache: dict[tuple, frozenset[str]] = {}

    def fitting(self, pattern: tuple[int, ...]) -> frozenset[str]:
        """Known characters whose UTF-8 bytes fit; -1 is any byte."""
        if pattern not in self._cache:
            leads = [pattern[0]] if pattern[0] >= 0 else list(self._by_lead)
            self._cache[pattern] = frozenset(c for x in leads for b, c in self._by_lead.get(x, ()) if len(b) == len(pattern) and all(p in (-1, y) for p, y in zip(pattern, b)))
        return self._cache[pattern]

    def cost(self, c: str) -> float:
        return LETTER if c.isascii() else math.log((self.n.get(c, 0) + 0.1) / self.total)


# ---- lattices ----------------------------------------------------------------------------------------------------------


def utf8_edges(token: str, wrong: str, known: Known) -> list[list[tuple[int, frozenset[str]]]]:
    """From each position the multi-byte characters that start there: (next position, the characters it may be)."""
    table, n = _tables[wrong], len(token)
    out: list[list[tuple[int, frozenset[str]]]] = [[] for _ in range(n)]
    for i, c in enumerate(token):
        lead = table.get(c, 0)
        k = _length(lead) if lead >= 0xC2 else 0
        if not k or i + k > n:
            continue
        tail = tuple(-1 if x == LOST else table.get(x, 0) for x in token[i + 1 : i + k])
        if not all(b == -1 or 0x80 <= b <= 0xBF for b in tail):
            continue
        if -1 in tail:
            fits = known.fitting((lead, *tail))
        else:
            try:
                fits = frozenset(bytes((lead, *tail)).decode("utf-8"))
            except UnicodeDecodeError:
                continue
        if fits:
            out[i].append((i + k, fits))
    return out


def lost_edges(token: str, known: Known) -> list[list[tuple[int, frozenset[str]]]]:
    """A U+FFFD is one lost character; two to four in a row may be the bytes of one."""
    out: list[list[tuple[int, frozenset[str]]]] = [[] for _ in token]
    anything = frozenset(c for c in known.n if not c.isascii() and c != LOST)
    for m in re.finditer(LOST + "+", token):
        for i in range(m.start(), m.end()):
            out[i].append((i + 1, anything))
            out[i].extend((i + k, fits) for k in (2, 3, 4) if i + k <= m.end() and (fits := known.fitting((-1,) * k)))
    return out


def mends(token: str, i: int, j: int, c: str) -> bool:
    """Whether c in place of token[i:j] continues the letters around it, in script and case, which the observed characters break."""
    before, after = token[i - 1 : i], token[j : j + 1]
    letters = [x for x in (before, after) if x.isalpha() and x.isascii()]
    if j - i == 4:
        return True
    if not c.isalpha():
        return j - i == 3 and "\u2000" <= c < "\u2c00" and not (before + after).isupper()
    seen = token[i:j]
    return bool(letters) and _script(c) == "LATIN" and c.islower() and all(x.islower() for x in letters[:1]) and not (seen.isalpha() and seen.islower())


def accepted(token: str, edges: list[list[tuple[int, frozenset[str]]]], known: Known) -> list[list[tuple[int, frozenset[str]]]]:
    """Edges without characters that nothing speaks for: unknown to the corpus, and no mending of the letters around."""
    return [[(j, fits) for j, fits in at if len(fits) > 1 or (c := next(iter(fits))) in known.n or (_assigned(c) and mends(token, i, j, c))] for i, at in enumerate(edges)]


def forced(token: str, edges: list[list[tuple[int, frozenset[str]]]]) -> list[tuple[int, int, str | frozenset[str]]]:
    """The path that takes every multi-byte character: (start, end, character, or several where bytes are lost)."""
    out, i = [], 0
    while i < len(token):
        j, fits = edges[i][0] if edges[i] else (i + 1, token[i])
        out.append((i, j, next(iter(fits)) if len(fits) == 1 else fits))
        i = j
    return out


def _key(word: str, asked: frozenset[str]) -> list[str]:
    """What a word of the model is found by: its ASCII letters, or its length with its first, last and asked letters where it has none.

    Beyond WORD letters, its first ASCII letters and its asked letters.
    """
    some = sorted(asked.intersection(word))
    if len(word) > WORD:
        run = _ascii.search(word)
        return [*([f"+{run[0][:WORD]}"] if run else []), *(f"+{c}" for c in some)]
    mask = _high.sub("*", word)
    return [mask] if mask != "*" else [f"*F{len(word)}{word[0]}", f"*L{len(word)}{word[-1]}", *(f"*C{len(word)}{c}" for c in some)]


def _rarest(letters: str, known: Known | None) -> str:
    return min(letters, key=lambda c: (known.n.get(c, 0) if known else 0, c))


def _keys(text: str, lengths: Iterable[int], known: Known | None) -> list[str]:
    """Keys of all words of at most WORD letters that text may stand for, U+FFFD being any non-ASCII letters; none if nothing is left of it."""
    mask, left = _high.sub("*", text), text.replace(LOST, "")
    if not left or "*" not in mask:
        return []
    if mask != "*":
        return [mask]
    kind, c = ("F", text[0]) if text[0] != LOST else ("L", text[-1]) if text[-1] != LOST else ("C", _rarest(left, known))
    return [f"*{kind}{n}{c}" for n in lengths]


def _opening(cells: Iterable[tuple[str, str, int]], known: Known | None) -> set[tuple[str, str]]:
    """(key, pattern) of the words of over WORD letters that begin with cells: (letter or nothing, pattern, its characters).

    Such a word goes beyond WORD characters of the token, so all of these are its own, and so is the first known letter.
    """
    pattern, first, others, growing, n = "^", "", "", False, 0
    for c, p, k in cells:
        plain = c != "" and c.isascii()
        if n > WORD and (first or others):
            # the key holds the first ASCII letters as far as they go
            if not (growing and plain and len(first) < WORD):
                break
            first += c
            continue
        pattern, n = pattern + p, n + k
        growing = plain and (growing or not first)
        if growing:
            first += c
        elif not plain:
            others += c
    if first:
        return {(f"+{first[:WORD]}", pattern)}
    return {(f"+{_rarest(others, known)}", pattern)} if others else set()


def _class(fits: str | frozenset[str]) -> str:
    if isinstance(fits, str):
        return r"\x{%x}" % ord(fits)
    lo, hi = min(fits), max(fits)
    return r"[\x{%x}-\x{%x}]" % (ord(lo), ord(hi))


def lookups(cells: list[tuple[int, int, str | frozenset[str]]], known: Known | None = None) -> set[tuple[str, str]]:
    """(key, pattern) of the words that a path's cells may spell; a cell of several characters may be a letter or end a word."""
    out: set[tuple[str, str]] = set()
    run: list[str | frozenset[str]] = []

    def ask(part: list[str | frozenset[str]]) -> None:
        text = "".join(x if isinstance(x, str) else LOST for x in part)
        if keys := _keys(text, [len(text)], known):
            pattern = "".join(map(_class, part))
            out.update((k, f"^{pattern}$") for k in keys)

    def close() -> None:
        wild = [i for i, x in enumerate(run) if not isinstance(x, str)]
        starts, ends = [0, *(i + 1 for i in wild)], [len(run), *wild]
        for a in starts:
            for b in ends:
                if 0 < b - a <= WORD:
                    ask(run[a:b])
            if len(run) - a > WORD:
                out.update(_opening(((x if isinstance(x, str) else "", _class(x), 1) for x in (run[i] for i in range(a, len(run)))), known))
        run.clear()

    for _, _, x in cells:
        if not isinstance(x, str) or x.isalpha():
            run.append(x)
        else:
            close()
    close()
    return out


def _stretches(token: str) -> Iterator[list[str]]:
    """The letters around a token's lost characters, as known parts and rows of U+FFFD in turn; a word may begin and end at any of them."""
    for m in re.finditer(rf"[^\W\d_{LOST}]*(?:{LOST}+[^\W\d_{LOST}]*)+", token):
        yield [x for x in re.split(rf"({LOST}+)", m[0]) if x]


def _hole(lost: str) -> str:
    # a row of lost bytes may be fewer characters
    return r"[^\x00-\x7F]{1,%d}" % len(lost)


def _letters(part: str) -> str:
    return "".join(map(_class, part))


def lost_lookups(token: str, known: Known | None = None) -> set[tuple[str, str]]:
    """(key, pattern) of the words around a token's lost characters, any of which may be a letter, part of one, or a symbol.

    Here those that take at most WORD characters of the token; long_lookups has the others.
    """
    out: set[tuple[str, str]] = set()
    for parts in _stretches(token):
        for a in range(len(parts)):
            n = least = 0
            for b in range(a, len(parts)):
                n += len(parts[b])
                least += 1 if parts[b][0] == LOST else len(parts[b])
                if n > WORD:
                    break
                part = parts[a : b + 1]
                if keys := _keys("".join(part), range(least, n + 1), known):
                    body = "".join(_hole(x) if x[0] == LOST else _letters(x) for x in part)
                    out.update((k, f"^{body}$") for k in keys)
    return out


def long_lookups(token: str, known: Known | None = None) -> set[tuple[str, str]]:
    """(key, pattern) of the words that take over WORD characters of a token around its lost ones: longer words, and others whose lost bytes are fewer letters.

    There are as many for every place where a word may begin, whatever the length of the token. So the patterns leave open what the search finds out.
    """
    out: set[tuple[str, str]] = set()
    for parts in _stretches(token):
        ahead = sum(map(len, parts))
        for a in range(len(parts)):
            if ahead <= WORD:
                break
            ahead -= len(parts[a])
            cells = (x for i in range(a, len(parts)) for x in ([("", _hole(parts[i]), len(parts[i]))] if parts[i][0] == LOST else ((c, _class(c), 1) for c in parts[i])))
            out |= _opening(cells, known)
            n = least = 0
            for b in range(a, len(parts)):
                n += len(parts[b])
                least += 1 if parts[b][0] == LOST else len(parts[b])
                if least > WORD:
                    break
                if n > WORD and (keys := _keys("".join(LOST if x[0] == LOST else x for x in parts[a : b + 1]), range(least, WORD + 1), known)):
                    pattern = f"^{_letters(parts[a])}" if parts[a][0] != LOST else f"{_letters(parts[b])}$" if parts[b][0] != LOST else _letters(parts[a + 1])
                    out.update((k, pattern) for k in keys)
    return out


def decode(token: str, edges: list[list[tuple[int, frozenset[str]]]], words: dict[str, int], known: Known, total: float, guess: bool = True) -> tuple[str, list[tuple[int, int, str]], float]:
    """The likeliest path: (text, its multi-byte or lost characters as (start, end, character), log-probability).

    Viterbi search. A state is a position and what the path is in the middle of: nothing, a prefix of words (a node of
    their trie), or a word the model lacks. Every character may stay as it is. Without guess, an edge leads through known words only.
    """
    trie: dict = {}
    for w, n in words.items():
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = n
    none, unknown = math.log(0.1 / total), object()
    n = len(token)
    # position -> state key -> (score, node, path as linked cells, costs of the prefix's letters if it turns out to be no word)
    at: list[dict] = [{} for _ in range(n + 1)]
    at[0][0] = (0.0, None, None, 0.0)

    def put(j: int, key, score: float, node, path, spelled: float = 0.0) -> None:
        old = at[j].get(key)
        if old is None or score > old[0]:
            at[j][key] = (score, node, path, spelled)

    def ends(score: float, node) -> float | None:
        if node is None:
            return score
        if node is unknown:
            return score + none
        return score + math.log((node[""] + 0.1) / total) if "" in node else None

    def top(fits) -> str:
        return max(sorted(fits), key=lambda c: known.n.get(c, 0))

    def step(i: int, j: int, fits, keep: bool, cost_of: float) -> None:
        letters = [c for c in fits if c.isalpha() or (keep and c == LOST)] if len(fits) > 1 else (list(fits) if next(iter(fits)).isalpha() or fits == {LOST} else [])
        best_letter = (top(letters) if len(letters) > 1 else letters[0]) if letters else None
        symbols = [c for c in fits if c not in letters] if len(fits) > 1 else ([] if letters else list(fits))
        best_symbol = (top(symbols) if len(symbols) > 1 else symbols[0]) if symbols else None
        for score, node, path, spelled in list(at[i].values()):
            score += cost_of
            if letters:
                inside = trie if node is None else node
                if inside is not unknown:
                    for c in letters if len(letters) < len(inside) else [c for c in inside if c and c in fits]:
                        if c in inside:
                            put(j, id(inside[c]), score, inside[c], (path, i, j, c), spelled + known.cost(c))
                cost = KEPT if best_letter == LOST else known.cost(best_letter)
                if not (keep or guess):
                    continue
                put(j, 1, score + spelled + cost, unknown, (path, i, j, best_letter))
            if best_symbol is not None and (keep or guess):
                done = ends(score, node)
                if done is None:
                    done = score + spelled + none
                put(j, 0, done + (0.0 if best_symbol.isascii() else known.cost(best_symbol)), None, (path, i, j, best_symbol))

    for i in range(n):
        if at[i]:
            step(i, i + 1, {token[i]}, True, STAYS if edges[i] and token[i] != LOST else 0.0)
            for j, fits in edges[i]:
                step(i, j, fits, False, SEVERAL if token[i] == LOST and j - i > 1 else 0.0)
            at[i].clear()
    best = None
    for score, node, path, spelled in at[n].values():
        done = ends(score, node)
        if done is None:
            done = score + spelled + none
        if best is None or done > best[0]:
            best = (done, path)
    chars, put_in, p = [], [], best[1]
    while p is not None:
        p, i, j, c = p
        chars.append(c)
        if token[i:j] != c:
            put_in.append((i, j, c))
    return "".join(reversed(chars)), put_in[::-1], best[0]


def whole_lookup(token: str, cells: list[tuple[int, int, str | frozenset[str]]] | None) -> set[tuple[str, str]]:
    """(key, pattern) of the whole token among those of the corpus: along cells, or with any characters for the lost ones."""
    spare = 0
    if cells is None:
        parts = re.split(rf"({LOST}+)", token)
        shape, pattern = token, "".join(_hole(x) if x[:1] == LOST else _letters(x) for x in parts)
        # up to four lost bytes may be one character
        spare = sum(len(x) - -(-len(x) // 4) for x in parts if x[:1] == LOST)
    else:
        shape, pattern = "".join(x if isinstance(x, str) else LOST for _, _, x in cells), "".join(_class(x) for _, _, x in cells)
    mask = _high.sub("*", shape)
    if mask == "*" and (len(shape) < 2 or shape == LOST * len(shape)):
        return set()
    return {("#" + k, f"^{pattern}$") for k in ([mask] if mask != "*" else [f"*{n}" for n in range(len(shape) - spare, len(shape) + 1)])}


_leads: dict[str, re.Pattern] = {}
for _w in MULTIBYTE:
    _lead, _tail = ("".join(re.escape(c) for c, b in _tables[_w].items() if lo <= b <= hi) for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
    _leads[_w] = re.compile(f"[{_lead}][{_tail}{LOST}]")


class _Reading(dict):
    """Character to character, from the wrong single-byte reading to the true one; 0 where there is none."""

    def __init__(self, wrong: str, true: str) -> None:
        for c, b in _tables[wrong].items():
            if b >= 0x80:
                try:
                    self[ord(c)] = bytes([b]).decode(true)
                except UnicodeDecodeError:
                    self[ord(c)] = 0

    def __missing__(self, c: int) -> int:
        return c if c < 0x80 else 0


_readings = {(w, t): _Reading(w, t) for w, t in LEGACY if t not in ASIAN}


def legacy_masks(known: Known) -> dict[str, int]:
    """For every character the pairs of LEGACY, as bits, under which it may stand for a character of the corpus."""
    out: dict[str, int] = {}
    for k, (wrong, true) in enumerate(LEGACY):
        for c, b in _tables[wrong].items():
            if b >= 0x80 and (true in ASIAN or (y := _readings[wrong, true].get(ord(c))) and (y.isascii() or y in known.n)):
                out[c] = out.get(c, 0) | 1 << k
    return out


def legacy_readings(token: str, masks: dict[str, int], known: Known) -> Iterator[tuple[str, str, float, bool]]:
    """(channel, restored, bonus, weak) of the legacy pairs that turn all of the token into characters the corpus knows.

    Few characters fit some pair by chance: a reading of one or two is weak, it mends where other tokens speak for the channel.
    """
    high = {c for c in token if not c.isascii()}
    left = -1
    for c in high:
        left &= masks.get(c, 0)
    seen = {token}
    rarest = min(known.n.get(c, 0) for c in high)
    while left > 0:
        k = (left & -left).bit_length() - 1
        left &= left - 1
        wrong, true = LEGACY[k]
        if true in ASIAN:
            try:
                y = bytes(_tables[wrong][c] for c in token).decode(true)
            except (KeyError, UnicodeDecodeError):
                continue
        else:
            y = token.translate(_readings[wrong, true])
        if y in seen or not all(c.isascii() or c in known.n for c in y):
            continue
        seen.add(y)
        wide = sum(not c.isascii() and known.n[c] >= rarest for c in y) if true in ASIAN else 0
        # symbols must be known as a whole token: one by one they fit anything
        worded = sum(c.isalpha() for c in y) >= 3
        yield f"{true} as {wrong}", y, JOINED * (wide // 2) if worded else WHOLE_ONLY, sum(c.isalpha() or not c.isascii() for c in y) < 3


def joined_odds(token: str, put_in: list[tuple[int, int, str]]) -> tuple[float, bool]:
    """(bonus, mending): what the multi-byte characters of a path say, times the share of the odd characters they explain."""
    odd = sum(not c.isascii() for c in token)
    explained = sum(not c.isascii() for i, j, _ in put_in for c in token[i:j])
    strong = [mends(token, i, j, c) for i, j, c in put_in]
    return sum(MENDING if s else JOINED for s in strong) * explained / odd, any(strong)


def twice_read(token: str, known: Known) -> Iterator[tuple[str, str, float]]:
    """(channel, restored, bonus) of texts that went through UTF-8 and a wrong encoding two times, also two different ones."""
    seen = {token}
    for first in MULTIBYTE:
        if not _leads[first].search(token):
            continue
        cells = forced(token, utf8_edges(token, first, known))
        once = "".join(c for _, _, c in cells)
        if once in seen:
            continue
        seen.add(once)
        for second in MULTIBYTE:
            if not _leads[second].search(once):
                continue
            inner = forced(once, accepted(once, utf8_edges(once, second, known), known))
            y = "".join(c for _, _, c in inner)
            if y not in seen and y != once and all(c.isascii() or (c in known.n and _assigned(c)) for c in y):
                seen.add(y)
                yield f"utf-8 as {second}, again as {first}", y, joined_odds(token, [(i, j, c) for i, j, c in cells if j - i > 1])[0]


def document_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, token): the distinct tokens of a document that hold a non-ASCII character."""
    return docs.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))).alias("token"))


# ---- the corpus model and the search -----------------------------------------------------------------------------------

PROPOSAL = "token string, n long, channel string, restored string, bonus double, mending boolean, weak boolean, before array<string>, after array<string>"


def _proposals(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*((*r, units(r[0]), units(r[3])) for r in rows)))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["token", "n", "channel", "restored", "bonus", "mending", "weak", "before", "after"])


def lattices(token: str, known: Known) -> Iterator[tuple[str, list[list[tuple[int, frozenset[str]]]], set[tuple[str, str]]]]:
    """(channel, edges, lookups) of every channel that could have made the token by writing several bytes for a character, or by losing some."""
    for wrong in MULTIBYTE:
        if _leads[wrong].search(token):
            edges = accepted(token, utf8_edges(token, wrong, known), known)
            if any(edges):
                cells = forced(token, edges)
                kept = [(i, i + 1, c) for i, c in enumerate(token)]
                yield f"utf-8 as {wrong}", edges, lookups(cells, known) | lookups(kept, known) | (whole_lookup(token, cells) if LOST in token else set())
    if lost_evidence(token) and any(c.isalpha() for c in token):
        yield LOST_CHANNEL, lost_edges(token, known), lost_lookups(token, known) | long_lookups(token, known) | whole_lookup(token, None)


def restored_token(token: str, channel: str, edges, candidates: list[tuple[str, int]], own: int, known: Known, total: float) -> tuple[str, float, bool] | None:
    """(restored, bonus, mending) by the likeliest path; candidates are words and, with a leading #, whole tokens of the corpus."""
    mine = set(units(token))
    words = {w: n - own if w in mine else n for w, n in candidates if w[0] != "#"}
    whole = max(((len(w) - 1 == len(token), n, w[1:]) for w, n in candidates if w[0] == "#" and w[1:] != token), default=None)
    text, put_in, _ = decode(token, edges, {w: n for w, n in words.items() if n > 0}, known, total, channel != LOST_CHANNEL)
    if whole and LOST in token:
        text = whole[2]
        if channel != LOST_CHANNEL:
            # cells of the forced path that the known token fills
            put_in = [(i, j, "") for i, j, _ in forced(token, edges) if j - i > 1]
    if text == token:
        return None
    if channel == LOST_CHANNEL:
        return text, 0.0, False
    bonus, mending = joined_odds(token, [(i, j, c) for i, j, c in put_in if j - i > 1])
    return text, bonus, mending


def token_gains(tokens: DataFrame) -> DataFrame:
    """(token, channel, restored, gain, weak) for tokens (token, n) of the corpus; gain > 0 only."""
    spark = tokens.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [(x, n) for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist()) for x in units(t)]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in u], pa.string()), pa.array([n for _, n in u], pa.int64())], names=["unit", "n"])

    model = staged(tokens.mapInArrow(split, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    # at most as many rows as Unicode has characters
    chars = model.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("c"), "n").where(F.col("c").rlike(r"[^\x00-\x7F]")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    sent = spark.sparkContext.broadcast({r["c"]: r["n"] for r in chars if r["c"] != LOST})
    total = float(model.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        masks = legacy_masks(known)
        for b in batches:
            rows = []
            for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist()):
                if LOST not in t:
                    rows.extend((t, n, channel, y, bonus, False, weak) for channel, y, bonus, weak in legacy_readings(t, masks, known))
                    rows.extend((t, n, channel, y, bonus, False, False) for channel, y, bonus in twice_read(t, known))
            if rows:
                yield _proposals(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        for b in batches:
            rows = [(t, n, channel, [{"key": k, "pattern": p} for k, p in sorted(asks)]) for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist()) for channel, _, asks in lattices(t, known)]
            if rows:
                c = list(zip(*rows))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("key", pa.string()), ("pattern", pa.string())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["token", "n", "channel", "asks"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n, whole in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), b.column("whole").to_pylist()):
                if whole:
                    mask = _high.sub("*", w)
                    rows.append(("#" + (mask if mask != "*" else f"*{len(w)}"), w, "#" + w, n))
                else:
                    rows.extend((k, w, w, n) for k in _key(w, wanted.value))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), pa.array(c[3], pa.int64())], names=["key", "text", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        for b in batches:
            rows = []
            for t, channel, n, words in zip(b.column("token").to_pylist(), b.column("channel").to_pylist(), b.column("n").to_pylist(), b.column("words").to_pylist()):
                edges = lost_edges(t, known) if channel == LOST_CHANNEL else accepted(t, utf8_edges(t, channel.removeprefix("utf-8 as "), known), known)
                best = restored_token(t, channel, edges, [(w["word"], w["n"]) for w in words or ()], n, known, total)
                if best:
                    rows.append((t, n, channel, *best, channel == LOST_CHANNEL))
            if rows:
                yield _proposals(rows)

    # few bytes, but much work a token: as many tasks as a shuffle has
    spread = tokens.repartition(parallelism(spark), "token")
    direct = spread.mapInArrow(propose, PROPOSAL)
    # tokens may be long: what moves by word or key is their hash
    asked = staged(spread.mapInArrow(ask, "token string, n long, channel string, asks array<struct<key:string,pattern:string>>").withColumn("id", F.unhex(F.md5(F.concat_ws("\n", "channel", "token")))))
    # letters that words are asked for by: no more than Unicode has
    letters = asked.select(F.explode("asks.key").alias("key")).where(F.col("key").rlike(r"^(\*C[0-9]|\+[^\x00-\x7F])")).select(F.substring("key", -1, 1).alias("c")).distinct().collect()
    wanted = spark.sparkContext.broadcast(frozenset(r["c"] for r in letters))
    each = asked.select("id", F.explode("asks").alias("a")).select("id", "a.key", "a.pattern")
    odd = F.col("unit").rlike(r"[^\x00-\x7F]")
    words = model.where(odd & F.col("unit").rlike(r"^\p{L}+$")).select(F.col("unit").alias("word"), "n", F.lit(False).alias("whole"))
    known_tokens = tokens.where(~F.contains("token", F.lit(LOST))).select(F.col("token").alias("word"), "n", F.lit(True).alias("whole"))
    vocabulary = words.unionByName(known_tokens).mapInArrow(index, "key string, text string, word string, n long")
    hits = each.select("key", "pattern").distinct().join(vocabulary, "key").where(F.expr("text rlike pattern")).select("key", "pattern", F.struct("word", "n").alias("w"))
    words_of = each.join(hits, ["key", "pattern"]).groupBy("id").agg(F.collect_set("w").alias("words"))
    fits = asked.select("id", "token", "channel", "n").join(words_of, "id", "left").select("token", "channel", "n", "words")
    searched = fits.mapInArrow(search, PROPOSAL)
    ways = staged(direct.unionByName(searched).withColumn("id", F.unhex(F.md5(F.concat_ws("\n", "channel", "token", "restored")))))

    sign = lambda c, s: F.transform(c, lambda u: F.struct(u.alias("unit"), F.lit(s).alias("sign")))
    parts = ways.select("id", F.when(F.col("mending"), F.col("n")).otherwise(0).alias("own"), F.explode(F.concat(sign(F.col("before"), -1), sign(F.col("after"), 1))).alias("p")).select("id", "own", "p.unit", "p.sign")
    # a token is as likely as its rarest unit: a sum over units would favour whatever has fewer of them. Where the
    # restored characters mend the letters around them, what only this token holds is no evidence for its being proper
    seen = F.coalesce(F.col("n"), F.lit(0)) - F.when(F.col("sign") == -1, F.col("own")).otherwise(0)
    rarest = lambda s: F.log(F.greatest(F.min(F.when(F.col("sign") == s, seen)), F.lit(0)) + 0.1)
    odds = parts.join(model, "unit", "left").groupBy("id").agg((rarest(1) - rarest(-1)).alias("by_units"))
    m = tokens.select(F.col("token").alias("restored"), F.col("n").alias("m"))
    whole = ways.select("id", "token", "n", "channel", "restored", "bonus", "weak").join(m, "restored", "left").join(odds, "id", "left")
    by_token = F.when(F.col("m").isNotNull(), F.log((F.col("m") + 0.1) / (F.col("n") + 0.1)))
    gain = F.when(F.col("channel") == LOST_CHANNEL, MIN_GAIN).otherwise(F.greatest(by_token, F.coalesce("by_units", F.lit(0.0)) + F.col("bonus")))
    return whole.select("token", "channel", "restored", gain.alias("gain"), "weak").where(F.col("gain") > 0)


def damaged_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, channel, gain, tokens) of every damaged document under its likeliest channel, and its (doc_id, token, restored).

    Null and ASCII-only texts are no case. Null ids are left out. Repeated ids are judged together. A document with lost
    characters is damaged even if nothing of it can be restored; its channel is then `lost characters`. A U+FFFD that stands
    alone, as in a text about it, is no damage.
    """
    hashed = docs.where(F.col(doc_id).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("key"), F.col(text).alias("text"))
    holders = hashed.select("doc_id", "key").distinct()
    # every text once, whatever the number of its copies; their verdict goes back to all of them
    pairs = staged(document_tokens(hashed, "key", "text").select(F.col("doc_id").alias("key"), "token").distinct())
    tokens = staged(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    gains = staged(token_gains(tokens))
    found = pairs.join(small(gains), "token").select("key", "token", "channel", "restored", "gain", F.when(F.col("weak"), 0.0).otherwise(F.col("gain")).alias("evidence"))
    lost = F.col("token").rlike(rf"\p{{L}}{LOST}|{LOST}\p{{L}}|{LOST}{LOST}")
    holes = pairs.where(F.contains(F.col("token"), F.lit(LOST)) & lost).select("key", "token", F.lit(LOST_CHANNEL).alias("channel"), F.lit(None).cast("string").alias("restored"), F.lit(MIN_GAIN).alias("gain"), F.lit(MIN_GAIN).alias("evidence"))
    evidence = found.unionByName(holes).join(holders, "key").drop("key")
    per = evidence.groupBy("doc_id", "channel").agg(F.sum("evidence").alias("gain"), F.count("restored").alias("tokens")).where(F.col("gain") >= MIN_GAIN)
    # of the many legacy pairs one fits by chance sooner than one of the few that spell UTF-8
    rank = F.col("gain") - F.when(F.startswith("channel", F.lit("utf-8")), 0.0).otherwise(math.log(len(LEGACY)))
    best = per.groupBy("doc_id").agg(F.max_by(F.struct("channel", "gain", "tokens"), F.struct(rank, "channel")).alias("b")).select("doc_id", "b.*")
    # a token is restored by the channel that explains most of its document
    hold = per.select("doc_id", "channel", rank.alias("all"))
    fixes = evidence.where(F.col("restored").isNotNull()).join(hold, ["doc_id", "channel"]).groupBy("doc_id", "token").agg(F.max_by("restored", F.struct("all", "gain", "restored")).alias("restored"))
    return best, fixes


def restored_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, channel, text): damaged documents with every restorable token put right; the rest of the text is untouched."""
    best, fixes = damaged_documents(docs, doc_id, text)
    maps = fixes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "restored"))).alias("fix"))  # no more than one text's tokens
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(best.select("doc_id", "channel"), "doc_id").join(maps, "doc_id", "left")
    token = re.compile(TOKEN)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [token.sub(lambda m, f=dict(f or ()): f.get(m[0], m[0]), t) for t, f in zip(b.column("text").to_pylist(), b.column("fix").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("channel"), pa.array(texts, pa.string())], names=["doc_id", "channel", "text"])

    return rows.select("doc_id", "channel", "text", "fix").mapInArrow(put, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, channel string, text string")
