import pytest

from codeweft.llm import encoding

LINES = ["Después de la sesión caducó la última petición", "Häufig genügt eine Änderung an der Oberfläche", "Après l’exécution, la fenêtre se ferme à côté", "Проверка нашла лишние связи между папками", "Każda ścieżka łączy węzły — źródło", "plain ASCII only, nothing to see"]


def corpus(spark, extra):
    data = [(i, f"{LINES[i % 6]}, item {i}", "x") for i in range(300)] + [(1000 + i, t, "x") for i, t in enumerate(extra)]
    return spark.createDataFrame(data, "doc_id long, text string, token string")


CASES = [
    (LINES[0].encode().decode("cp1252"), LINES[0]),
    (LINES[0].encode().decode("latin_1").encode().decode("latin_1"), LINES[0]),
    (LINES[1].encode().decode("mac_roman"), LINES[1]),
    (LINES[1].encode("cp1252").decode("cp437"), LINES[1]),
    (LINES[3].encode("cp1251").decode("cp1252"), LINES[3]),
    (LINES[4].encode().decode("cp850"), LINES[4]),
    (LINES[3].encode("cp866").decode("cp1251"), LINES[3]),
    (LINES[3].encode("koi8_r").decode("cp1251"), LINES[3]),
    (LINES[4].encode("iso8859_2", "ignore").decode("cp1252", "ignore"), LINES[4].replace("—", "")),
    (LINES[0].encode("cp1252").decode("utf-8", "replace"), LINES[0]),
]


def test_found_and_restored(spark):
    extra = [c for c, _ in CASES] + ["SÃO TRÊS AÇÕES: NÃO REMOVA", "Preço: 12 € ± 3 µs ≤ ≥ └── √x", None, "", "Ç Ù Û", "lost � only"]
    df = corpus(spark, extra)
    found = {r["doc_id"] for r in encoding.damaged_documents(df)[0].collect()}
    assert found == {1000 + i for i in range(len(CASES))}
    text = {r["doc_id"]: r["text"] for r in encoding.restored_documents(df).collect()}
    for i, (_, want) in enumerate(CASES):
        assert text[1000 + i] == want, i


def test_empty_and_ascii(spark):
    df = corpus(spark, [])
    assert encoding.damaged_documents(df.limit(0))[0].count() == 0
    assert encoding.damaged_documents(df.where("text like 'plain%'"))[0].count() == 0
    assert encoding.damaged_documents(df)[0].count() == 0


def test_repeated_and_very_long_texts(spark):
    bad = LINES[0].encode().decode("cp1252")
    df = corpus(spark, [("word " * 200000) + bad, bad]).unionByName(corpus(spark, ["", bad]).where("doc_id = 1001"))
    assert sorted(r["doc_id"] for r in encoding.damaged_documents(df)[0].collect()) == [1000, 1001]
    assert sorted(r["text"] for r in encoding.restored_documents(df).where("doc_id = 1001").collect()) == [LINES[0]] * 2


def known(text, n=5):
    return encoding.Known(dict.fromkeys((c for c in text if not c.isascii()), n))


@pytest.mark.parametrize("wrong", encoding.MULTIBYTE)
def test_lattice_round_trip(wrong):
    text = "śćé“—”関数"
    k = known(text)
    seen = text.encode().decode(wrong, "replace") if wrong != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    if encoding.LOST not in seen:
        edges = encoding.utf8_edges(seen, wrong, k)
        assert "".join(c for _, _, c in encoding.forced(seen, edges)) == text
        assert encoding.decode(seen, edges, {}, k, 1e6)[0] == text


def test_words_decide_over_characters():
    k = encoding.Known({"é": 50, "à": 60, "ç": 3, "ã": 9, "ñ": 9})
    for token, want, words in [("cafÃ�", "café", {"café": 4}), ("faÃ�ade", "façade", {"façade": 2}), ("voilÃ�", "voilà", {"voilà": 4, "voile": 90}), ("Ã�ca", "éca", {"éca": 2, "àca": 1})]:
        assert encoding.decode(token, encoding.utf8_edges(token, "cp1252", k), words, k, 1e4)[0] == want
    # without a word the commoner character, and what is not lost stays
    assert encoding.decode("xÃ�yz", encoding.utf8_edges("xÃ�yz", "cp1252", k), {}, k, 1e4)[0] == "xàyz"
    free = lambda t, w: encoding.decode(t, encoding.lost_edges(t, k), w, k, 1e4, guess=False)[0]
    assert free("caf�", {"café": 4}) == "café" and free("caf��", {"café": 4}) == "café" and free("caf�", {}) == "caf�"
    assert free("fa�ade,", {"façade": 1, "facade": 9}) == "façade,"


def test_many_lost_bytes_are_cheap():
    k = known("".join(map(chr, range(0x3040, 0x30FF))) + "".join(map(chr, range(0x4E00, 0x5E00))))
    token = "ã��" * 60 + "é" * 3
    edges = encoding.utf8_edges(token, "cp1252", k)
    assert len(encoding.decode(token, edges, {}, k, 1e6)[0]) == 63
    assert encoding.lost_lookups("x" + "�" * 5000) == set() and len(encoding.lost_edges("�" * 5000, k)) == 5000


def test_words_decide_in_the_corpus(spark):
    rows = [(i, f"la façade du café, voilà n {i}, déjà là") for i in range(20)] + [(100, "la faÃ�ade"), (101, "un cafÃ�"), (102, "voil�"), (103, "fa��ade"), (104, "il y a ZoÃ« ici"), (105, "IRMÃ»"), (106, "un 😀 rare"), (107, "un ðŸ˜€ gâché")]
    df = spark.createDataFrame(rows + [(120, "IRMÃ IRMÃ; IRMÃ, IRMÃ.")] + [(121 + i, f"IRMÃ {i}") for i in range(9)], "doc_id long, text string")
    found = {r["doc_id"] for r in encoding.damaged_documents(df)[0].collect()}
    assert found == {100, 101, 102, 103, 104, 107}
    text = {r["doc_id"]: r["text"] for r in encoding.restored_documents(df).collect()}
    assert [text[i] for i in (100, 101, 102, 103, 104, 107)] == ["la façade", "un café", "voilà", "façade", "il y a Zoë ici", "un 😀 gâché"]


@pytest.mark.parametrize("first,second", [("mac_roman", "cp437"), ("cp437", "cp850"), ("cp437", "mac_roman"), ("cp437", "cp437")])
def test_two_layers(spark, first, second):
    bad = LINES[1].encode().decode(second).encode().decode(first)
    df = corpus(spark, [bad])
    assert [r["text"] for r in encoding.restored_documents(df).collect()] == [LINES[1]]


def test_replacement_character_alone_is_no_damage(spark):
    clean = ["Show � only when a byte is really lost", "the mark (�) and '�', �", "U+FFFD � — see fenêtre"]
    df = corpus(spark, [*clean, "p�r�m�s � x", "�� ���"])
    assert {r["doc_id"] for r in encoding.damaged_documents(df)[0].collect()} == {1003, 1004}
    assert all("�" in r["text"] for r in encoding.restored_documents(df).collect())


def test_copies_of_a_garbled_text_stay_found(spark):
    bad = [LINES[3].encode("cp1251").decode("cp1252")] * 150
    df = corpus(spark, bad)
    assert {r["doc_id"] for r in encoding.damaged_documents(df)[0].collect()} == {1000 + i for i in range(150)}
    assert {r["text"] for r in encoding.restored_documents(df).where("doc_id >= 1000").collect()} == {LINES[3]}


KEY = "человеконенавистничество"
GERMAN = "Donaudampfschifffahrtsgesellschaftskapitänswitwenrente"
RUSSIAN = "превысокомногорассмотрительствующийпревосходительство"
CJK = "本関数引数二個受取" * 5 + "和返却"


def lost(word, *places):
    """The word with U+FFFD for the bytes of the characters at these places: one, or as many as the bytes if the place is negative."""
    holes = {abs(p): "�" * (len(word[abs(p)].encode()) if p < 0 else 1) for p in places}
    return "".join(holes.get(i, c) for i, c in enumerate(word))


WITH_HOLES = [
    # no ASCII letter left to look by: first, last, or only inner letters known; several lost bytes a letter
    ("Проверка", lost("Проверка", 4)),
    ("Проверка", lost("Проверка", -2, -5)),
    ("Проверка", lost("Проверка", 7)),
    ("Проверка", lost("Проверка", 0, 3)),
    ("Проверка", lost("Проверка", 0, 7)),
    # over 40 letters: ASCII around the hole, none at all, both ends lost
    (GERMAN, lost(GERMAN, GERMAN.index("ä"))),
    (GERMAN, lost(GERMAN, -GERMAN.index("ä"))),
    (RUSSIAN, lost(RUSSIAN, 3, -9, 45)),
    (RUSSIAN, lost(RUSSIAN, 0, len(RUSSIAN) - 1)),
    (CJK, lost(CJK, 20, -46)),
    # of few letters, but over 40 lost bytes
    (KEY, lost(KEY, *range(-22, -1))),
    (KEY, lost(KEY, 23, *range(-21, 0))),
    (KEY, lost(KEY, 23, *range(-21, 0), 0)),
]


def test_words_of_any_length_and_script_are_looked_up(spark):
    words = ["Проверка", "Переделка", GERMAN, RUSSIAN, CJK, KEY]
    rows = [(i, f"{w} {i}") for i, w in enumerate(words * 5)] + [(100 + i, f"см. {t}, {i}") for i, (_, t) in enumerate(WITH_HOLES)]
    utf8 = [RUSSIAN[:5].encode().decode("cp1251") + "С�" + RUSSIAN[6:].encode().decode("cp1251", "replace"), GERMAN.encode().decode("cp1252").replace("¤", "�")]
    rows += [(200 + i, f"{t}!") for i, t in enumerate(utf8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in encoding.restored_documents(df).collect()}
    assert [text[100 + i] for i in range(len(WITH_HOLES))] == [f"см. {w}, {i}" for i, (w, _) in enumerate(WITH_HOLES)]
    assert [text[200 + i] for i in range(2)] == [f"{RUSSIAN}!", f"{GERMAN}!"]


def test_lookups_find_every_word_that_fits():
    import random
    import re

    rng = random.Random(7)
    for _ in range(600):
        alphabet = rng.choice(["abé", "дж", "aд", "äöabcdefgh"])
        word = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 12, 39, 40, 41, 42, 60, 130])))
        odd = [i for i, c in enumerate(word) if not c.isascii()]
        gone = set(rng.sample(odd, rng.randint(0, len(odd)))) if rng.random() < 0.8 else set(odd[: rng.randint(0, len(odd))])
        if not gone or len(gone) == len(word):
            continue
        token = "".join("�" * rng.choice([1, 2, 4]) if i in gone else c for i, c in enumerate(word))
        # a symbol among the lost characters may end the word before, or begin it after, another
        token = rng.choice(["", "x�", "«", "��"]) + token + rng.choice(["", "�é", ".", "���"])
        asks = encoding.lost_lookups(token) | encoding.long_lookups(token)
        keys = set(encoding._key(word, frozenset(word)))
        patterns = [p.replace("\\x{", "\\U{") for k, p in asks if k in keys]
        patterns = [re.sub(r"\\U\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p) for p in patterns]
        assert any(re.search(p, word) for p in patterns), (word, token)


def test_lookups_stay_linear_in_the_token():
    for part in ("a�", "д�", "д�����", "x�����", "é�a"):
        one, ten = (encoding.lost_lookups(t) | encoding.long_lookups(t) for t in (part * 60, part * 600))
        assert sum(map(len, (p for _, p in ten))) <= 12 * sum(map(len, (p for _, p in one)))
    assert encoding.long_lookups("x" + "�" * 5000) == {("x*", r"^\x{78}"), ("+x", r"^\x{78}[^\x00-\x7F]{1,5000}")}
