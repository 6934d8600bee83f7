import random
import re

from codeweft.llm import leakage

WORDS = [f"w{i}" for i in range(60)]


def test_spans_map_to_the_original(spark, rows):
    item = " ".join(f"q{i}" for i in range(20))
    text = "Intro,\n" + item.upper().replace(" ", " -- ") + "! end"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, " ".join(f"q{i}" for i in range(12)), "x"), (None, item, "x"), (1, text, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("it", item, "x"), ("it", item, "x"), ("short", "too few words", "x"), (None, item, "x"), ("nul", None, "x")], "item_id string, text string, doc_id string")
    got = leakage.leaked_spans(docs, items).collect()
    assert len(got) == 2
    for r in got:
        assert (r["doc_id"], r["item_id"], r["words"]) == (1, "it", 20)
        assert text[r["start"] : r["end"]] == item.upper().replace(" ", " -- ")
    assert rows(leakage.leaks(docs, items)) == [(1, "it")]
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_against_brute_force_and_in_sets(spark, monkeypatch):
    random.seed(4)
    items = {f"i{k}": " ".join(random.choices(WORDS, k=30)) for k in range(8)}
    docs = {}
    for d in range(60):
        t = random.choices(WORDS, k=40)
        if d % 2:
            src = random.choice(list(items.values())).split()
            n = random.randrange(9, 20)
            a = random.randrange(0, 30 - n)
            t[10:10] = src[a : a + n]
        docs[d] = ", ".join(t) + "; fin."
    win = lambda s: {tuple(w[i : i + 13]) for w in [re.findall("[a-z0-9]+", s.lower())] for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if win(t) & win(s)}
    assert 5 < len(want)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    it = spark.createDataFrame(list(items.items()), "item_id string, text string")
    assert {tuple(r) for r in leakage.leaks(df, it).collect()} == want
    monkeypatch.setattr(leakage, "GROUP", 2)
    monkeypatch.setattr(leakage, "HELD_BYTES", 100)
    assert {tuple(r) for r in leakage.leaks(df, it, set_words=65).collect()} == want


def test_long_text_and_non_ascii(spark):
    item = " ".join(f"a{i}" for i in range(15))
    docs = spark.createDataFrame([(1, "é " * 300000 + item), (2, item.replace("a3", "a3é")), (3, item.replace("a3 ", "a3 é "))], "doc_id long, text string")
    it = spark.createDataFrame([("x", item)], "item_id string, text string")
    assert sorted(r[0] for r in leakage.leaks(docs, it).collect()) == [1, 2, 3]


def test_runs_are_maximal_whatever_their_place():
    random.seed(9)
    for words in (1, 2, 5, 13):
        items = [(f"i{k}", " ".join(random.choices("abcd", k=random.randrange(1, 40)))) for k in range(6)] + [("i0", "a b c d a")]
        p = leakage.Passages(items, words)
        for _ in range(40):
            text = " ".join(random.choices("abcdx", k=50))
            seq = text.split()
            want = set()
            for i, t in items:
                own = t.split()
                for a in range(len(seq)):
                    for b in range(len(own)):
                        if a and b and seq[a - 1] == own[b - 1]:
                            continue
                        n = 0
                        while a + n < len(seq) and b + n < len(own) and seq[a + n] == own[b + n]:
                            n += 1
                        if n >= words:
                            want.add((i, 2 * a, 2 * (a + n) - 1, n))
            assert set(p.spans(text)) == want


def test_many_words_keep_the_branches_few():
    items = [(str(k), " ".join(f"w{(k * 40 + i) % 9001}" for i in range(40))) for k in range(500)]
    p = leakage.Passages(items, 13)
    assert p.places == 3 and {s[0] for s in p.spans(items[7][1])} >= {"7"} and p.spans(" ".join(f"w{9000 - i}" for i in range(100))) == []
