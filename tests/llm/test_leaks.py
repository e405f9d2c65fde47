import random
import re

import numpy as np

from mistrail.llm.leaks import LeakModel, find_leaks
from mistrail.llm.letters import letters
from mistrail.llm.wu_manber import WuManber

WORDS = "valve rotor spindle housing membrane bearing coupling against whether upon partial load claim hinge nozzle torque printed sketch affidavit undated tender prior copied into revised seminar paper final letter obvious applicant".split()


def sentence(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(7)
    text = "".join(rng.choice("abc") for _ in range(9000))
    patterns = sorted({text[i : i + rng.randint(12, 30)] for i in (rng.randrange(8900) for _ in range(80)) if i < 8960} | {"a" * 12, "abcabcabcabcabc"})
    search = WuManber([p.encode() for p in patterns], 12, 10)
    at, number = search.find(np.frombuffer(text.encode(), np.uint8))
    want = {(m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(f"(?={p})", text)}
    assert set(zip(at.tolist(), number.tolist())) == want


def test_letters():
    assert letters("Ｖalve <b>seat</b> ﬁt &amp; prec-\neded (102) É™".encode()) == b"valveseatfitpreceded"


def pairs(spark, documents, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(documents)], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)], "item_id long, item_text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").collect()}


def test_planted_passages(spark):
    rng = random.Random(8)
    item = sentence(rng, 80)
    other = sentence(rng, 60)
    filler = lambda: " ".join(sentence(rng, 60))
    passage = item[20:50]
    replaced = list(passage)
    for k in (4, 13, 22):
        replaced[k] = "zyx"
    retold = list(passage)
    for k in range(3, 30, 5):
        retold[k] = "zyx"
    numerals = " ".join(w + (" (102)" if k % 6 == 0 else "") for k, w in enumerate(passage))
    broken = " ".join(passage)
    documents = [
        filler() + ". " + " ".join(passage) + ". " + filler(),
        filler() + " " + " ".join(passage).upper().replace(" ", "\n") + "! " + filler(),
        filler() + " " + " ".join(replaced) + " " + filler(),
        filler() + " " + numerals + " " + filler(),
        filler() + " <p>" + broken[:40] + "-\n" + broken[40:90] + "</p><i> " + broken[90:] + "</i> " + filler(),
        filler() + " " + " ".join(retold) + " " + filler(),
        filler() + " " + " ".join(item[20:42]) + " " + filler(),
        filler(), None, "",
        " ".join(item),
        " ".join(item[:26]),
    ]
    assert pairs(spark, documents, [" ".join(item), " ".join(other), None, "", "too short"]) == {(k, 100) for k in (0, 1, 2, 3, 4, 10, 11)}


def test_empty_and_repeated(spark):
    rng = random.Random(3)
    text = " ".join(sentence(rng, 40))
    assert pairs(spark, [text, text], [text]) == {(0, 100), (1, 100)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    tests = spark.createDataFrame([(1, text)], "item_id long, item_text string")
    assert find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").collect() == []
    assert find_leaks(tests.toDF("doc_id", "text"), "doc_id", "text", tests.limit(0), "item_id", "item_text").collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(12)
    item = sentence(rng, 60)
    long = " ".join(sentence(rng, 900_000))
    assert len(long) > 6_000_000
    assert pairs(spark, [long + " " + " ".join(item) + " " + long[:500_000], long], [" ".join(item)]) == {(0, 100)}


def test_changed_numerals_are_replaced_words_and_added_ones_are_not(spark):
    rng = random.Random(21)
    words = sentence(rng, 60)
    for k, n in zip(range(5, 60, 5), ("57", "4.34", "12", "801", "9", "33", "7.5", "64", "210", "18", "96")):
        words[k] = n
    item, part = " ".join(words), words[10:45]
    changed = [str(int(float(w)) + 1) if w[0].isdigit() else w for w in part]
    one = [w if w != "801" else "802" for w in part]
    added = [w + " (40)" if k % 7 == 3 and not w[0].isdigit() else w for k, w in enumerate(part)]
    filler = " ".join(sentence(rng, 40))
    documents = [f"{filler} {' '.join(d)} {filler}" for d in (part, changed, one, added)]
    assert pairs(spark, documents, [item]) == {(0, 100), (2, 100), (3, 100)}


def test_passages_after_a_break_on_the_same_diagonal(spark):
    rng = random.Random(12)
    item = [f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate(sentence(rng, 100))]
    swapped = lambda first, at, last: " ".join([*item[first:at], item[at + 1], item[at], *item[at + 2 : last]])
    documents = [swapped(0, 10, 61), swapped(0, 30, 90), swapped(0, 10, 30)]
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    tests = spark.createDataFrame([(100, " ".join(item))], "item_id long, item_text string")
    got = {r.doc_id: r.n_words for r in find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").collect()}
    # Of the two swapped words one may count as replaced, so the passage has the words after the break and at most one more.
    assert set(got) == {0, 1} and 49 <= got[0] <= 50 and 58 <= got[1] <= 59


def lengths(spark, documents, item):
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    tests = spark.createDataFrame([(100, item)], "item_id long, item_text string")
    return {r.doc_id: r.n_words for r in find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text").collect()}


def test_two_close_replaced_words_of_the_same_length(spark):
    rng = random.Random(31)
    item = [f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate(sentence(rng, 90))]
    changed = lambda words, *at: " ".join("q" * len(w) if k in at else w for k, w in enumerate(words))
    got = lengths(spark, [changed(item[:47], 10, 11), changed(item[:60], 10, 13), changed(item[:34], 10, 13)], " ".join(item))
    assert set(got) == {0, 1} and got[0] >= 35 and got[1] >= 46


def test_a_replacing_word_of_any_length_and_one_near_the_end(spark):
    rng = random.Random(32)
    item = [f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate(sentence(rng, 40))]
    replaced = lambda at, word: " ".join([*item[:at], word, *item[at + 1 :]])
    documents = [replaced(20, "x" * 60), replaced(20, "x" * 5000), replaced(39 - 1, "zyx"), replaced(1, "w" * 300)]
    got = lengths(spark, documents, " ".join(item))
    assert got == {k: 40 for k in range(4)}
    # Many words in place of one are no replaced word.
    assert lengths(spark, [" ".join([*item[:20], *["xyz"] * 40, *item[21:]])], " ".join(item)) == {}


def test_short_words_and_numerals_only(spark):
    rng = random.Random(33)
    item = [rng.choice("abcdefghik") + rng.choice(["", "m", "n"]) for _ in range(60)]
    part = item[5:45]
    for k in range(7, 40, 8):
        part[k] = "zzz"
    assert set(lengths(spark, ["x y z " + " ".join(part), "a b c d e"], " ".join(item))) == {0}
    numbers = [str(rng.randint(10, 99)) for _ in range(60)]
    assert lengths(spark, [" ".join(numbers)], " ".join(numbers)) == {}


def test_scripts_other_than_latin(spark):
    kana = [chr(c) for c in range(0x3042, 0x3090)]
    rng = random.Random(34)
    words = ["".join(rng.choice(kana) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    cyrillic = ["".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(40)]
    passage = "、".join(words[10:40])
    replaced = "、".join([*words[10:20], "図面", *words[21:40]])
    documents = [f"前文。{passage}。後文", replaced, "、".join(words[10:30]), passage.replace("、", "。\n"), " ".join(cyrillic).upper()]
    assert set(lengths(spark, documents, "、".join(words))) == {0, 1, 3}
    assert set(lengths(spark, documents, " ".join(cyrillic))) == {4}
    assert letters("Größe 5 μm; α β".encode()) == letters("GrÃ¶ÃŸe 5 m".encode("utf-8")) and letters("λόγος".encode())


def test_markup_of_any_length_and_signs_that_are_none(spark):
    assert letters(b'one<p title="' + b"x" * 5000 + b'">two<!--' + b"y " * 5000 + b"-->three <!-- open") == b"onetwothreeopen"
    assert letters(b"if a <b then " + b"c " * 400 + b"> d") == b"ifabthen" + b"c" * 400 + b"d"
    assert letters("été".encode()) == letters("été".encode())


def test_every_verbatim_passage_is_found(spark, small):
    """By brute force: any 25 successive words of an item whose letters stand in a document's letters."""
    documents = {r.doc_id: letters(r.text.encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text}
    items = {r.item_id: [letters(w.encode()) for w in re.findall(r"\w+", r.item_text)] for r in spark.read.parquet(f"{small}/eval_items.parquet").collect() if r.item_text}
    want = {(d, i) for i, words in items.items() for d, text in documents.items() if any(b"".join(words[k : k + 25]) in text for k in range(len(words) - 24))}
    found = {(r.doc_id, r.item_id): r.n_words for r in find_leaks(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{small}/eval_items.parquet"), "item_id", "item_text").collect()}
    assert want and want <= set(found)


def brute_force(document, item, least=25, apart=8):
    """Longest stretch of words that agree on a diagonal, but for ones at least ``apart`` words apart; it begins and ends with words that agree."""
    best = 0
    for shift in range(-len(item), len(document)):
        first, wrong = None, []
        for k, word in enumerate(item):
            if 0 <= k + shift < len(document) and document[k + shift] == word:
                first = k if first is None else first
                best = max(best, k - first + 1)
            elif first is not None:
                if wrong and k - wrong[-1] < apart:
                    first, wrong = (wrong[-1] + 1, [k]) if wrong[-1] + 1 < k else (None, [])
                else:
                    wrong.append(k)
    return best if best >= least else 0


def test_replaced_words_equal_brute_force(spark):
    rng = random.Random(35)
    # A passage goes on after a replaced word where ten letters agree: here any one word has them.
    item = [f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}".rjust(12, "k") for k, w in enumerate(sentence(rng, 120))]
    documents = []
    for _ in range(60):
        first = rng.randrange(80)
        part = item[first : first + rng.randint(20, 70)]
        for _ in range(rng.randint(0, 6)):
            part[rng.randrange(len(part))] = rng.choice(["zyx", "q" * 70, "wxyz"])
        documents.append([*sentence(rng, 10), *part, *sentence(rng, 10)])
    got = lengths(spark, [" ".join(d) for d in documents], " ".join(item))
    want = {k: n for k, d in enumerate(documents) if (n := brute_force(d, item))}
    assert len(want) > 20 and set(want) <= set(got)
    # A replaced word at a passage's edge may count.
    assert all(abs(got[k] - n) <= 2 for k, n in want.items())
    # And blocks of items and scans change nothing.
    docs = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(documents)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:60])), (3, " ".join(sentence(rng, 50)))], "item_id long, item_text string")
    rows = lambda model: {tuple(r) for r in find_leaks(docs, "doc_id", "text", tests, "item_id", "item_text", model).collect()}
    assert rows(LeakModel()) == rows(LeakModel(block_bytes=1)) == rows(LeakModel(block_bytes=1, scan_bytes=700))
