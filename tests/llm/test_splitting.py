import random
import re

from mistrail.llm.splitting import SplitModel, pieces_of, split_texts
from mistrail.llm.tokens import RULE, token_count, token_starts

MODEL = SplitModel(50, 8)


def text_of(rng, sentences=60):
    out = []
    for k in range(sentences):
        out.append(" ".join(rng.choice(["valve", "Größe", "3.5", "(12)", "図2", "e.g.", "x"]) for _ in range(rng.randint(2, 30))).capitalize() + ".")
        out.append(rng.choice([" ", "\n", "\n\n", f"\n{k}. ", " [0012] "]))
    return "".join(out)


def test_token_starts_equal_the_rule():
    rng = random.Random(1)
    for text in ["", " ", "a", "..a b--c", "ü_9 図に、\xad�‑x y", *[text_of(rng) for _ in range(20)], "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(3000))]:
        assert token_starts(text).tolist() == [m.start() for m in RULE.finditer(text)]


def test_pieces_fit_overlap_and_join_to_the_text():
    rng = random.Random(2)
    for _ in range(40):
        text = text_of(rng)
        tokens = RULE.findall(text)
        pieces = pieces_of(text, MODEL)
        own, at = "", 0
        for k, (first, size, start, end) in enumerate(pieces):
            assert RULE.findall(text[start:end]) == tokens[first : first + size] and size <= MODEL.limit
            if k:
                before = pieces[k - 1]
                assert first == max(0, before[0] + before[1] - MODEL.overlap)
            own += text[at:end]
            at = end
        assert own == text


def test_cuts_prefer_strong_boundaries():
    sentence = "Alpha beta gamma delta epsilon zeta eta theta iota. "
    text = (sentence * 4 + "\n\n") * 4
    for _, _, start, end in pieces_of(text, MODEL)[:-1]:
        assert text[:end].endswith("\n\n")


def test_one_long_sentence_is_cut_between_words():
    text = "word " * 500
    assert all(size <= 50 for _, size, _, _ in pieces_of(text, MODEL)) and len(pieces_of(text, MODEL)) >= 12


def test_documents(spark):
    long = "One two three. " * 400
    df = spark.createDataFrame([(1, long, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (None, long, "x"), (1, long, "x")], "doc_id long, text string, piece string")
    got = split_texts(df, "doc_id", "text").collect()
    assert {(r.doc_id, r.n_pieces) for r in got if r.n_pieces == 1} == {(2, 1), (3, 1), (4, 1)}
    assert all(r.n_tokens <= 1000 and len(RULE.findall(r.piece)) == r.n_tokens for r in got)
    assert split_texts(df.limit(0), "doc_id", "text").collect() == []
    assert {r.doc_id: r.n for r in df.select("doc_id", token_count(df.text).alias("n")).collect()} == {1: 1600, 2: 1, 3: 0, 4: 0, None: 1600}


def test_a_heading_goes_with_its_claims():
    text = "Body text goes on here with some words. " * 8 + "\n\nWhat is claimed is:\n\n1. A valve with a seat and a spring that holds it. \n2. The valve of claim 1, wherein the seat is round."
    cut = [end for _, _, _, end in pieces_of(text, SplitModel(80, 8))[:-1]]
    assert any(text[c:].startswith("What is claimed") for c in cut)


def test_a_very_long_text_is_split_in_time():
    text = "Alpha beta gamma delta epsilon. Zeta eta theta 12. " * 30_000
    pieces = pieces_of(text)
    assert max(size for _, size, _, _ in pieces) <= 1000 and pieces[-1][3] == len(text)
