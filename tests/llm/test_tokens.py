from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loanline.llm.tokens import _BLOCK_SQL, PreTokens, _blocks, _packed, _unpacked, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def fixture():
    draw = random.Random(9)
    odd = ["É", "ǆ", "İ", "ß", "ſ", "ΑΣ", "é", "́", "漢字", "😀", " ", " ", "\x0b", "\x1c", "½", "²", "ª", "٣", "'s", "'S", "'re", "''ll", "…", "–", "“x”", "×", "÷", "K", "�", "\x00", "ŉ", "İi", "Å"]
    plain = ["the", "Thing", "naïve", "don't", "x1y22", "!!", "--", "a.b", "ÜBER", "\n", "\t", "  "]
    rows = [(i, "".join(draw.choice(plain if i % 2 else plain + odd) + draw.choice(["", " "]) for _ in range(draw.randrange(60)))) for i in range(300)]
    rows += [(i + 1000, chr(c) + "a" + chr(c)) for i, c in enumerate([*range(0x20, 0x500), *range(0x2000, 0x2070)])]
    rows += [(5000, None), (5001, ""), (5002, "a<|endoftext|>B <|startoftext|><|endoftext|>"), (5003, "<|ENDOFTEXT|> <|endoftext"), (5004, "word " * 60000)]
    return rows + [(None, "no id"), (3, rows[3][1]), (3, "other")]


@pytest.mark.parametrize("name", FILES)
def test_against_the_library(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = fixture()
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, block string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame, path).collect()), key=str)
    want = []
    for doc, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_each_pretoken_is_one_of_its_own():
    pretokens = PreTokens(PATH)
    for _, text in fixture():
        for word in pretokens(text or "")[0]:
            assert len(pretokens.tokenizer.pre_tokenizer.pre_tokenize_str(word)) == 1


def test_files_without_normalizer_special_strings_or_pretokenizer(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        setup = json.load(file)
    texts = ["A sentence, of 10 words.", "漢字 😀", "", "a<|endoftext|>b"]
    for part in ("pre_tokenizer", "added_tokens"):
        path = tmp_path / f"{part}.json"
        path.write_text(json.dumps(setup | {part: None if part == "pre_tokenizer" else []}))
        pretokens, library = PreTokens(str(path)), Tokenizer.from_file(str(path))
        for text in texts:
            found, special = pretokens(text)
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert special + sum(n * pretokens.pieces(word) for word, n in found.items()) == want
    greedy = [setup["added_tokens"][0] | {"lstrip": True}]
    path = tmp_path / "greedy.json"
    path.write_text(json.dumps(setup | {"added_tokens": greedy}))
    with pytest.raises(ValueError, match="endoftext"):
        PreTokens(str(path))


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_blocks_are_joined_compressed(spark):
    """A task holds its blocks whole where they are joined: less than two bytes for a pre-token of a document, in place of eight."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "or", "ist", "und", "elle")]
    rows = [(str(i), " ".join(draw.choices(words, k=200))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    sizes = frame.mapInArrow(_blocks(PATH), _BLOCK_SQL).selectExpr("length(places) + length(times) AS n").collect()
    assert sum(r["n"] for r in sizes) < 2 * sum(len(set(text.split())) for _, text in rows)
    for values in ([], [0], [7, 2**31 - 1, -(2**31)], list(range(1000))):
        assert _unpacked(_packed(np.array(values, np.int32))).tolist() == values
