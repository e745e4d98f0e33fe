import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placeloom.llm import tokens

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def texts():
    rng = random.Random(7)
    words = ["the", "of", "Überéß", "12345", "don't", "we'll", "<|endoftext|>", "<|endof", "\n\n", "   ", "###", "東京", "🙂", "\t \n", "a" * 90, " ", "  x", "²"]
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|>y" * 40, " " * 3000, "z" * 5000, "é" * 2500, "\n" * 999 + "q"]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 700))))
    return out


def test_spliced_equals_whole(lib):
    tok, added = tokens.load(NAME)
    for t in texts():
        want = len(lib.encode(t, add_special_tokens=False))
        for chunk, overlap in ((64, 1), (100, 16), (500, 64)):
            assert tokens.count_spliced(tok, added, t, chunk, overlap) == want, (t[:80], chunk)


def test_counts_equal_library(lib):
    t = texts()
    assert tokens.counts(t, NAME, huge=2000, chunk=300, overlap=20) == [len(e) for e in lib.encode_batch(t, add_special_tokens=False)]


def test_frame(spark, lib):
    rows = [(1, None, 9), (1, None, 9), (2, "", 1), (3, "héllo wörld " * 9000, 2), (4, "<|endoftext|>", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens_ int")
    got = {r.doc_id: r for r in tokens.token_counts(df).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (0, 0, False)
    assert got[3].n_tokens == len(lib.encode(rows[3][1], add_special_tokens=False)) and got[3].over_limit
    assert got[4].n_tokens == 1 and got[4].n_bytes == 13 and got[4]["N_Tokens_"] == 3
    assert tokens.token_counts(df).count() == 5
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.load("word_bpe_49k.json")
