"""What encoding costs, counted in calls, not in seconds."""

import itertools

import pytest

from rankloom.llm import bpe, chunked
from rankloom.llm.memo import PieceMemo
from rankloom.llm.queries import tokenizer_file

WORDS = ["".join(x) for x in itertools.islice(itertools.product("abé", "lmn", "oué", "rst", "aei"), 200)]


def ids_of(file, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(file))
    return [chunked.pack(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_go_to_the_library_together_and_marks_apart():
    enc = chunked.ChunkEncoder(tokenizer_file("word_bpe_49k.json"))
    tok, asked = enc.tok, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    enc.tok = Counted()
    texts = [" ".join(w + mark for w in WORDS) for mark in ("", "%%%", "&&&", ".,", "'s", "1")]
    assert enc.encode_many(texts) == ids_of("word_bpe_49k.json", texts)
    assert len(asked) < 2 * len(WORDS)


def test_words_of_latin_letters_need_no_pattern():
    codec = bpe.ForcedBoundaryBPE(tokenizer_file("byte_bpe_50k.json"))
    split, asked = codec.split, []
    codec.split = lambda t: asked.append(t) or split(t)
    texts = [" ".join(WORDS), " ".join(w + "×÷" for w in WORDS[:5]), " ".join(w.upper() for w in WORDS)]
    assert codec.encode_many(texts) == ids_of("byte_bpe_50k.json", texts)
    assert len(asked) <= 10


def test_memo_after_an_error():
    def encode(pieces):
        if "bad" in pieces:
            raise ValueError
        return [p.encode() for p in pieces]

    memo = PieceMemo(encode, most=4, longest=3)
    with pytest.raises(ValueError):
        memo.join([["a", "bad"]])
    assert [memo.join([["a", "longer", "b", "a"], ["c", x]]) for x in "defa"] == [[b"alongerba", b"c" + x.encode()] for x in "defa"]
