"""Ids from cached parts equal the library's ids of whole texts."""

import random

import numpy as np
import pytest

from veriset.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
ODD = ["", "J̌a Áb.", "ABC.DEF, g..", "ÀÉ.", "it's I'M,", "don't. x., a.b", "K.", "ſs.", "<|EndOfText|>", "3.5, 4.", "ﬁn.", "İs.", "ΑΣ. ΑΣ,", "a\x1cb", "é. É. é,", "×. ÷,", "a b", "straße, straße."]


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_are_the_librarys(file, kind):
    from tokenizers import Tokenizer

    own, library = Encoder(P.path(file), kind), Tokenizer.from_file(P.path(file))
    library.encode_special_tokens = True
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice("aBé.ÉÄ,' \n's3ß×́ !") for _ in range(draw.randint(1, 30))) for _ in range(3000)]
    own.parts.most = 20_000  # generations are passed on
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        got = own.encode([t.encode() for t in part])
        want = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert [bytes(g) for g in got] == want


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_are_read_as_by_default(file, kind):
    from tokenizers import Tokenizer

    own, library = Encoder(P.path(file), kind), Tokenizer.from_file(P.path(file))
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = ODD + [f"{a}{t}{b}" for t in added + [t.upper() for t in added] for a, b in (("", ""), ("see ", " here"), ("x", "y"), ("a\n", "\nb "), ("A  ", "."))]
    want = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [bytes(g) for g in own.encode([t.encode() for t in texts])] == want
    assert any(library.token_to_id(t) in np.frombuffer(w, "<u4") for t in added for w in want)


SIGNS = ["", ".", ",", "***", "?!", "'", "!'", "')", "....", "-", "\"", "<|>"]


def _words(n: int) -> list[str]:
    draw = random.Random(5)
    return ["".join(draw.choice("aetnrsoiéßñÀTzq") for _ in range(draw.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_words_with_signs_and_line_breaks_are_the_librarys(file, kind):
    from tokenizers import Tokenizer

    own, library = Encoder(P.path(file), kind), Tokenizer.from_file(P.path(file))
    draw = random.Random(7)
    words = _words(4000)
    texts = ["".join(draw.choice(words) + draw.choice(SIGNS) + draw.choice(" \n") for _ in range(draw.randint(0, 90))) + draw.choice(words) for _ in range(300)]
    own.parts.most = 60_000
    for at in range(0, len(texts), 50):
        got = own.encode([t.encode() for t in texts[at : at + 50]])
        assert [bytes(g) for g in got] == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[at : at + 50]]


def test_no_word_is_a_text_of_its_own_for_its_signs_or_its_line_break():
    """op4_token_records: to encode "word***" and "\\nWord" one text each took most of the time that such words took."""
    own, asked = Encoder(P.path("byte_bpe_50k.json"), "byte"), []
    call = own._call
    own._call = lambda texts: asked.extend(texts) or call(texts)
    words = _words(2000)
    own.encode([" ".join(w + s for w, s in zip(words, ["***", "?!", "$$$", ";"] * 500, strict=True)).encode(), "\n".join(words).encode()])
    assert len(asked) < 20


def test_a_merge_across_words_forbids_runs():
    own = Encoder(P.path("byte_bpe_50k.json"), "byte")
    vocab = own.tokenizer.get_vocab()
    assert own._run(vocab)[0] is not None
    assert own._run(vocab | {"eĠt": len(vocab)})[0] is None
    own.run = None
    assert own.encode([b"some plain words\nand lines"]) == Encoder(P.path("byte_bpe_50k.json"), "byte").encode([b"some plain words\nand lines"])
