import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from tablewright.llm.queries import COUNTING_VOCABULARY, QUERIES
from tablewright.llm.tokencounts import BLANK, UnigramCounter, count_tokens, read_pieces
from tests.conftest import SF_DIR


def public_unigram(pieces, byte_pieces):
    vocabulary = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256) if byte_pieces], *pieces.items()]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_pieces))


@pytest.fixture(scope="module")
def whole():
    pieces, byte_pieces = read_pieces(COUNTING_VOCABULARY)
    assert byte_pieces and len(pieces) > 31_000
    return public_unigram(pieces, True)


def expected(tokenizer, text):
    return len(tokenizer.encode(BLANK + text.replace(" ", BLANK)).ids) if text else 0


def test_query_matches_the_tokenizer(spark, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: expected(whole, t) for i, t in docs.items()}


def test_odd_rows(odd_docs, no_docs, whole):
    rows = odd_docs.collect()
    got = count_tokens(odd_docs, COUNTING_VOCABULARY).collect()
    assert [r.n_tokens for r in got] == [expected(whole, r.text or "") for r in rows]
    assert count_tokens(no_docs, COUNTING_VOCABULARY).count() == 0


@pytest.mark.parametrize("text", ["  two  blanks ", "\n\n a\n b", "日本語 texts 😀😀", "tabs\tand more", "x" * 300, f"{BLANK}{BLANK}a", "é é"])
def test_odd_texts(whole, text):
    assert UnigramCounter(*read_pieces(COUNTING_VOCABULARY))(text)[0] == expected(whole, text)


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_ties(byte_pieces):
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -3.0, "c": -1.0, "bc": -2.0, f"c{BLANK}a": -2.0, BLANK: -1.0, "dd": -1.0}
    counter, tokenizer = UnigramCounter(pieces, byte_pieces), public_unigram(pieces, byte_pieces)
    for text in ["abc", "abcabc", "aabbcc", "bcabc ab c a", "xyz", "aéb", "éé dddd d", "c a c a"]:
        assert counter(text)[0] == expected(tokenizer, text), text


def test_pieces_are_those_of_the_file():
    model = sentencepiece.SentencePieceProcessor(model_file=COUNTING_VOCABULARY)
    pieces, _ = read_pieces(COUNTING_VOCABULARY)
    assert pieces[model.id_to_piece(300)] == model.get_score(300)
    assert "<s>" not in pieces and "<0x0A>" not in pieces
