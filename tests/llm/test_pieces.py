import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from murmur.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(PATH))


@pytest.fixture(scope="module")
def encoder():
    model = open(PATH, "rb").read()
    return pieces.PieceEncoder(pieces.MergeTable(model), model)


def test_merge_rounds_equal_the_library(encoder, library):
    rnd = random.Random(5)
    parts = list("  \n\tsstmaaaaeeeeennniitttthhhbAB12!?.,é中²▁½\x00") + ["  ", "the", "ing", " a", "ation", "<s>", "</s>", "<0x41>", "\U0001f600", "    "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 4999, "ab" * 3000, " " * 1000, "the" * 2000, "\n" * 500, "", "\U0010ffff" * 3]
    ids, offsets = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library.encode(texts)


@pytest.mark.parametrize("piece", [1, 50])
def test_long_texts_in_pieces_have_the_same_ids(encoder, library, monkeypatch, piece):
    monkeypatch.setattr(pieces, "PIECE", piece)
    rnd = random.Random(piece)
    for _ in range(40):
        text = "".join(rnd.choice(["the ", "  ", "a", "▁", " ▁ ", "ing\n", "中", "word"]) for _ in range(200))
        ids, offsets = encoder.encode([text])
        assert ids.tolist() == library.encode(text) and offsets.tolist() == [0, len(ids)]


def test_merge_table_refuses_other_models():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.MergeTable(proto.SerializeToString())


def test_rows_and_digests(spark, edge, none, library):
    out = pieces.encode_decode(edge, PATH)
    assert set(out.columns) == {*edge.columns, "decoded"}  # the clashing column is replaced
    for r in out.collect():
        want = [*library.encode(r.text or ""), 2]
        assert r.ids == want and r.decoded == library.decode(want)
    digest = {r.doc_id: r for r in pieces.piece_digest(edge, PATH).collect()}
    for r in edge.collect():
        ids = [*library.encode(r.text or ""), 2]
        assert digest[r.doc_id].n_tokens == len(ids)
        assert digest[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(none, PATH).count() == 0
