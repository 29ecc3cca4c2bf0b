import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from murmur.llm import byte_bpe, token_counts, token_files
from murmur.session import scratch_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(str(PATH))
    return [x.ids for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    spec = open(PATH, encoding="utf-8").read()
    return byte_bpe.Encoder(spec, byte_bpe.character_classes(spec))


def test_encoder_equals_the_library_on_random_texts(encoder):
    rnd = random.Random(3)
    parts = list("  \n\t'sstmdrevlabAB12!?.,é中² ́½\x1c\x85͸") + ["'s", "'re", "'ll", " '", "<|endoftext|>", "   "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(4000)]
    ids, offsets = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library(texts)


@pytest.mark.parametrize("piece", [1, 40, 333])
def test_long_texts_in_pieces_have_the_same_ids(encoder, monkeypatch, piece):
    monkeypatch.setattr(byte_bpe, "PIECE", piece)
    rnd = random.Random(piece)
    parts = ["don't", "'s", "\n", "\n\n", " \n", "\n ", " ", "word", "é\n中", "12", "!?", "\x85", "\r\n"]
    for _ in range(40):
        text = "".join(rnd.choice(parts) for _ in range(300))
        ids, offsets = encoder.encode([text])
        assert ids.tolist() == library([text])[0] and offsets.tolist() == [0, len(ids)]
        assert "".join(encoder.pieces(text)) == text
    assert len(encoder.pieces("a\nb\n" * 500)) > 2


def test_cache_generations_keep_results(encoder):
    small = byte_bpe.Generations(limit=3)
    for i in range(10):
        small.put(i, bytes([i]))
    assert small.get([9, 8, 0]) == [b"\x09", b"\x08", None] and len(small.young) <= 3


def test_hash_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64))
    table = token_counts.HashTable.of(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.lookup(keys) == np.arange(len(keys))).all()
    assert (table.lookup(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_counts_equal_the_library(spark, edge, none):
    rows = token_counts.count_tokens(edge, PATH, limit=100).collect()
    want = {t: len(x) for t, x in zip([r.text for r in edge.collect()], library([r.text for r in edge.collect()]))}
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), want[r.text], want[r.text] > 100) for r in edge.collect())
    assert token_counts.count_tokens(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_pack_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(raw, bits, len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [1, 7, 16, 17])
def test_blocks_give_random_access(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1000).astype(np.uint32)
    raw, offsets = token_files.pack(ids, bits), np.arange(0, 1000, 64) * bits // 8
    for a, b in ((0, 1), (63, 65), (128, 128), (500, 1000), (0, 1000), (999, 1000)):
        assert (token_files.slice_ids(raw, bits, 64, offsets, a, b) == ids[a:b]).all()


def test_width_is_the_least():
    assert [token_files.width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_files_hold_the_library_ids_in_id_order(spark, edge, none):
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(edge, PATH, path, end_id=2, vocabulary_size=50_257, part_bytes=50_000)
    assert spark.read.parquet(f"{path}/segments").select("part").distinct().count() > 1
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((r.doc_id or 0, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
                  for r, x in zip(edge.collect(), library([r.text for r in edge.collect()])))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    seven = next(r for r in got if r.doc_id == 7)
    part = token_files.read_range(spark, path, seven.start + 5, 9000)
    assert part.tolist() == library([next(r.text for r in edge.collect() if r.doc_id == 7)])[0][5:9005]
    assert token_files.token_digest(none, PATH, 2, 50_257).count() == 0
