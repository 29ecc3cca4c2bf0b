import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece
from murmur.llm import importance
from murmur.llm.common import stored

from .test_line_chunks import brute as brute_lines
from .test_minhash import brute as brute_components
from .test_winnowing import brute as brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_stage_keeps_what_the_sample_keeps(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in importance.importance_sample(steps[0], labels).collect() if r.kept}
    assert {d for d, _ in pairs(steps[1])} == kept and len(kept) < steps[0].count()


def test_line_stage_equals_brute_force(steps):
    want = {d: t for d, (t, gone, _) in brute_lines(pairs(steps[1])).items() if not gone or t.strip(" \t\n\r\x0b\x0c")}
    assert dict(pairs(steps[2])) == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect() if r.text != dict(pairs(steps[1]))[r.doc_id])


def test_near_copies_stage_equals_all_pairs(steps):
    label = brute_components(pairs(steps[2]), 5)
    assert {d for d, _ in pairs(steps[3])} == {d for d, c in label.items() if d == c}


def test_decontamination_stage_equals_all_windows(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, x in brute_windows(pairs(steps[3]), items).items() if x[-1]}
    assert {d for d, _ in pairs(steps[4])} == {d for d, _ in pairs(steps[3])} - dirty and dirty


def test_last_stage_encodes_and_decodes(steps):
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r.ids == [*sp.encode(r.text or ""), 2] and r.decoded == sp.decode(r.ids)


def test_columns_and_edge_rows(spark, steps, edge, none):
    for df in steps[:5]:
        assert df.columns == steps[0].columns
    for docs in (edge, none):
        now = docs
        for i, (name, stage) in enumerate(pipeline.STAGES):
            now = stored(stage(spark, now, SF), "edge")
            if i < 4:
                assert now.columns == docs.columns


def test_run_gives_the_stages_rows(spark, steps):
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in steps[5].collect())
