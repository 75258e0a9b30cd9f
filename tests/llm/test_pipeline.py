from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from offerloom.llm import mixing, near, packing, quality
from offerloom.llm.common import stored
from offerloom.llm.queries import tokenizer_path


def test_each_stage_on_odd_documents(spark, odd_docs):
    """Each stage against what its operator says about the same input, from a plain second look."""
    columns, docs = odd_docs.columns, odd_docs
    after = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, ""), f"test-{name}")
        after[name] = (before, docs)
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]

    before, kept = after["quality_classifier"]
    said = Counter(r.text for r in quality.judge(before).where("accepted").collect())
    assert Counter(r.text for r in kept.collect()) == said

    before, kept = after["exact_dedup"]
    largest = {}
    for r in before.collect():
        largest[r.text] = max((x for x in (r.doc_id, largest.get(r.text)) if x is not None), default=None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((k, t) for t, k in largest.items()), key=repr)

    before, kept = after["minhash_near_dedup"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in near.near_duplicates(before).where("kept").collect())

    before, mixed = after["mix_sources"]
    copies = defaultdict(int)
    for r in mixing.mix_sources(before).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in copies.items() if n}

    before, packed = after["best_fit_packing"]
    pieces = Counter((r.doc_id, r.piece, r.length) for r in packed.collect())
    assert pieces == Counter((r.doc_id, r.piece, r.length) for r in packing.token_pieces(before, tokenizer_path()).collect())


def test_no_documents(spark, no_docs):
    docs = no_docs
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), f"none-{name}")
    assert docs.count() == 0


def test_run_reads_the_whole_table(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    docs = odd_docs
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), f"again-{name}")
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())
