"""The pipeline's stages one after another, each against brute force on what the one before kept."""

import hashlib

import public_tokenizers
import pytest
from odd_rows import ODD
from test_dedup import exact_brute, groups_brute
from test_text import mix_brute, tiktoken_of

import corpus_pipeline
from copresence.llm import common, language_id, queries, tree_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What goes into the first stage and what each stage returns."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.saved(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_columns_and_whole_rows(kept):
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after.columns == before.columns
        assert set(rows(after)) <= set(rows(before)) and after.count() == len(set(rows(after)))


def test_language(kept):
    judged = language_id.identify(kept[0], language_id.fit(kept[0])).collect()
    assert {r["doc_id"] for r in kept[1].collect()} == {r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.35}
    assert kept[1].count() >= 0.95 * kept[0].count()


def test_exact(kept):
    want = {keep for _, keep, _, _ in exact_brute([(r["doc_id"], r["text"]) for r in kept[1].collect()])}
    assert {r["doc_id"] for r in kept[2].collect()} == want and len(want) < kept[1].count()


def test_near(kept):
    want = {low for _, _, low in groups_brute([(r["doc_id"], r["text"]) for r in kept[2].collect()])}
    assert {r["doc_id"] for r in kept[3].collect()} == want


def test_mix(kept):
    def domain(source):
        return "hub" if source == "src0" else "odd" if source and int(source[3:]) % 2 else "even"

    docs = [(r["doc_id"], r["text"], domain(r["source"]), r["lang"], r["source"]) for r in kept[3].collect()]
    taken = mix_brute(docs, queries.MIX_SHARE, {"domain": queries.DOMAIN_WEIGHTS, "lang": queries.LANG_WEIGHTS}, 1)
    assert {r["doc_id"] for r in kept[4].collect()} == {t[0] for t in taken} and 0 < len(taken) < len(docs)


def test_encode(kept):
    library = tiktoken_of(tree_bpe.vocabulary(public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN))
    want = {}
    for r in kept[4].collect():
        ids = library.encode_ordinary(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), ids)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in kept[5].collect()} == want


def test_odd_documents(spark, odd, table):
    """Nulls, empty and repeated rows and clashing names go through all stages; an empty table does too."""
    for docs in (odd, table([])):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.saved(stage(spark, now, SF), "test-stage")
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count() <= len(ODD)
