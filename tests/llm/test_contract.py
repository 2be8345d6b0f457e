"""The opN_ queries themselves on the smallest tables: columns, row counts, and results by the libraries or plain Python."""

import hashlib
import os
import zlib

import pytest

from fieldmill.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
P = pytest.importorskip("public_tokenizers")
COLUMNS = {
    "op1_ngram_join": "doc_id n_shingles component_id", "op2_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_toxicity": "doc_id held_out score predicted", "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_quality_classifier": "doc_id held_out score predicted",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, texts, name):
    df = queries.queries()[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name == "op9_warc":
        assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    elif name == "op7_packing":
        assert {r.doc_id for r in rows} == set(texts)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name in ("op6_toxicity", "op10_quality_classifier"):
        n, rest = (5, 0) if name == "op6_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op2_token_counts":
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        assert all((r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id]))) and r.over_limit == (r.n_tokens > 4096) for r in rows)
    if name == "op5_bpe":
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for r in rows:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
