"""Every registered query of the operators over the smallest tables: columns, kinds and rows; and what they agree on."""

import glob
import hashlib
import os

import pytest

from ratersight.llm import line_dedup, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
#: The first columns of each result, and the table of which it has a row for each row (None: other rows).
CONTRACT = {
    "op1_secret_scan": ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", "documents"),
    "op2_minhash_near_dedup": ("doc_id bigint, n_shingles bigint, component_id bigint, kept boolean", "documents"),
    "op3_token_files": ("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", "documents"),
    "op4_quality_gam": ("doc_id bigint, held_out boolean, score double, predicted int", "documents"),
    "op5_line_dedup": ("doc_id bigint, class_doc_id bigint, n_lines int, n_removed int, n_links bigint, kept_sha256 string", "documents"),
    "op6_web_archives": ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", "pages"),
    "op7_language_crf": ("doc_id bigint, held_out boolean, lang_pred string, score double", "documents"),
    "op8_best_fit_packing": ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", None),
    "op9_decontamination": ("doc_id bigint, item_id bigint, edits int, end bigint", None),
    "op10_spotsigs": ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", "documents"),
    "op11_vector_codes": ("vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string", "embeddings"),
    "op12_vector_dedup": ("vec_id bigint, n_links bigint, component_id bigint, kept boolean", "embeddings"),
    "op13_branch_merge": ("doc_id bigint, lang string, source string, text_sha256 string, n_clean bigint, n_edit_edit bigint, n_edit_delete bigint, n_insert_insert bigint", None),
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_all_are_registered():
    assert list(queries.QUERIES) == list(CONTRACT) and set(queries.ORACLE_SQL) <= set(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_result(spark, con, name):
    want, of = CONTRACT[name]
    out = queries.QUERIES[name](spark, SF)
    assert dict(x.split() for x in want.split(", ")).items() <= dict(out.dtypes).items()
    rows = out.collect()
    assert rows
    if of:
        key = out.columns[0]
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{of}.parquet").select(key).collect())
    if name in queries.ORACLE_SQL:
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def test_line_query_follows_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = {r.doc_id: r for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    got = queries.op5_line_dedup(spark, SF).collect()
    assert any(r.n_removed for r in got)
    for r in got:
        o = own[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256((o.text or "").encode()).hexdigest()
        assert (r.class_doc_id, r.n_lines, r.n_removed, r.n_links) == (o.class_doc_id, o.n_lines, o.n_removed, o.n_links)
        assert r.n_removed or r.class_doc_id == r.doc_id
