"""Every query over tables with nulls, repeats, odd texts and clashing columns, and over empty ones."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import decontaminate, near_dup, packing, token_count
from weftgraph.llm import queries as q

LONG = " ".join(f"wort{k % 997} und" for k in range(30_000))  # 60,000 words
COPY = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, COPY, "en", "s", 1), (1, COPY, "en", "s", 1), (2, COPY.upper(), "en", None, None), (3, None, "en", "s", 0), (4, "", None, "s", 0),
    (5, "12 34 ... !!!", "de", "s", 9), (None, COPY, "en", "s", 1), (None, None, None, None, None), (7, LONG, "de", "s", 1), (8, "a", "fr", "s", 1),
    (9, "日本語 текст \x1c\t<|endoftext|>", "fr", "s", 1), (10, "you are a fool. nice day", "en", "s", 1),
]
CLASHING = ["row", "found", "n_words", "part", "number", "label", "id", "score", "held_out", "digest", "sequence_id", "url", "text", "token", "tokens", "embedding", "x", "node", "at", "word", "blocked"]


def _tables(spark, folder, rows: bool):
    keep = lambda x: x if rows else []
    docs = spark.createDataFrame(keep(DOCS), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    tables = {
        "documents": docs,
        "benchmark": spark.createDataFrame(keep([(1, "zero ONE two three four five six seven eight nine ten"), (2, "fool."), (None, "nice day"), (3, None), (2, "fool.")]), "item_id bigint, text string"),
        "labels": spark.createDataFrame(keep([(10, 1, 1), (1, 1, 0), (2, None, 0), (None, 1, 1), (8, 0, None), (10, 1, 1)]), "doc_id bigint, quality int, toxic int"),
        "embeddings": spark.createDataFrame(
            keep([(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [float("nan"), 1.0], 1), (7, [1.0], 1), (8, [1.0, None], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [], 1)]),
            "vec_id bigint, embedding array<float>, label int",
        ),
        "pages": spark.createDataFrame(keep([(1, "http://WWW.Example.com/en/a", ""), (2, None, None), (3, "no url", "x"), (3, "no url", "x"), (None, "https://x.net/es/1?a=b", ""), (5, "http://example.com", ""), (6, "x://notexample.com/en/", "")]), "page_id bigint, url string, html string"),
        "conversations": spark.createDataFrame(keep([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "<|im_end|>"), (None, 0, "user", "x"), (3, 1, None, "b"), (3, 1, None, "a"), (3, None, "assistant", "<|"), (1, 1, "assistant", None)]), "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, df in tables.items():
        for c in CLASHING:
            if c not in df.columns:
                df = df.selectExpr("*", f"'x' as {c}")
        df.write.parquet(f"{folder}/{name}.parquet")
    return f"{folder}"


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("messy"), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.mark.parametrize("name", list(q.queries()))
def test_empty_tables(spark, empty, name):
    rows = q.queries()[name](spark, empty).collect()
    assert len(rows) == (1 if name.startswith("op10") else 0)  # conversation -1 is the query's own


def rows(spark, messy, name, key):
    got = q.queries()[name](spark, messy).collect()
    return got, {r[key]: r for r in got}


def test_contamination(spark, messy):
    got, by = rows(spark, messy, "op1_decontamination", "doc_id")
    assert len(got) == len(DOCS)
    assert (by[1]["n_words"], by[1]["n_hit"], by[1]["n_items"], by[1]["contaminated"]) == (12, 10, 1, True)
    assert (by[10]["n_hit"], by[10]["n_items"]) == (3, 2) and by[3]["n_words"] == 0 and by[7]["n_words"] == 60_000
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    bench = spark.read.parquet(f"{messy}/benchmark.parquet")
    many = decontaminate.contamination(docs.select("doc_id", "text"), bench, block_bytes=8).select("doc_id", *decontaminate.verdict(decontaminate.F.col("found"))).collect()
    assert sorted(map(str, many)) == sorted(map(str, got))  # the benchmark in blocks
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 5


def test_packing(spark, messy):
    got, _ = rows(spark, messy, "op2_packing", "doc_id")
    pieces = [r for r in got if r["doc_id"] == 7]
    assert sorted(r["start"] for r in pieces) == [4096 * r for r in range(len(pieces))] and all(r["length"] == 4096 for r in pieces if r["piece"] < len(pieces) - 1)
    assert [r["length"] for r in got if r["doc_id"] in (3, 4)] == [1, 1] and len(got) == len(DOCS) - 1 + len(pieces)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)


def test_near_duplicates(spark, messy):
    got, by = rows(spark, messy, "op4_minhash_groups", "doc_id")
    assert len(got) == len(DOCS) and by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert (by[3]["n_shingles"], by[3]["component_id"]) == (0, 3) and by[8]["n_shingles"] == 1
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2


def test_clusters_beyond_a_block(spark, monkeypatch):
    """A cluster of several blocks, regions beyond their size, and links through one hub alone."""
    base = [f"w{k}" for k in range(100)]
    rows_ = [(0, " ".join(base))]
    rows_ += [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(4, 64)]
    rows_ += [(1000 + k, " ".join(f"u{k}x{j}" for j in range(40))) for k in range(30)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(docs, shingle=3, over=85, under=100).collect()}
    assert {got[k] for k, _ in rows_[:61]} == {0} and all(got[1000 + k] == 1000 + k for k in range(30))


def test_token_counts(spark, messy):
    got, by = rows(spark, messy, "op5_token_counts", "doc_id")
    assert len(got) == len(DOCS) and (by[3]["n_tokens"], by[4]["n_bytes"]) == (0, 0) and by[7]["over_limit"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(LONG) > 4 * token_count.CHUNK  # it is spliced from several chunks
    for doc_id, text, *_ in DOCS:
        if doc_id is not None:
            assert by[doc_id]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)


def test_embeddings(spark, messy):
    got, by = rows(spark, messy, "op6_embedding_groups", "vec_id")
    assert len(got) == 12
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert links[1] == (2, 1, True) and links[2] == (2, 1, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10):
        assert links[k] == (0, k, True)
    assert links[None] == (0, None, True)


def test_urls(spark, messy):
    got, by = rows(spark, messy, "op7_url_filter", "page_id")
    assert len(got) == 7
    assert [by[k]["rule"] for k in (1, 2, 3, None, 5, 6)] == ["www.example.com/en/", None, None, "net/es/", None, "com/"]
    assert (by[1]["host"], by[1]["path"], by[2]["host"], by[5]["path"]) == ("www.example.com", "/en/a", "", "")


def test_models(spark, messy):
    got, by = rows(spark, messy, "op8_language", "doc_id")
    assert len(got) == len(DOCS) and by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und"
    got, by = rows(spark, messy, "op9_toxicity", "doc_id")
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    got, by = rows(spark, messy, "op3_lattice_score", "doc_id")
    assert len(got) == len(DOCS) and (by[3]["n_tokens"], by[8]["n_tokens"]) == (1, 2) and all(r["score"] < 0 for r in got)


def test_conversations(spark, messy):
    got, by = rows(spark, messy, "op10_chat_examples", "conv_id")
    assert set(by) == {-1, 1, 2, 3} and [by[k]["n_turns"] for k in (-1, 1, 2, 3)] == [2, 3, 1, 3]
    assert [by[k]["loss_chars"] for k in (-1, 1, 2, 3)] == [34, 0, 0, 2]


def test_pipeline_keeps_the_columns(spark, messy, empty):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, messy)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, messy).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
