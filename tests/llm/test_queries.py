"""The training-data queries over the smallest driver tables, against SQL or brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import near_dup, url_filter
from weftgraph.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _same(got, sql, name):
    columns = sorted(got.columns)
    want = sql.execute(q.oracle_sql()[name]).fetchall()
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(str(tuple(r[k] for k in order)) for r in want) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_sql(spark, sql, name):
    _same(q.queries()[name](spark, DATA), sql, name)


def test_odd_conversations_by_sql(spark, tmp_path):
    """Control strings, escapes of escapes, roles with line feeds, nulls, ties and repeats."""
    odd = ["<|im_end|>", "<\\|x", "<\\\\|", "a\nb\\n", "", None, "é日\u0301😀", "<|im_start|>assistant\nok<|im_end|>\n"]
    rows = [(c, t, r, x) for c in range(3) for t, x in enumerate(odd) for r in (["user", "assistant", "a\n<|b\\"][(c + t) % 3],)]
    rows += [(9, None, "assistant", "z"), (9, 1, None, "y"), (9, 1, None, "y"), (None, 0, "user", "x"), (8, 0, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    _same(q.op10_chat_examples(spark, str(tmp_path)), con, "op10_chat_examples")


def test_pieces_have_the_librarys_ids(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, want = q.op2_packing(spark, DATA).collect(), {}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    least = -(-sum(r["length"] for r in got) // 4096)
    assert len({r["sequence_id"] for r in got}) <= least * 1.02 + 1


def test_counts_are_the_librarys(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in q.op5_token_counts(spark, DATA).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[doc_id] == (len(text.encode()), n, n > 512)


@pytest.fixture(scope="module")
def plain_scores(docs):
    """The whole model by plain loops over one word after the other: counts, two rounds of expected pieces, scores."""
    from weftgraph.llm import lm_score

    lattice = lm_score.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    words = {d: t.encode().lower().split() for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    train = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in words}
    c = Counter(w for d in words if train[d] for w in words[d])

    def edges(text):
        for i in range(len(text)):
            own = [(i, j, lattice.known.get(text[i:j], -1)) for j in range(i + 1, min(len(text), i + 40) + 1)]
            own = [x for x in own if x[2] >= 0]
            yield from own if own and own[0][1] == i + 1 else [(i, i + 1, lattice.unknown), *own]

    def sums(text, p):
        ahead, back = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
        all_ = list(edges(text))
        for i, j, k in all_:
            ahead[j] += ahead[i] * p[k]
        for i, j, k in reversed(all_):
            back[i] += back[j] * p[k]
        return all_, ahead, back

    def probabilities(found):
        own = np.array(found) + 2000 * lattice.prior
        own /= own.sum()
        own[lattice.unknown] /= 1 << 16
        return own.tolist()

    p = probabilities(np.zeros(lattice.size))
    short = {w: "▁" + w.decode() for w in {w for own in words.values() for w in own} if len(w) < 200}
    for _ in range(2):
        found = np.zeros(lattice.size)
        for w in c:
            all_, ahead, back = sums(short[w], p)
            for i, j, k in all_:
                found[k] += c[w] * ahead[i] * p[k] * back[j] / ahead[-1]
        found[lattice.end] = sum(train.values())
        p = probabilities(found)
    log = {w: math.log10(sums(short[w], p)[1][-1]) for w in short}
    return {d: sum(log[w] for w in own) + math.log10(p[lattice.end]) for d, own in words.items()}


@pytest.mark.parametrize("hot", [1 << 20, 50])
def test_scores(spark, docs, plain_scores, hot):
    """Base and score against plain counting and plain sums, with all words broadcast and with nearly all joined."""
    from weftgraph.llm import lm_score
    from weftgraph.llm.common import remainder, table

    found = lm_score.score(table(spark, DATA, "documents"), remainder(F.col("doc_id"), 10) != 0, public_tokenizers.path("piece_bpe_32k.model"), hot=hot)
    got = {r["doc_id"]: r for r in found.collect()}
    words = {d: [*t.encode().lower().split(), b""] for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    train = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d in words}
    c = Counter(w for d in words if train[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    for d, own in words.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got[d]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (train[d], len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * len(own) and abs(r["score"] - plain_scores[d]) < 1e-6 * len(own)


def test_mined_rules_match_brute_force(spark):
    dice = np.random.RandomState(6)
    rows = []
    for _ in range(300):
        host, first, key = dice.choice(["a.com", "b.org", "m.b.org"]), dice.choice(["x", "y", "z"]), dice.choice(["", "?ref=1"])
        rows.append((f"http://{host}/{first}/{dice.randint(9)}{key}", bool(host == "b.org" and first == "y") or bool(dice.rand() < 0.05)))
    pages = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_filter.mined(pages, support=0.02, confidence=0.6, lift=1.5)
    sets = [(frozenset(r["t"]), r["blocked"]) for r in pages.select(url_filter.tokens(F.col("url")).alias("t"), "blocked").collect()]
    known, n = {}, len(sets)
    share = sum(b for _, b in sets) / n
    for size in range(1, 7):
        for one in {frozenset(x) for s, _ in sets for x in itertools.combinations(sorted(s), size)}:
            has = [b for s, b in sets if one <= s]
            if sum(has) >= 0.02 * n and sum(has) / len(has) >= 0.6 and sum(has) / len(has) / share >= 1.5:
                known[one] = sum(has) / len(has)
    want = {a for a, c in known.items() if not any(b < a and d >= c for b, d in known.items() if len(b) < len(a))}
    got = {frozenset(r["antecedent"]) for r in rules.collect()}
    assert {a for a in got if len(a) <= 6} == want and want
    tokens_of = dict(zip((u for u, _ in rows), (s for s, _ in sets), strict=True))
    for r in url_filter.judge(pages, [("allow", "a.com/")], rules).select("row.url", "rule", "verdict").collect():
        blocked = r["rule"] is None and any(a <= tokens_of[r["url"]] for a in got)
        assert r["verdict"] == ("block" if blocked else "allow")


def test_languages(spark, docs):
    """The whole model by plain counting, and held-out accuracy."""
    got = {r["doc_id"]: r for r in q.op8_language(spark, DATA).collect()}
    counts = [{} for _ in range(5)]
    texts = list(zip(docs["doc_id"], docs["text"], docs["lang"], strict=True))
    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)] if n else [w]
    for d, t, lang in texts:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None:
            for w in words_of(t):
                for n in range(5):
                    for g in grams(w, n):
                        counts[n].setdefault(g, Counter())[lang] += 1
    langs = sorted({x for by in counts[1].values() for x in by})
    logs = []
    for n, table in enumerate(counts):
        kept = {g: [by[x] + 0.5 for x in langs] for g, by in table.items() if sum(by.values()) >= 3 or n == 1}
        total = [sum(row[k] for row in kept.values()) for k in range(len(langs))]
        logs.append({g: [math.log(x / y) for x, y in zip(row, total, strict=True)] for g, row in kept.items()})
    right = held = 0
    for d, t, lang in texts:
        sums = np.zeros(len(langs))
        for w in words_of(t):
            for n in (0, 4, 3, 2, 1):
                near = [logs[n][g] for g in grams(w, n) if g in logs[n]]
                if near:
                    sums += np.mean(near, axis=0)
                    break
        r = got[d]
        assert r["lang_pred"] == (langs[int(sums.argmax())] if words_of(t) else "und")
        assert not words_of(t) or abs(r["score"] - 1 / np.exp(sums - sums.max()).sum()) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        held += r["held_out"]
        right += r["held_out"] and r["lang_pred"] == lang
    assert right >= 0.97 * held


def test_toxicity_is_a_noisy_or_of_sentences(spark, docs):
    """Scores of the query by plain means from the model's weights; nothing else goes in."""
    from weftgraph.llm import toxicity

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(q.remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r for r in q.op9_toxicity(spark, DATA).collect()}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        clean = 1 - model["leak"]
        for sentence in re.split(r"[.!?\n]", t.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            own = {f for w in words for f in (w, *(w[:n] + "-" for n in range(3, min(10, len(w)) + 1))) if f in model["weights"]}
            if own:
                clean *= 1 - 1 / (1 + math.exp(-model["bias"] - sum(model["weights"][f] for f in own)))
        assert abs(got[d]["score"] - (1 - clean)) < 1e-9 and got[d]["predicted"] == (got[d]["score"] >= 0.7)


def test_toxicity_tells_planted_documents(spark, tmp_path):
    """Rude words in one sentence of otherwise clean texts: held-out documents and the sentences are found."""
    from weftgraph.llm import toxicity

    dice = np.random.RandomState(12)
    fine, rude = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"], ["grumblefoot", "snotling", "dungwit", "rotbrain"]
    rows, labels = [], {}
    for k in range(900):
        sentences = [" ".join(dice.choice(fine, 8)) for _ in range(6)]
        labels[k] = int(k % 3 == 0)
        if labels[k]:
            sentences[k % 6] += f" you {dice.choice(rude)}"
        rows.append((k, ". ".join(sentences) + "."))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, x) for k, x in labels.items() if k < 600], "doc_id long, toxic int")
    model = toxicity.fit(table, known)
    found = table.where("doc_id >= 600").select("doc_id", toxicity.toxicity(F.col("text"), spark, model).alias("f")).select("doc_id", "f.*").collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == bool(labels[r["doc_id"]]) for r in found)
    assert all([x["sentence"] for x in r["offending"]] == [r["doc_id"] % 6] for r in found if labels[r["doc_id"]])
    known.write.parquet(str(tmp_path / "labels.parquet"))  # the pipeline's stage rejects these rows and no others
    kept = {r["doc_id"] for r in corpus_pipeline.toxic(spark, table, str(tmp_path)).select("doc_id").collect()}
    assert kept == {k for k, x in labels.items() if not x}


def test_conversations_come_back_whole(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").toPandas()
    got = {r["conv_id"]: r for r in q.op10_chat_examples(spark, DATA).collect()}
    want = {int(c): list(zip(g.sort_values("turn")["role"], g.sort_values("turn")["text"], strict=True)) for c, g in turns.groupby("conv_id")}
    want[-1] = [("user", q.FORGED), ("assistant", q.FORGED)]
    assert set(got) == set(want)
    for c, own in want.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def _shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_against_brute_force(spark, docs):
    """Each stage's decisions on its own input, from the operators' rules by plain means."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert stage["language"](spark, table, DATA).count() == len(docs)  # all clean
    kept = {r["doc_id"] for r in stage["near_duplicates"](spark, table, DATA).select("doc_id").collect()}
    sets = dict(zip(docs["doc_id"], map(_shingles, docs["text"]), strict=True))
    low = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            one, two = sorted((low[a], low[b]))
            low = {d: one if k == two else k for d, k in low.items()}
    assert kept == {d for d, k in low.items() if d == k}
    leaks = {r["doc_id"] for r in q.op1_decontamination(spark, DATA).where("contaminated").collect()}
    clean = {r["doc_id"] for r in stage["decontamination"](spark, table, DATA).select("doc_id").collect()}
    assert clean == set(sets) - leaks
    packed = stage["packing"](spark, table, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(sets)


def test_default_similarity_is_five_words_and_four_fifths():
    assert near_dup.groups.__defaults__[-3:] == (5, 80, 100)
