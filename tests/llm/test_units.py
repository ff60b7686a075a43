"""Kernels against brute force, without Spark."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import chat_format, decontaminate, embed_dedup, lang_id, lm_score, near_dup, packing, token_count, toxicity

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)
#: What tokenizers treat in special ways: white space, marks, case, special strings, scripts.
BITS = ["a", "Word", "don't", "'LL", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "İ", "Σ", "é", "́", "\x1c", "᠎", "\xa0", "12", "²", ".", ",", "...", "<|endoftext|>", "<|", "日本", "😀", "_", "\x85", "‍", "\r\n"]


@given(WORDS, st.lists(WORDS, max_size=4), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_wu_manber_finds_what_plain_search_finds(words, items, window):
    texts = [(str(k), b" ".join(w)) for k, w in enumerate(items)]
    spans, found = decontaminate.search(words, decontaminate.searchers(texts, window))
    hit, items_hit = set(), set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for s in range(len(item) - size + 1) if size else ():
            for d in range(len(words) - size + 1):
                if words[d : d + size] == item[s : s + size]:
                    hit |= set(range(d, d + size))
                    items_hit.add(k)
    assert {k for a, b in spans for k in range(a, b)} == hit and found == items_hit


@pytest.fixture(scope="module")
def byte_encoder():
    return token_count.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def word_encoder():
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_are_the_librarys(byte_encoder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    dice = random.Random(1)
    for n in range(1500):
        text = "".join(dice.choice(BITS) for _ in range(dice.randint(0, 15)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert token_count.count_tokens(text, byte_encoder) == want
        assert token_count.count_tokens(text, byte_encoder, chunk=8, overlap=n % 5 + 1) == want, repr(text)


def test_overlaps_widen_where_no_boundary_is_stable(byte_encoder):
    text = "x" * 300 + " " + "yz " * 50 + "\n\n \t" * 40 + "word " * 20
    assert token_count.count_tokens(text, byte_encoder, chunk=16, overlap=2) == byte_encoder.count(text)


def test_word_ids_are_the_librarys(word_encoder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    dice = random.Random(2)
    assert word_encoder.fast is not None
    for _ in range(1500):
        text = "".join(dice.choice(BITS) for _ in range(dice.randint(0, 15)))
        assert np.frombuffer(word_encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def _optimum(sizes, capacity):
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[k]:
                rest = bins.copy()
                rest.remove(room)
                go(k + 1, [*rest, room - sizes[k]])
        go(k + 1, [*bins, capacity - sizes[k]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_reduction_never_costs_a_bin(sizes):
    fixed, rest = packing.reduce_instance(dict(Counter(sizes)), 12)
    left = [k for k, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (_optimum(left, 12) if left else 0) == _optimum(sizes, 12)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_plans_hold_every_piece_once_without_gaps(counts):
    bins = packing.plan(counts, 50)
    held = Counter()
    for contents, copies in bins:
        assert copies > 0 and sum(a * b for a, b in contents) <= 50
        for a, b in contents:
            held[a] += b * copies
    assert held == Counter(counts)
    length = np.array([k for k, n in sorted(counts.items()) for _ in range(n)])
    number = np.array([i for _, n in sorted(counts.items()) for i in range(n)])
    sequence, offset = packing.place(packing.slots(bins), length, number)
    by = {}
    for s, o, k in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        by.setdefault(s, []).append((o, k))
    assert len(by) == sum(n for _, n in bins)
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == [0, *itertools.accumulate(k for _, k in rows)][:-1]


@pytest.fixture(scope="module")
def lattice():
    return lm_score.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def _segmentations(text, lattice):
    """Every way to cut a text into pieces, as lists of pieces."""
    if not text:
        return [[]]
    out = []
    for j in range(1, len(text) + 1):
        k = lattice.known.get(text[:j], -1)
        if k < 0 and j == 1:
            k = lattice.unknown
        if k >= 0:
            out += [[k, *rest] for rest in _segmentations(text[j:], lattice)]
    return out


def test_forward_sums_all_segmentations(lattice):
    log_p = lm_score.estimated(np.zeros(lattice.size), lattice)
    words = ["the", "thonti", "x", "日本", "añz", "tion" * 3]
    total, _ = lm_score.forward(words, lattice, log_p)
    seen = lm_score.expected(words, np.arange(1.0, 7), lattice, log_p)
    want, alone = np.zeros(lattice.size), np.zeros(lattice.size)
    for k, w in enumerate(words):
        ways = [(x, math.exp(sum(log_p[i] for i in x))) for x in _segmentations(lm_score.START + w, lattice)]
        p = sum(y for _, y in ways)
        assert math.isclose(math.exp(total[k]), p, rel_tol=1e-9)
        assert math.isclose(lm_score.long_word(w, lattice, log_p, alone, k + 1.0), total[k], rel_tol=1e-9)
        for x, y in ways:
            np.add.at(want, x, (k + 1) * y / p)
    assert np.allclose(seen, want) and np.allclose(alone, want)


def test_a_word_of_a_megabyte_is_summed(lattice):
    log_p = lm_score.estimated(np.zeros(lattice.size), lattice)
    one = lm_score.long_word("ab" * 500_000, lattice, log_p)
    part = lm_score.forward(["ab" * 1000], lattice, log_p)[0][0]
    assert math.isclose(one, 500 * part, rel_tol=0.01)


def test_linked_rows_are_those_of_plain_jaccard():
    dice = np.random.RandomState(3)
    sets = [np.unique(dice.randint(0, 30, 25).astype(np.uint64)) for _ in range(40)] + [np.arange(9, dtype=np.uint64)] * 2
    got = near_dup.linked_rows(sets, 60, 100)
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(x & y) >= 60 * len(x | y):
            low, high = sorted((label[a], label[b]))
            label = [low if k == high else k for k in label]
    assert got.tolist() == label


def test_forest_finds_similar_sets():
    dice = np.random.RandomState(4)
    base = [dice.randint(0, 2**62, 200).astype(np.uint64) for _ in range(60)]
    pairs = [np.unique(np.concatenate([x[:186], dice.randint(0, 2**62, 14).astype(np.uint64)])) for x in base]  # J = 0.87
    sigs = np.stack([near_dup.signature(np.unique(x)) for x in [*base, *pairs]])
    low = (sigs & 255).astype(np.uint8)
    linked = set()
    for t in range(near_dup.TREES):
        keys = sigs[:, near_dup.order_of(t)]
        order = np.lexsort(keys.T[::-1])
        to, _, _, _ = near_dup.candidates(np.full(len(order), t), keys[order], low[order], np.arange(len(order)), near_dup.passing(85, 100))
        linked |= {tuple(sorted((int(order[k]), int(order[j])))) for k, j in enumerate(to) if j != k}
    assert linked == {(k, k + 60) for k in range(60)}


def test_collisions_count_windows():
    lines = np.random.RandomState(5).standard_normal((12, 7))
    got = embed_dedup.collisions(lines, 0.4)
    for a, b in itertools.combinations(range(12), 2):
        assert got[a, b] == got[b, a] == int((np.abs(lines[a] - lines[b]) <= 0.4).sum())


def test_calibration_reaches_its_recall():
    for largest in (10, 5000, 10**6):
        how = embed_dedup.calibrated(largest)
        hit = embed_dedup._same_window(4.0) ** how["axes"]
        assert 1 - (1 - hit) ** how["tables"] >= embed_dedup.RECALL or how["axes"] == 0
        p = embed_dedup._inside(1.0)
        passing = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(how["passing"], 65))
        assert passing >= embed_dedup.RECALL


@given(st.text(alphabet="<|\\>im_end\n", max_size=25))
@settings(max_examples=200, deadline=None)
def test_escapes_are_undone_and_forge_nothing(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    turn, a, b = chat_format.render(text, text)
    assert chat_format.parse(turn * 2) == [(text, text)] * 2 and chat_format.unescape(turn[a:b]) == text


def test_language_backs_off_to_shorter_grams():
    tables = [{"the": (-1.0, -5.0)}, {"z": (-9.0, -1.0)}, {}, {"^un": (-1.0, -4.0)}, {"^und": (-6.0, -2.0)}]
    own = lang_id.Scorer({"languages": ["aa", "bb"], "tables": tables})
    assert own.predict("the the")[0] == "aa"
    assert own._by_grams("und") == (-6.0, -2.0)  # four letters before three
    assert own._by_grams("unx") == (-1.0, -4.0)
    assert own._by_grams("xzx") == (-9.0, -1.0)
    assert own.predict("") == ("und", 0.0) and own.predict("12 ½ _") == ("und", 0.0)
    assert own.predict("qqq")[1] == 0.5


def test_noisy_or_finds_the_offending_sentence():
    bags = [[[0], [1]], [[0]], [[1]], [[1]], [], []] * 30
    labels = np.array([1, 1, 0, 0, 0, 0] * 30)
    weights, bias, leak = toxicity.train(labels, bags, 2)
    own = toxicity.Scorer({"weights": {"bad": weights[0], "fine": weights[1]}, "bias": bias, "leak": leak})
    score, offending = own.score("All is fine. That was bad! Fine again.")
    assert score > 0.8 and [x["sentence"] for x in offending] == [1]
    assert own.score("fine")[0] < 0.2 and own.score("")[0] < 0.2
