"""Source mixing, collocations and spelling groups against plain computations over awkward and given tables."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

pytest.importorskip("patronage.llm.queries")

from patronage.llm import collocations, mixing, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, queue string, place int, n long, word string, size double"
GIVEN = "/root/testdata/sf0.001/documents.parquet"


def awkward_rows():
    rng = random.Random(9)
    stems = ["geschichte", "strasse", "Straße", "naïveté", "Übergang", "maintain", "keeping", "a", "of", "the", "×÷×÷×÷×", "日本"]

    def word():
        w = list(rng.choice(stems))
        if rng.random() < 0.15:
            w[rng.randrange(len(w))] = rng.choice("abcxyzéÉÿ")
        return "".join(w)

    rows = [(0, None, None, None), (1, "", "en", None), (2, " \t .,;\n", "en", "b"), (None, "keeping keeping " * 40, "en", None),
            (None, "keeping keeping " * 40, "en", None), (3, "x" * 3000 + " " + "aab" * 900, None, "é"), (3, "x" * 3000, "de", "é"),
            (4, "The the THE. the\tthe, the\rthe\x0bthe " * 30, "en", "a"), (5, "of the of the " * 2000, "en", "a")]
    for k in range(6, 120):
        text = "".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "-"]) for _ in range(rng.randrange(1, 150)))
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "é", "ﬀ", "😀", None])))
    rows += rows[20:40] + [(200, rows[30][1], "en", "b")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "q", 1, 7, "w", 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return awkward_rows(), table(spark, awkward_rows())


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(GIVEN).select("doc_id", "text", "lang", "source")
    return [tuple(r) for r in docs.collect()], docs


# --- mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), percent=150, most=2) -> dict:
    """Shares by weight, stopped and shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, budget = set(), percent / 100 * sum(sizes.values())
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return share | {s: most * sizes[s] for s in full}
        full |= above


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_mix(request, which):
    rows, docs = request.getfixturevalue(which)
    size = {k: len(brute.words(r[1])) for k, r in enumerate(rows)}
    sizes = collections.Counter()
    for k, r in enumerate(rows):
        sizes[r[3]] += size[k]
    goal = brute_targets(sizes)
    expected = collections.Counter()
    for s in sizes:
        own = sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (hashlib.md5(
            f"{'' if rows[k][0] is None else rows[k][0]}:{rows[k][1] or ''}".encode()).hexdigest(), size[k]))
        left = int(goal[s] + 1e-9)
        given_ = collections.Counter()
        for k in own * 2:
            given_[k] += min(size[k], left)
            left -= min(size[k], left)
        expected.update((rows[k][0], size[k], sizes[s], given_[k]) for k in own)
    found = mixing.taken(mixing.mixture(docs)).collect()
    assert collections.Counter((r.doc_id, r.size, r.source_size, r.taken) for r in found) == expected
    assert {round(r.target, 6) for r in found} == {round(float(g), 6) for g in goal.values()}
    assert all(r.taken <= 2 * r.size for r in found)


def test_mix_is_in_order_of_finish_times(awkward):
    """At every place of the mix the sources have given what their targets ask for, to within one document."""
    rows = mixing.mixture(awkward[1]).where("words > 0").orderBy("virtual_finish", "source", "start").collect()
    assert [r.taken > 0 for r in rows] == sorted([r.taken > 0 for r in rows], reverse=True)
    given_, longest = collections.Counter(), max(r.size for r in rows)
    for r in rows:
        if r.taken:
            given_[r.source] += r.taken
            goal = {x.source: x.target for x in rows}
            assert all(given_[s] >= goal[s] * r.virtual_finish - longest - 1 for s in goal)


def test_mix_edges(spark, awkward):
    nothing = awkward[1].limit(0)
    assert mixing.taken(mixing.mixture(nothing)).collect() == []
    blank = table(spark, [(1, None, None, "a"), (1, " ", None, "a"), (None, "", None, None)])
    found = mixing.taken(mixing.mixture(blank)).collect()
    assert sorted((r.size, r.target, r.taken) for r in found) == [(0, 0.0, 0)] * 3
    lone = mixing.taken(mixing.mixture(table(spark, [(7, "a b c", None, None)]))).collect()
    assert [(r.doc_id, r.target, r.taken) for r in lone] == [(7, 4.5, 4)]
    again = [sorted(map(repr, mixing.taken(mixing.mixture(awkward[1].repartition(k))).collect())) for k in (1, 7)]
    assert again[0] == again[1]


# --- collocations


def brute_collocations(rows, least, top=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p for p, a in f.items() if a >= least and len(p) > 1}
        kept = {p for p in cand if not any(100 * f[q] >= 80 * f[p] for q in cand if len(q) > len(p)
                                           and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))}
        scored = []
        for p in kept:
            cuts = [(2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("which,least,top", [("awkward", 30, 2000), ("awkward", 3, 2000), ("awkward", 3, 5), ("given", 4, 2000)])
def test_collocations(request, which, least, top):
    rows, docs = request.getfixturevalue(which)
    found = sorted(map(tuple, collocations.collocations(docs, least, top).collect()))
    assert found == brute_collocations(rows, least, top) and found


def test_parse_is_cut_within_long_pieces(spark):
    """Counts hold where chunks overlap, and copies at any place fall into the same chunks."""
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(60) for _ in range(4000)]
    rows = [(k, " ".join(words[:k] + words), "en", None) for k in range(4)]
    docs = table(spark, rows)
    parse = collocations.dictionary(docs).collect()
    assert sum(not r.last for r in parse) > 50 and sum(r.n > 1 for r in parse) > 50
    assert sorted(map(tuple, collocations.collocations(docs, 8).collect())) == brute_collocations(rows, 8)


def test_collocations_without_words(spark, awkward):
    assert collocations.collocations(awkward[1].limit(0)).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None, None), (2, " .\t", "en", None)])).collect() == []


# --- spelling


def brute_spelling(rows):
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c > 1}
    holes = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
    near = collections.defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            if k < len(w):
                near[w] |= holes[w[:k], w[k + 1:]]
                if w[:k] + w[k + 1:] in n:
                    near[w].add(w[:k] + w[k + 1:])
            near[w] |= holes.get((w[:k], w[k:]), set())
        near[w] -= {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_spelling(request, which):
    rows, docs = request.getfixturevalue(which)
    found = spelling.spelling_groups(docs).select("word", F.coalesce("form", F.lit("")), "root", "n", "n_near",
                                                  F.coalesce("form_n", F.lit(0))).collect()
    assert sorted(map(tuple, found)) == brute_spelling(rows)


def test_spelling_chains_and_repeated_letters(spark):
    """Forms lead on from form to form; a letter in a run of equal ones counts once; many words around one hole."""
    letters = "abcdefghijklmnopqrstuvwxyzàÿ"
    texts = ["wooooodland " * 2, "woooodland " * 25, "wooodland " * 300, "woodland " * 4000,
             *[f"pre{c}fix{'q' * 4} " * (2 + k) for k, c in enumerate(letters)], "prefixqqqq " * 900, "q" * 900 + " " + "q" * 901]
    rows = [(k, t, "en", None) for k, t in enumerate(texts * 2)]
    found = spelling.spelling_groups(table(spark, rows)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found) == brute_spelling(rows)
    by_word = {r.word: r for r in found}
    assert by_word["wooooodland"].root == "woodland" and by_word["wooooodland"].form == "woooodland"
    assert by_word["wooodland"].n_near >= 2 and by_word["prefixqqqq"].n_near >= len(letters)


def test_spelling_without_words(spark, awkward):
    assert spelling.spelling_groups(awkward[1].limit(0)).collect() == []
    assert spelling.spelling_groups(table(spark, [(1, None, None, None), (2, "short words", "en", None)])).collect() == []


def test_trie_numbers_follow_the_order_of_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randrange(7, 14))) for _ in range(800)})
    trie, nodes = spelling.Subtries(), {}
    ends = []
    for w in words:
        path = trie.add(spelling._letters(w)).tolist()
        assert len(path) == len(w) + 1
        for k, node in enumerate(path):
            assert nodes.setdefault(w[:k], node) == node
        ends.append(path[-1])
    assert len(set(nodes.values())) == len(nodes) and ends == sorted(ends)
