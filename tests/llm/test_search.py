"""MinHash near-dedup, lexical search and collocations against brute force, on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, minhash, phrases, prefix
from tidemark.llm.words import prefix_polynomials, run_hashes

SCHEMA = "doc_id long, text string, lang string, n long, key string, part string, band long, id long, item string, score long, fp long"
BIG = (1 << 53) + 1


def words(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def make_rows():
    rng = random.Random(11)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO\nwords", "é ☃ ñ", "w1 " * 50, "..,;", "x" * 400_000]
    for i in range(40):  # near copies around the threshold, of one template
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(w[: len(w) - rng.randrange(8)] + words(rng, rng.randrange(6))))
    texts += [" ".join(base)] * 3 + [" ".join(words(rng, 60_000, 900))]
    texts += [" ".join(words(rng, rng.randrange(1, 60), 40)) + rng.choice(["", ".", "! a b", "\n"]) for _ in range(60)]
    rows = [(i * 7 + BIG * (i % 2), t, ["en", "de", None][i % 3], 1, "k", "p", 2, 3, "i", 4, 5) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[55], (None, " ".join(base), "en", 1, "k", "p", 2, 3, "i", 4, 5), (None, None, "en", 1, "k", "p", 2, 3, "i", 4, 5)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_components(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(s), (min(least[find(i)]) if least[find(i)] else None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_minhash_components_match_brute_force(docs):
    want = brute_components(ROWS)
    large = [c for _, n, c in want if n > 50]
    assert len(set(large)) < len(large) - 10  # many of the template's copies are linked, not all
    assert got(minhash.near_duplicates(docs)) == sorted(want, key=str)


def test_minhash_loses_no_link_between_copies_of_templates(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(6):
        base = words(rng, 150, 5000)
        for _ in range(50):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(w), *(None,) * 9))
    found = got(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert found == sorted(brute_components(rows), key=str)


def test_minhash_keeps_one_of_a_component(docs, none):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(i, n) for i, n, c in brute_components(ROWS) if i == c]
    assert sorted(r[0] for r in kept.select("doc_id").where("doc_id is not null").collect()) == sorted(i for i, _ in want if i is not None)
    assert got(minhash.keep_one(none)) == [] and got(minhash.near_duplicates(none)) == []


def test_densified_ranges_agree_as_often_as_sets(spark):
    """Empty ranges borrow, for two sets alike where their elements are: the share of equal ranges estimates the Jaccard."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 20, 3000):
        shares = []
        for _ in range(150):
            both = rng.integers(0, 1 << 64, n, np.uint64)
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 64, max(1, n // 4), np.uint64))) for _ in range(2))
            s = minhash.signatures([a, b])
            shares.append((s[0] == s[1]).mean())
        assert np.mean(shares) == pytest.approx(n / (n + 2 * max(1, n // 4)), abs=0.06)


def test_star_links_of_a_bucket_are_fewer_than_its_rows(spark):
    rows = [(b, bytes([k % 256, k // 256]) * 8, 100, [0] * 8) for b in (1, 2) for k in range(500)]
    marks = spark.createDataFrame(rows, "band long, key binary, n int, sketch array<long>")
    assert minhash.star_links(marks, 0.85).count() == 499


def brute_search(rows, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) if t is not None else []
    held = [(r[0], Counter(w), len(w)) for r in rows if (w := cut(r[1]))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if t in c)
            if s:
                scored.append((-s, i is None, i or 0, s))
        out += [(item, rank, None if null else i, s) for rank, (_, null, i, s) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(1, "w1 w2 w3 W4 w4 w4"), (2, ""), (3, None), (4, "e1 unknown, w250!"), (5, ROWS[12][1]), (6, "é x ñ"), (7, "..."), (8, " ".join(f"w{i}" for i in range(300))), (None, "w7 w8")]


def test_search_matches_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical.search(docs, items)) == sorted(brute_search(ROWS, ITEMS), key=str)
    assert got(lexical.search(docs, items, k=3)) == sorted(brute_search(ROWS, ITEMS, 3), key=str)


def test_search_in_several_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 10)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical.search(docs, items)) == sorted(brute_search(ROWS, ITEMS), key=str)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical.search(none, items)) == []
    assert got(lexical.search(docs, items.limit(0))) == []
    assert got(lexical.search(docs, spark.createDataFrame([(1, None), (2, "--")], "item_id long, text string"))) == []


def test_bounds_are_never_below_scores(spark, docs):
    held = [(r[0], lexical.counted(w), len(w)) for r in ROWS if (w := lexical.terms((r[1] or "").encode()))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = [lexical.counted(lexical.terms((t or "").encode())) for _, t in ITEMS]
    q = lexical._Queries([i for i, _ in ITEMS], queries, {t: lexical.weight(n_docs, df[t]) for c in queries for t in c}, n_docs, n_terms)
    seen, loose = 0, 0
    scores = defaultdict(list)
    for i, c, n in held:
        for j in range(len(ITEMS)):
            scores[i, n, j].append(q.score({q.index[w]: k for w, k in c.items() if w in q.index}, n, j))
    for b in lexical.build_index(docs).collect():
        for j, bound in enumerate(q.bounds(b["n_bits"], np.array(b["n"]), np.array(b["top"]), b["rows"])):
            for i, n, x in zip(b["ids"], b["n"], bound.tolist(), strict=True):
                assert x >= min(scores[i, n, j])
                seen, loose = seen + 1, loose + (x > 0) - (max(scores[i, n, j]) > 0)
    assert seen == len(held) * len(ITEMS) and loose < 0.2 * seen  # signatures do leave documents out


def brute_collocations(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cand = {p for p, a in c.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p in cand:
            a = c[p]
            if any(c[q] >= a for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_match_brute_force(docs, top):
    want = brute_collocations(ROWS, 8, top)
    assert len(want) > 10 and any(len(r[2].split()) == 5 for r in want)
    assert got(phrases.collocations(docs, least=8, top=top)) == sorted(want, key=str)


def test_collocations_in_small_groups_and_sums(spark, docs, monkeypatch):
    """Many groups of texts and partial sums a task give the same rows (tasks of this test run in new workers)."""
    some = docs.where("length(text) < 1000").repartition(2)
    want = got(phrases.collocations(some, least=6))
    for name in ("_counts", "_pointed"):

        def small(*sent, make=getattr(phrases, name)):
            inner = make(*sent)

            def task(batches):
                from tidemark.llm import phrases as p

                p.GROUP_WORDS, p.HELD, p.HELD_WORDS = 50, 200, 30
                yield from inner(batches)
                p.GROUP_WORDS, p.HELD, p.HELD_WORDS = 1 << 18, 1 << 20, 1 << 18

            return task

        monkeypatch.setattr(phrases, name, small)
    assert want and got(phrases.collocations(some, least=6)) == want


def test_collocations_of_nothing_and_of_hot_rows(spark, none):
    assert got(phrases.collocations(none)) == []
    rows = [(None, "Big bad wolf. big bad\twolf", None, *(None,) * 8)] * 60
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == brute_collocations(rows, 100, 2000)


def test_products_beyond_64_bits_stay_exact(spark):
    a, n, left, right = 10**14 + 7, 10**15 + 3, 10**14 + 9, 10**14 + 11
    whole = lambda c: F.lit(c).cast("decimal(19,0)")
    score = F.call_function("div", whole(a) * whole(n) * F.lit(1000).cast("decimal(4,0)"), whole(left) * whole(right))
    assert spark.range(1).select(score).first()[0] == 1000 * a * n // (left * right)


def test_fingerprints_are_the_same_wherever_a_phrase_stands():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 5000, np.uint64)
    h[4000:4005] = h[17:22]
    p = prefix_polynomials(h)
    for n in range(1, 6):
        f = run_hashes(p, np.arange(len(h) - n + 1), n)
        assert f[4000] == f[17] and len(np.unique(f)) == len(f) - (6 - n)


def test_long_sketches_never_part_alike_sets():
    rng, parted = np.random.default_rng(2), 0
    for i in range(300):
        n = int(rng.integers(1, 4000))
        both = rng.integers(0, 1 << 64, n, np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 1 << 64, int(rng.integers(0, 1 + n // (1 + i % 12))), np.uint64))) for _ in range(2))
        k = len(np.intersect1d(a, b))
        near = prefix.sketches_near(prefix.long_sketch(a), prefix.long_sketch(b), len(a), len(b), 0.85)
        assert near or 100 * k < 85 * (len(a) + len(b) - k)
        parted += not near
    assert parted > 100
