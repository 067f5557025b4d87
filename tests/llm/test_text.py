import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contactloom.llm.contamination import PositionalIndex, phrase_matches, proximity_matches
from contactloom.llm.fmindex import BitRank, FMIndex, suffix_order
from contactloom.llm.mixing import Mixture, bpe_tokens, fit_budget
from contactloom.llm.spans import SharedSpans, gram_hashes, winnow

# --- contamination -------------------------------------------------------------------------------

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def found(frame, docs, items, **options):
    index = PositionalIndex(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, phrase_matches(index, 12).select("doc_id", "item_id").collect()))


@pytest.mark.parametrize("options", [{}, {"vocabulary_limit": 0}])
def test_phrases(frame, options):
    twelve = ITEM.rsplit(" ", 1)[0]
    docs = [
        (1, "x " + twelve + " y"), (2, ITEM.upper().replace(" ", "--\n")), (3, twelve.replace("six", "sax")), (4, ITEM.rsplit(" ", 2)[0]), (5, None), (6, ""),
        (7, twelve.replace("six", "sıx")), (8, "two " * 5000 + twelve + " two" * 5000), (9, "Kone " + ITEM), (1, "x " + twelve), (10, "a " * 30),
    ]
    items = [(1, ITEM), (2, "short item"), (3, None), (4, "a " * 12), (5, "not in any of the documents here at all so never found anywhere")]
    assert found(frame, docs, items, **options) == [(1, 1), (2, 1), (8, 1), (9, 1), (10, 4)]
    assert found(frame, [], items) == [] and found(frame, docs, []) == []


def test_phrases_against_brute_force(frame):
    rng = random.Random(2)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(14))) for i in range(20)]
    docs = [(d, " ".join(word() for _ in range(40)) + " " + " ".join(rng.choice(items)[1].split()[: rng.randrange(9, 15)])) for d in range(60)]
    grams = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    want = sorted((d, i) for d, t in docs for i, x in items if grams(t) & grams(x))
    assert found(frame, docs, items) == want


def near(frame, docs, items, share=0.8, **options):
    index = PositionalIndex(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), ahead=3, **options)
    return {(r.doc_id, r.item_id): (r.edits, r.words) for r in proximity_matches(index, share).collect()}


@pytest.mark.parametrize("options", [{}, {"vocabulary_limit": 0}])
def test_proximity(frame, options):
    changed = ITEM.replace("five", "fife").replace("nine", "nein")
    docs = [
        (1, ITEM), (2, "x " + changed), (3, "one two three"), (4, ITEM.replace(" ", " and ")), (5, ITEM.replace("two", "two and a").upper()),
        (6, "y " * 3000 + ITEM.replace("six ", "").replace("nine ", "") + " y" * 50), (7, None), (8, ""), (9, ITEM.replace("two three four", "2 3 4")), (1, ITEM),
    ]
    items = [(7, ITEM), (8, None), (9, ""), (10, "fife")]
    want = {(1, 7): (0, 13), (2, 7): (2, 13), (5, 7): (2, 13), (6, 7): (2, 13), (2, 10): (0, 1)}
    assert near(frame, docs, items, **options) == want
    assert near(frame, [], items) == {} == near(frame, docs, [])


def fewest_edits(words, item):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_proximity_against_brute_force(frame):
    """Planted passages with inserted, removed and changed words are all found."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 7, 12, 25])))) for i in range(12)]
    docs, planted = [], set()
    for d in range(80):
        i, text = rng.choice(items)
        passage, budget = text.split(), len(text.split()) // 5
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.6 else []
        docs.append((d, " ".join([word() for _ in range(rng.randrange(30))] + passage + [word() for _ in range(rng.randrange(30))])))
    want = {}
    for d, text in docs:
        for i, x in items:
            n = len(x.split())
            if (edits := fewest_edits(text.split(), x.split())) <= n // 5:
                want[d, i] = (edits, n)
                planted.add(edits)
    assert near(frame, docs, items) == want and planted >= {0, 1, 2}


# --- mixing --------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400), st.sampled_from([20, 1 << 20]))
def test_budget_fit(sizes, budget, exact):
    take = fit_budget(sizes, budget, exact)
    have = dict(sizes)
    assert all(0 <= n <= have[s] for s, n in take.items())
    total = sum(s * n for s, n in take.items())
    reach = {0}
    for s, n in sizes:
        reach = {r + s * k for r in reach for k in range(n + 1)}
    best = max(r for r in reach if r <= budget)
    assert total <= budget and (total == best or exact < budget)


def test_mixture(frame):
    rng = random.Random(1)
    docs = [(i, "a" if i % 3 else "b", "w " * rng.randrange(1, 30)) for i in range(300)] + [(900, None, "x y"), (901, "other", "x " * 99), (902, "a", None), (903, "a", "")]
    docs += [(1000 + i, "c", " one\ttwo\r\nthree  ") for i in range(50)]
    targets = [("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 3), ("gone", 0.01, 9), ("none", None, None)]
    mix = Mixture(frame(docs, "doc_id long, source string, text string"), frame(targets, "source string, target_share double, max_repeats int"))
    own = Counter()
    for _, s, t in docs:
        own[s] += len((t or "").split())
    total = own["a"] + own["b"] + own["c"]
    assert mix.total == total
    short = {s for s, share, reps in targets if own[s] * (reps or 0) < (share or 0) * total}
    assert {r.source for r in mix.short_sources().collect()} == short
    taken = Counter()
    copies = {}
    for r in mix.select().collect():
        taken[r.source] += r.tokens * r.copies
        copies[r.doc_id] = (r.source, r.copies)
    for s, share, reps in targets[:3]:
        want = int(share * total)
        assert taken[s] == min(want, own[s] * reps) or (0 <= want - taken[s] <= 1)
        assert all(c <= reps for x, c in copies.values() if x == s)
    again = Mixture(frame(docs[::-1], "doc_id long, source string, text string"), frame(targets, "source string, target_share double, max_repeats int"))
    assert {r.doc_id: r.copies for r in again.select().collect()} == {d: c for d, (_, c) in copies.items()}
    report = {r.source: r for r in mix.report().collect()}
    assert report["gone"].taken_tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_mixture_of_a_length_that_most_documents_have(frame, monkeypatch):
    from contactloom.llm import mixing

    monkeypatch.setattr(mixing, "RANKED_ROWS", 50)
    docs = frame([(i, "a", "x y") for i in range(3000)] + [(5000 + i, "b", "z") for i in range(2000)], "doc_id long, source string, text string")
    mix = Mixture(docs, frame([("a", 0.25, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int"))
    out = mix.select().groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out} == {"a": 1000, "b": 1600}


def test_empty_mixture(frame):
    mix = Mixture(frame([], "doc_id long, source string, text string"), frame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    assert mix.select().count() == 0 and mix.short_sources().count() == 0 and mix.report().first().taken_tokens == 0


def test_tokens_of_a_public_tokenizer(frame):
    P = pytest.importorskip("public_tokenizers")
    out = frame([("a b", ), (None, )], "text string").select(bpe_tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).alias("n")).collect()
    assert [r.n for r in out] == [2, 0]


# --- spans ---------------------------------------------------------------------------------------


def test_bit_ranks():
    bits = np.random.default_rng(1).integers(0, 2, 1000).astype(np.uint8)
    at = np.arange(1001)
    assert (BitRank(bits).ones(at) == np.concatenate(([0], np.cumsum(bits)))).all()


def common_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_backward_search_and_matching_statistics(seed):
    rng = random.Random(seed)
    depth, letters = rng.choice([2, 3, 8, 12]), rng.choice(["a", "ab", "abcdefghij"])
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    copied = make(50)
    texts = ["", *[make(rng.randrange(30)) + copied[rng.randrange(40) :][: rng.randrange(30)] + make(rng.randrange(5)) for _ in range(8)]]
    owners = np.array([rng.randrange(4) for _ in texts])
    index = FMIndex([np.array([ord(c) - 96 for c in t], np.int64) for t in texts], owners, depth)
    joined = "".join(t + "\0" for t in texts)
    order, common = suffix_order(index.text, depth)
    heads = [joined[i : joined.index("\0", i)][:depth] for i in order]
    assert heads == sorted(heads)
    for x, y, n in zip(heads, heads[1:], common[1:].tolist()):
        assert n == common_prefix(x, y) or (n > len(x) and x == y)
    for _ in range(60):
        text = "".join(rng.choice(letters + "z") for _ in range(rng.randint(1, min(6, depth))))
        lo, hi = np.array([0]), np.array([len(joined)])
        for c in reversed(text):
            lo, hi = index.back(np.array([ord(c) - 96]), lo, hi) if ord(c) - 96 < index.symbols else (hi, hi)
        assert sorted(index.order[lo[0] : hi[0]].tolist()) == [i for i in range(len(joined)) if joined.startswith(text, i)]
    have: dict = {}
    for t, owner in zip(texts, owners.tolist()):
        for i in range(len(t) - depth + 1):
            have.setdefault(t[i : i + depth], set()).add(owner)
    want = [i for i in range(len(joined)) if len(have.get(joined[i : i + depth], ())) > 1]
    for piece in (1, 7, None):
        places, ranges = index.matches(piece)
        assert sorted(places.tolist()) == want
        assert all(joined[index.order[r] :][:depth] == joined[p : p + depth] for p, r in zip(places.tolist(), ranges.tolist()))


def test_winnowing_keeps_a_least_hash_of_every_window():
    rng = np.random.default_rng(5)
    for text in (rng.integers(97, 100, 3000), np.full(900, 45), np.tile(np.arange(7), 150), np.concatenate((rng.integers(0, 9, 500), np.zeros(700, int), rng.integers(0, 9, 500)))):
        h = gram_hashes(text.astype(np.uint32), 20)
        assert (h[:50] == gram_hashes(text[: 50 + 19].astype(np.uint32), 20)).all()
        places = winnow(h, 21)
        for x in range(0, len(h) - 20):
            inside = places[(places >= x) & (places < x + 21)]
            assert len(inside) and h[inside].min() == h[x : x + 21].min()
        assert len(places) <= len(h) / 2


def brute_shared(docs, length):
    where: dict = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    shared = {k for k, v in where.items() if len(v) > 1}
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    cover = {d: set() for d, _ in docs}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            if t[i : i + length] in shared:
                cover[d] |= set(range(i, i + length))
    return pairs, {d: len(c) for d, c in cover.items()}


def corpus(rng, length):
    text = lambda n, letters="abcdefgh é\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    common = [text(length), text(2 * length), text(length - 1), text(length + 7), "-" * (length + 5), "xyz" * length, ("=" * length + "\n") * 3]
    docs = []
    for d in range(40):
        parts = [text(rng.randrange(5, 90))]
        for _ in range(rng.randrange(0, 4)):
            piece = rng.choice(common)
            cut = rng.randrange(0, 4)
            parts += [piece[cut:] if rng.random() < 0.5 else piece[: len(piece) - cut], text(rng.randrange(0, 40))]
        docs.append((d, "".join(parts)))
    return docs + [(50, None), (51, ""), (52, "-" * (6 * length)), (53, "a" + "-" * length), (54, "-" * (length - 1) + "b")]


@pytest.mark.parametrize("seed,shard", [(1, 4000), (2, 60), (3, 8), (4, 1)])
def test_shared_spans_against_brute_force(frame, seed, shard):
    """Shards of few places spread large leaders by fingerprint and leave frequent ones to hashed runs."""
    length = 40
    docs = corpus(random.Random(seed), length)
    s = SharedSpans(frame([(*d, 1) for d in docs], "doc_id long, text string, start int"), length, shard=shard)
    pairs, cover = brute_shared(docs, length)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == cover


@pytest.mark.parametrize("shard", [4000, 20])
def test_rows_of_a_copied_notice_grow_with_its_copies(frame, shard):
    rng = random.Random(9)
    notice = "".join(rng.choice("abcdefghij") for _ in range(60))
    rows = {}
    for n in (20, 200):
        docs = [(d, "".join(rng.choice("klmnopq") for _ in range(49)) + chr(0x4E00 + d) + notice + "rs" * (d % 5)) for d in range(n)]
        s = SharedSpans(frame(docs, "doc_id long, text string"), 40, shard=shard)
        got = s.spans().collect()
        assert sorted((r.doc_id, r.start, r.end) for r in got) == [(d, 50, len(t)) for d, t in docs]
        rows[n] = len(got)
    assert rows[200] == 10 * rows[20]


def test_shared_spans_of_nothing(frame):
    s = SharedSpans(frame([], "doc_id long, text string"), 40)
    assert s.pairs().count() == 0 and s.spans().count() == 0 and s.coverage().count() == 0
    twice = SharedSpans(frame([(1, "ab" * 50), (1, "ab" * 50)], "doc_id long, text string"), 40)
    assert twice.pairs().count() == 0
