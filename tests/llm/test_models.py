"""The models that are trained here: their probabilities, their best paths and what they find."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from dustlens.llm import pii, toxicity

rng = random.Random(6)
WORDS = [b"the", b"of", b"and", b"clown", b"clowns", b"clownish", b"tree", b"trees", b"treetop", b"red", b"blue", b"idiotic"]
TEXTS = [[rng.choice(WORDS + [b"rare%d" % rng.randint(0, 30)]) for _ in range(rng.randint(0, 60))] for _ in range(24)]
LABELS = [i % 2 for i in range(24)]
VOCABULARY = toxicity.Vocabulary(WORDS, [[b"blue", b"clow", b"rare", b"tree"], [b"clowni", b"rare1", b"treeto"]])
SHARED = np.arange(3.0, 3 + VOCABULARY.size)


@pytest.mark.parametrize("discount, strength, power", [(0.5, 0.0, 1.0), (2.0, 0.0, 1.5), (1.0, 8.0, 1.0)])
def test_probabilities_sum_to_one(discount, strength, power):
    lm = toxicity.KneserNey(toxicity.Counts(TEXTS, LABELS, VOCABULARY, SHARED), discount, strength, power)
    for c in (0, 1):
        assert lm.single[c].sum() == pytest.approx(1)
        for v in range(lm.size + 1):
            p = lm.following(c, v)
            assert p.sum() == pytest.approx(1) and (p > 0).all()


@pytest.mark.parametrize("discount, strength, power", [(0.5, 0.0, 1.0), (1.5, 2.0, 1.5)])
def test_models_against_plain_counting(discount, strength, power):
    """Sets of contexts and recursion by the formulas of the docstring."""
    lm = toxicity.KneserNey(toxicity.Counts(TEXTS, LABELS, VOCABULARY, SHARED), discount, strength, power)
    total = (SHARED**power).sum()
    entries = [*WORDS, *((4, b) for b in VOCABULARY.groups[0]), *((6, b) for b in VOCABULARY.groups[1]), None]
    shared = dict(zip(entries, SHARED**power / total))
    gone = lambda k: min(k, discount * math.sqrt(k))

    def entry(w):
        if w in WORDS:
            return w
        return (6, w[:6]) if w[:6] in VOCABULARY.groups[1] else (4, w[:4]) if w[:4] in VOCABULARY.groups[0] else None

    def start_of(e, n):
        """The kind of an entry in the order of n bytes: its longest known beginning of at most n."""
        w = e if isinstance(e, bytes) else e[1] if e else b""
        short = e[0] if isinstance(e, tuple) else 99
        for k, own in ((6, VOCABULARY.groups[1]), (4, VOCABULARY.groups[0])):
            if k <= n and k <= short and w[:k] in own:
                return (k, w[:k])
        return None

    words, pairs, starts = ([defaultdict(set) for _ in (0, 1)] for _ in range(3))
    for text, c in zip(TEXTS, LABELS):
        padded = [b"", b"", *text]
        for a, b, w in zip(padded, padded[1:], padded[2:]):
            words[c][w].add(b)
            pairs[c][b, w].add(a)
            for n in (4, 6):
                starts[c][n, start_of(w, n)].add((b, w))

    def start(c, n, b):
        """P_c of a beginning."""
        counts = {k[1]: len(s) for k, s in starts[c].items() if k[0] == n}
        whole = sum(counts.values())
        p = lambda m, x: sum(q for e, q in shared.items() if start_of(e, m) == x)
        shorter = start_of(b, 4)
        below = start(c, 4, shorter) / p(4, shorter) if n == 6 else 1.0
        rest = sum(map(gone, counts.values())) / whole + strength
        own = counts.get(b, 0)
        return ((own - gone(own)) / whole + rest * below * p(n, b)) / (1 + strength)

    def one(c, e):
        counts = {k: len(s) for k, s in words[c].items()}
        whole = sum(counts.values())
        kept = sum(k - gone(k) for x, k in counts.items() if entry(x) == e)
        mates = sum(q for x, q in shared.items() if start_of(x, 6) == start_of(e, 6))
        return (kept / whole + (sum(map(gone, counts.values())) / whole + strength) * start(c, 6, start_of(e, 6)) * shared[e] / mates) / (1 + strength)

    def after(c, v, e):
        def level(counts, below):
            counts = {k: n for k, n in counts.items() if k[0] == v}
            whole = sum(counts.values())
            if not whole:
                return below
            kept = sum(n - gone(n) for k, n in counts.items() if entry(k[1]) == e)
            return (kept + (sum(map(gone, counts.values())) + strength * whole) * below) / whole / (1 + strength)

        both = {k: len(pairs[0][k]) + len(pairs[1][k]) for k in set(pairs[0]) | set(pairs[1])}
        return level({k: len(s) for k, s in pairs[c].items() if s}, level(both, one(c, e)))

    for c in (0, 1):
        assert lm.single[c].tolist() == pytest.approx([one(c, e) for e in entries])
        for i, v in [(0, b"the"), (3, b"clown"), (VOCABULARY.size, b"")]:
            assert lm.following(c, i).tolist() == pytest.approx([after(c, v, e) for e in entries])
    # Scoring is the difference of the two log-likelihoods, by word, but for what the words of an entry share in both.
    odds = toxicity.Odds([lm], VOCABULARY)
    text = [b"clown", b"the", b"the", b"unseen", b"clowning", b"treeline", b"tree"]
    want = sum(math.log(after(1, v, entry(w)) / after(0, v, entry(w))) if v in WORDS or v == b"" else math.log(one(1, entry(w)) / one(0, entry(w))) for v, w in zip([b"", *text], text))
    assert odds.mean(text) == pytest.approx(want / len(text))


def test_sketches_count_distinct_contexts(spark):
    texts = [" ".join(f"w{rng.randint(0, 400)} bad" if rng.random() < 0.5 else "the good" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    vocabulary = toxicity.Vocabulary([b"bad", b"good", b"never"], [[b"the"], []])
    got = dict(zip(["bad", "good", "never", "the*", "rest"], toxicity.shared_contexts(docs, vocabulary)))
    split = [t.split() for t in texts]
    contexts = {a for t in split for a, b in zip(t, t[1:]) if b == "bad"}
    assert got["bad"] == pytest.approx(len(contexts), rel=0.25) and got["good"] == pytest.approx(1, abs=0.1) and got["never"] == 1
    assert got["the*"] == pytest.approx(len({a for t in split for a, b in zip(t, t[1:]) if b == "the"}), rel=0.25)
    assert got["rest"] == pytest.approx(len({(a, b) for t in split for a, b in zip(t, t[1:]) if b[0] == "w"}), rel=0.25)


def test_nothing_but_the_training_folds_is_learned_from(spark):
    import zlib

    ids, own = range(240), random.Random(9)
    word = lambda bad: "clown" if bad and own.random() < 0.2 else f"w{int(own.random() ** 2 * 60)}"
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(80))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in ids]
    held = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]  # turned round in the held-out fold
    scores = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")).scores([b"w1 clown w2 w3 clown w4", b"w1 w2 w3 w4 w5 w6"]).tolist() for x in (labels, held)]
    assert scores[0] == scores[1] and scores[0][0] > 0.7 > scores[0][1]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, 1)], [(1, 1)], [(1, 0), (1, 1), (2, 0)]])
def test_few_or_no_labels(spark, rows):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (None, "d")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert len(toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame(rows, "doc_id long, toxic int"))).collect()) == 0


# The field.

def full_viterbi(model, words):
    """The best path of a whole text, word by word, and its score."""
    score, inside = model.scores([words])
    score = score[inside]
    best, back = score[0] + model.begin, []
    for t in range(1, len(words)):
        step = best[:, None] + model.trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + score[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


def path_score(model, words, path):
    score, inside = model.scores([words])
    score = score[inside]
    return model.begin[path[0]] + sum(score[t, y] for t, y in enumerate(path)) + sum(model.trans[a, b] for a, b in zip(path, path[1:]))


def test_scores_are_sums_of_feature_weights():
    model = pii.trained()
    for words, _ in pii.labelled_table()[:60]:
        score, inside = model.scores([words, words[:1]])
        want = np.array([sum(model.weight[model.ids[f]] for f in row if f in model.ids) for row in pii._rows(words) + pii._rows(words[:1])])
        assert np.allclose(score[inside], want)


def test_stretches_give_the_best_path_of_whole_texts():
    model = pii.trained()
    texts = [w for w, _ in pii.labelled_table()[:150]]
    texts += [[x for w in rng.sample(texts, 30) for x in w], ["12"] * 40, ["a"], ["@"], []]
    texts.append(["".join(rng.choice("a1@.-+:=X") for _ in range(rng.randint(1, 20))) for _ in range(500)])
    for words, found in zip(texts, model.decode(texts)):
        path = [0] * len(words)
        for start, labels in found:
            path[start : start + len(labels)] = labels.tolist()
        if words:
            want, best = full_viterbi(model, words)
            assert path_score(model, words, path) == pytest.approx(best) and path == want


def test_marginals_are_the_gradient():
    """Expected counts against differences of the log partition sum."""
    r = np.random.default_rng(2)
    score, trans, begin, mask = r.normal(size=(2, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)

    def partition(score, trans):
        from itertools import product

        out = 0.0
        for s, m in zip(score, mask):
            n = int(m.sum())
            out += np.log(sum(np.exp(begin[y[0]] + sum(s[t, y[t]] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))) for y in product(range(3), repeat=n)))
        return out

    node, edge = pii.ChainField._marginals(score, mask, trans, begin)
    step = 1e-5
    for at in [(0, 0, 1), (0, 3, 2), (1, 1, 0)]:
        more = score.copy()
        more[at] += step
        assert (partition(more, trans) - partition(score, trans)) / step == pytest.approx(node[at], abs=1e-3)
    more = trans.copy()
    more[1, 2] += step
    assert (partition(score, more) - partition(score, trans)) / step == pytest.approx(edge[1, 2], abs=1e-3)


#: Labelled by hand, not learned from: a text and what the field should add to what the patterns find.
HAND = [
    ('secret "deadbeefdeadbeefcafebabecafebabe"', ["secret:deadbeefdeadbeefcafebabecafebabe"]),
    ("the token = abcdefabcdefabcdefabcdef was leaked", ["secret:abcdefabcdefabcdefabcdef"]),
    ("password: correcthorsebattery", ["secret:correcthorsebattery"]),
    ('config has api_key = "9f86d081884c7d659a2feaa0c55ad015" in it', ["secret:9f86d081884c7d659a2feaa0c55ad015"]),
    ("her ssn 536-22-1234 and her name", ["ssn:536-22-1234"]),
    ("SSN: 078-05-1120", ["ssn:078-05-1120"]),
    ("pay to IBAN DE89370400440532013000 today", ["iban:DE89370400440532013000"]),
    ("call (212) 555-0188 after six", ["phone:(212) 555-0188"]),
    ("my tel 212-555-0188 is new", ["phone:212-555-0188"]),
    ("token 5d41402abc4b2a76b9719d911017c592 expires", ["secret:5d41402abc4b2a76b9719d911017c592"]),
    ("the key to success is patience", []), ("I forgot my password yesterday", []), ("please call me at home", []), ("a token of respect", []),
    ("in 2024 we sold 1,200 units", []), ("version v2.3 came on 2023-11-05", []), ("see page 12, line 40", []), ("the meeting is at 10:30", []),
    ("it costs $45 or 99%", []), ("chapter 3: the secret garden", []), ("email the team about the host", []), ("an account of the journey", []),
    ("id cards are needed", []), ("visit https://www.example.com/1234 now", []), ("note: bring water", []), ("name = value", []),
]


def test_precision_and_recall_on_hand_labelled_rows():
    model = pii.trained()
    texts = [t for t, _ in HAND]
    found = pii.field_spans(model, texts, [pii.base_spans(t) for t in texts])
    got = [{f"{pii.KINDS[k]}:{t[s:e]}" for s, k, e in own} for t, own in zip(texts, found)]
    right = sum(len(g & set(w)) for g, (_, w) in zip(got, HAND))
    assert right / sum(len(w) for _, w in HAND) >= 0.8, [x for x in zip(got, HAND) if x[0] != set(x[1][1])]
    assert right / max(1, sum(map(len, got))) >= 0.8, [x for x in zip(got, HAND) if x[0] != set(x[1][1])]


def test_words_far_apart_and_long_ones_are_read():
    model = pii.trained()
    text = "plain words here " * 3000 + 'and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + "plain words here " * 3000
    assert [text[s:e] for s, _, e in pii.field_spans(model, [text], [[]])[0]] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    shapes = [pii.word_features("a" * 100 + x) for x in ("", "7" * 5)]  # what differs is behind a hundred letters
    assert shapes[0] != shapes[1]
