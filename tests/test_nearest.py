"""Only pairs that may be among the best are measured, and none of those is missed."""

import random
from difflib import SequenceMatcher

import pandas as pd

from reelgrid.functions import similarity

PENALTY = 0.2


def frames(asked, known):
    a = pd.DataFrame([("k", 0, t, t.lower(), t, t.lower(), None, None) for t in asked], columns=["key", "wish", "text_q", "low_q", "turned_q", "low_turned_q", "same_q", "same_turned_q"])
    return a, pd.DataFrame([("k", 0, t, t.lower(), t, t.lower(), n, less) for t, n, less in known], columns=["key", "wish", "text_t", "low_t", "turned_t", "low_turned_t", "n", "n_less"])


def test_best_of_many_texts(monkeypatch):
    random.seed(3)
    word = lambda: "".join(random.choice("bdfgkmn") + random.choice("aeiou") for _ in range(random.randint(2, 4)))
    texts = sorted({f"Return to {word()}" for _ in range(800)})
    known = [(t, k % 3 > 0, k % 3 == 0) for k, t in enumerate(texts)]
    asked, calls, real = texts[::50], [], similarity.gestalt
    monkeypatch.setattr(similarity, "gestalt", lambda *x: calls.append(1) or real(*x))
    got = similarity.nearest_pairs(*frames(asked, known), 0.6, 5, False, PENALTY)
    held = {(r.text_q, r.text_t): r.base for r in got.itertuples()}
    for q in asked:
        # the library's own matcher; each text is one record, a third of them episodes
        score = lambda t: SequenceMatcher(None, q.lower(), t.lower()).ratio() + 0.1
        ranked = sorted(((score(t) - PENALTY * less, t) for t, _, less in known), reverse=True)
        for s, t in ranked:
            if s >= ranked[4][0] and min(len(q), len(t)) / max(len(q), len(t)) >= similarity.LEAST_LENGTHS:
                assert held[q, t] == score(t)
    assert 0 < len(calls) < 0.5 * len(asked) * len(texts)


def test_ratio_is_the_librarys():
    random.seed(1)
    matcher = SequenceMatcher(None)
    for _ in range(3000):
        a, b = ("".join(random.choice(random.choice(["ab", "abcd ", "é東a"])) for _ in range(random.randint(0, 20))) for _ in range(2))
        assert similarity.gestalt(matcher, a, b) == SequenceMatcher(None, a, b).ratio()
    long = "ab" * 150
    assert similarity.gestalt(matcher, "abab", long) == SequenceMatcher(None, "abab", long).ratio()
