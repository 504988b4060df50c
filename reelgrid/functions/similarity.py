"""Gestalt similarity of two texts.

Spark has no such function, so this is an Arrow UDF over the standard library's matcher. The ratio is not symmetric: the
first text is the query, the second the candidate. Distinct pairs are scored once per batch, and callers filter by length
natively before (``close_in_length``), as the matcher is the expensive step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least score of a hit, and the least ratio of lengths that is compared at all.
LEAST_SCORE, LEAST_LENGTHS = 0.6, 0.7


def close_in_length(a: Column, b: Column) -> Column:
    """Whether the shorter text has at least LEAST_LENGTHS of the longer one's characters; false for null or two empty texts."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.coalesce(a.isNotNull() & b.isNotNull() & (long > 0) & (short.cast("double") / F.nullif(long, F.lit(0)) >= LEAST_LENGTHS), F.lit(False))


def _score(matcher, a: str | None, b: str | None) -> float | None:  # noqa: ANN001
    if a is None or b is None:
        return None
    matcher.set_seq1(a)
    if matcher.b is not b:
        matcher.set_seq2(b)
    return matcher.ratio()


def _ratio(query: pd.Series, candidate: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    matcher, scores, out = SequenceMatcher(None), {}, []
    for pair in zip(query, candidate, strict=True):
        if pair not in scores:
            scores[pair] = _score(matcher, *pair)
        out.append(scores[pair])
    return pd.Series(out, dtype="float64")


# not deterministic for the planner: a filter on the score would otherwise compute it twice
_udf = F.pandas_udf(_ratio, T.DoubleType()).asNondeterministic()


def ratio(query: Column, candidate: Column) -> Column:
    """Gestalt ratio of two texts as they are; null if one is null."""
    return _udf(query, candidate)


#: Bins of characters whose counts bound a ratio from above.
_BINS = 64


def _bound(a: pd.Series, b: pd.Series) -> np.ndarray:
    """An upper bound of each pair's ratio: twice the characters that both texts have, in any order, by their lengths."""

    def counted(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, one = pd.factorize(texts)
        lengths = np.fromiter(map(len, one), np.int64, len(one))
        points = np.frombuffer("".join(one).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros((len(one) + 1, _BINS), np.int32)
        np.add.at(table, (np.repeat(np.arange(len(one)), lengths), points % _BINS), 1)
        return codes, table, np.append(lengths, 0)

    ia, ca, la = counted(a)
    ib, cb, lb = counted(b)
    both = np.minimum(ca[ia], cb[ib]).sum(1)
    return 2.0 * both / np.maximum(la[ia] + lb[ib], 1)


def _ratios(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, least_direct: float, least_other: float) -> pd.DataFrame:
    from difflib import SequenceMatcher

    matcher = SequenceMatcher(None)
    # those that cannot reach the least value are not measured; the margin is for rounding
    open_direct, open_other = _bound(a, b) >= least_direct - 1e-9, _bound(c, d) >= least_other - 1e-9
    direct, other = np.zeros(len(a)), np.zeros(len(a))
    for k, (q, t, bare_q, bare_t) in enumerate(zip(a, b, c, d, strict=True)):
        if open_direct[k]:
            direct[k] = _score(matcher, q, t) or 0.0
        if open_other[k]:
            other[k] = direct[k] if open_direct[k] and (bare_q, bare_t) == (q, t) else _score(matcher, bare_q, bare_t) or 0.0
    return pd.DataFrame({"direct": direct, "other": other})


_TWO = T.StructType([T.StructField("direct", T.DoubleType()), T.StructField("other", T.DoubleType())])


def two_ratios(query: Column, candidate: Column, other_query: Column, other_candidate: Column, least_direct: float = 0.0, least_other: float = 0.0) -> Column:
    """struct(direct, other): the ratios of two pairs of texts, which are often the same pair; for pairs that are distinct already.

    A ratio that cannot reach its least value comes out as zero without being measured, one of a null text as well.
    """

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return _ratios(a, b, c, d, least_direct, least_other)

    return F.pandas_udf(run, _TWO).asNondeterministic()(query, candidate, other_query, other_candidate)


def gestalt(matcher, a: str, b: str) -> float:  # noqa: ANN001
    """The matcher's ratio of two texts; below the length from which it leaves characters out, by searches for parts of one in the other."""
    if len(b) >= 200:
        return _score(matcher, a, b)
    if a == b:
        return 1.0
    same, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        within, best, at = b[blo:bhi], 0, alo
        i = alo
        # the longest part, of equal ones the first in a, then in b
        while i + best < ahi:
            if a[i : i + best + 1] in within:
                best, at = best + 1, i
            else:
                i += 1
        if best:
            same += best
            found = blo + within.find(a[at : at + best])
            if at > alo and found > blo:
                todo.append((alo, at, blo, found))
            if at + best < ahi and found + best < bhi:
                todo.append((at + best, ahi, found + best, bhi))
    return 2.0 * same / (len(a) + len(b)) if a or b else 1.0


def _bags(texts: list[str]) -> np.ndarray:
    """Counts of each text's characters by bin, one row for each bin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.bincount(points % _BINS * len(texts) + np.repeat(np.arange(len(texts)), lengths), minlength=_BINS * len(texts))
    return flat.reshape(_BINS, len(texts)).astype(np.uint8 if lengths.max(initial=0) < 256 else np.int32)


def _most(text: str, bags: np.ndarray, lengths: np.ndarray, span: slice) -> np.ndarray:
    """Upper bounds of the ratios of a text and of those of a span."""
    both = np.zeros(span.stop - span.start, np.int32)
    for k, n in enumerate(np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % _BINS, minlength=_BINS)):
        if n:
            both += np.minimum(bags[k, span], min(n, np.iinfo(bags.dtype).max))
    return 2.0 * both / np.maximum(len(text) + lengths[span], 1)


def nearest_pairs(asked: pd.DataFrame, known: pd.DataFrame, least: float, results: int, cross: bool, penalty: float) -> pd.DataFrame:
    """(text_q, wish, text_t, base): for each asked text the known ones of its key and wish that may be among the best ``results`` records.

    Both frames have key, wish, text, turned (another form), low and low_turned (what is measured) with the ends _q and _t; asked has same_q
    and same_turned_q too (texts that score 2), known has n and n_less: records, each counted at one text, without and with the penalty.
    Known texts are taken by falling bound until it is below the score that enough records have; equal scores are all kept.
    """
    import heapq
    from difflib import SequenceMatcher

    # keys with few texts come together in one call
    both = pd.concat([known[["key", "wish"]], asked[["key", "wish"]]], ignore_index=True)
    slots = pd.factorize(both["key"] + "|" + both["wish"].astype(str))[0]
    known = known.assign(slot=slots[: len(known)]).sort_values("slot", kind="stable", ignore_index=True)
    asked = asked.assign(slot=slots[len(known) :])
    held_slots, out, matcher = known["slot"].to_numpy(), [], SequenceMatcher(None)
    text_t, low_t, low_o = (known[c].tolist() for c in ("text_t", "low_t", "low_turned_t"))
    shown = lambda c: np.fromiter(map(len, known[c]), np.int64, len(known))
    len_t, len_o, low_len_t, low_len_o = shown("text_t"), shown("turned_t"), shown("low_t"), shown("low_turned_t")
    bags_t, n, n_less = _bags(low_t), known["n"].tolist(), known["n_less"].tolist()
    bags_o = bags_t if low_t == low_o else _bags(low_o)
    first: dict[str, list[int]] = {}
    for k, t in enumerate(low_t):
        first.setdefault(t, []).append(k)

    def close(length: int, lengths: np.ndarray) -> np.ndarray:
        return np.minimum(length, lengths) / np.maximum(np.maximum(length, lengths), 1) >= LEAST_LENGTHS

    for q in asked.itertuples(index=False):
        span = slice(int(np.searchsorted(held_slots, q.slot, "left")), int(np.searchsorted(held_slots, q.slot, "right")))
        if span.start == span.stop:
            continue
        near = close(len(q.text_q), len_t[span])
        other = close(len(q.text_q) if cross else len(q.turned_q), len_o[span])
        bound = np.maximum(np.where(near, _most(q.low_q, bags_t, low_len_t, span), 0.0) + 0.1, np.where(other, _most(q.low_turned_q, bags_o, low_len_o, span), 0.0))
        same = {k for t in (q.same_q, q.same_turned_q) if t is not None for k in first.get(t, ()) if span.start <= k < span.stop}
        for k in same:
            bound[k - span.start] = 2.0
        mine = np.flatnonzero((near | other | (bound == 2.0)) & (bound >= least - 1e-9))
        limit, held, total, scores = least, [], 0, []
        for j in mine[np.argsort(-bound[mine], kind="stable")].tolist():
            if bound[j] < limit - 1e-9:
                break
            k = span.start + j
            direct = gestalt(matcher, q.low_q, low_t[k]) if near[j] else 0.0
            turned = 0.0
            if other[j]:
                turned = direct if near[j] and (q.low_turned_q, low_o[k]) == (q.low_q, low_t[k]) else gestalt(matcher, q.low_turned_q, low_o[k])
            base = max(direct + 0.1, turned)
            if k in same:
                base = max(base, 2.0)
            if base < least:
                continue
            scores.append((k, base))
            for score, count in ((base, n[k]), (base - penalty, n_less[k])):
                if count and score >= least:
                    heapq.heappush(held, (score, count))
                    total += count
            while held and total - held[0][1] >= results:
                total -= heapq.heappop(held)[1]
            if total >= results:
                limit = max(least, held[0][0])
        out += [(q.text_q, q.wish, text_t[k], base) for k, base in scores if base >= limit - 1e-9]
    return pd.DataFrame(out, columns=["text_q", "wish", "text_t", "base"]).astype({"wish": "int64", "base": "float64"})
