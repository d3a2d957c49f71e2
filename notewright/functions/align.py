"""Arrow UDFs for the two scores that need a sequence alignment: ROUGE-L and METEOR.

Everything else in the scoring code is relational. Each helper looks at one pair
of texts; Spark spreads the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALNUM = re.compile(r"[a-z0-9]+")
_WORD_OR_MARK = re.compile(r"\w+|[^\w\s]")


def rouge_tokens(text: str) -> list[str]:
    return _ALNUM.findall((text or "").lower())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word per 64 tokens of ``a``."""
    where = places_of(a)
    full = (1 << len(a)) - 1
    row = full
    for tok in b:
        hit = row & where.get(tok, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _f1(hits: int, n_pred: int, n_ref: int) -> float:
    if not hits:
        return 0.0
    p, r = hits / n_pred, hits / n_ref
    return 2 * p * r / (p + r)


def rouge_l_pair(pred: str, ref: str) -> float:
    p, r = rouge_tokens(pred), rouge_tokens(ref)
    return _f1(lcs_length(p, r), len(p), len(r))


def places_of(tokens: list[str]) -> dict[str, int]:
    """Each token's places as bits."""
    where: dict[str, int] = {}
    for i, tok in enumerate(tokens):
        where[tok] = where.get(tok, 0) | (1 << i)
    return where


def _lcs_positions(ref: list[str], cand: list[str], where: dict[str, int]) -> list[int]:
    """Positions in ``ref`` of one longest common subsequence, preferring to step up in ``ref``.

    The table is kept as one integer per row, whose bits say where the length grows; a length is a count of bits.
    """
    full = (1 << len(cand)) - 1
    row, grows = full, [0]
    for tok in ref:
        hit = row & where.get(tok, 0)
        row = ((row + hit) | (row - hit)) & full
        grows.append(full ^ row)
    i, j, path = len(ref), len(cand), []
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            i, j = i - 1, j - 1
            path.append(i)
            continue
        # Without a match here, the left neighbour is above the upper one just where the row is above the row before.
        left = (1 << j) - 1
        if (grows[i] & left).bit_count() > (grows[i - 1] & left).bit_count():
            j -= 1
        else:
            i -= 1
    return path


def rouge_lsum_pair(pred: str, ref: str) -> float:
    """Summary-level ROUGE-L: lines are the units, hits are the union over predicted lines."""
    pred_lines = [rouge_tokens(s) for s in (pred or "").split("\n") if s]
    ref_lines = [rouge_tokens(s) for s in (ref or "").split("\n") if s]
    left_pred = Counter(t for s in pred_lines for t in s)
    left_ref = Counter(t for s in ref_lines for t in s)
    n_pred, n_ref = left_pred.total(), left_ref.total()
    if not n_pred or not n_ref:
        return 0.0
    placed = [(s, places_of(s)) for s in pred_lines]
    hits = 0
    for line in ref_lines:
        covered: set[int] = set()
        for cand, where in placed:
            # Reference words that the line lacks are stepped over anyway.
            spots = [i for i, tok in enumerate(line) if tok in where]
            if spots:
                covered.update(spots[k] for k in _lcs_positions([line[i] for i in spots], cand, where))
        for at in sorted(covered):
            tok = line[at]
            if left_pred[tok] > 0 and left_ref[tok] > 0:
                hits += 1
                left_pred[tok] -= 1
                left_ref[tok] -= 1
    return _f1(hits, n_pred, n_ref)


# ------------------------------------------------------------------- METEOR

_VOWELS = "aeiou"


def _is_cons(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _is_cons(w, i - 1)


def _measure(w: str) -> int:
    kinds = [_is_cons(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _is_cons(w, i) for i in range(len(w)))


def _double_cons(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _ends_cvc(w: str) -> bool:
    return (
        len(w) > 2
        and _is_cons(w, len(w) - 3)
        and not _is_cons(w, len(w) - 2)
        and _is_cons(w, len(w) - 1)
        and w[-1] not in "wxy"
    )


# Suffix tables of Porter's 1980 paper, steps 2 to 4 (fixed values).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest_suffix(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter stem of a lower-case word; words seen lately are remembered."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double_cons(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        suffix = _longest_suffix(w, table)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    suffix = _longest_suffix(w, _STEP4)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _match_stage(pred: dict[int, str], ref: dict[int, str]) -> list[tuple[int, int]]:
    """Pair equal forms from the end of both texts; matched positions are taken out."""
    spots: dict[str, list[int]] = {}
    for at in sorted(ref):
        spots.setdefault(ref[at], []).append(at)
    out = []
    for at in sorted(pred, reverse=True):
        if spots.get(pred[at]):
            out.append((at, spots[pred[at]].pop()))
    for p, r in out:
        del pred[p], ref[r]
    return out


def meteor_pair(
    pred: str, ref: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5
) -> float:
    """METEOR with the exact and stem stages; there is no synonym stage."""
    p = dict(enumerate(_WORD_OR_MARK.findall((pred or "").lower())))
    r = dict(enumerate(_WORD_OR_MARK.findall((ref or "").lower())))
    n_pred, n_ref = len(p), len(r)
    pairs = _match_stage(p, r)
    pairs += _match_stage({i: stem(w) for i, w in p.items()}, {i: stem(w) for i, w in r.items()})
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(
        1 for a, b in zip(pairs, pairs[1:]) if (b[0] - a[0], b[1] - a[1]) != (1, 1)
    )
    m = len(pairs)
    precision, recall = m / n_pred, m / n_ref
    fmean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return (1 - gamma * (chunks / m) ** beta) * fmean


def _scorer(score):
    # A type object, not its name: this runs at import, maybe before there is a session.
    @F.pandas_udf(T.DoubleType())
    def run(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([score(p, r) for p, r in zip(pred, ref)], dtype="float64")

    return run


rouge_l = _scorer(rouge_l_pair)
rouge_lsum = _scorer(rouge_lsum_pair)
meteor = _scorer(meteor_pair)
