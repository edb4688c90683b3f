"""The decision rules stated over exact fractions, as a brute-force oracle.

A vote counts as (ordinal, specialism, model, class, confidence); everything below is
a sum, a set or a minimum over such tuples.
"""

import math
from fractions import Fraction

CLASSES = frozenset("Benign DoS DDoS Botnet Brute_Force Spoofing Probing Injection Data_Theft Unknown Error".split())


def counted(votes):
    """The valid votes as tuples, by ordinal."""
    ok = (v for v in votes if v.get("is_trained") and v.get("error") is None and v.get("prediction") is not None)
    return sorted((v["ordinal"], v["attack_type"], v["model_type"], v["prediction"], Fraction(v["confidence"]))
                  for v in ok if v.get("confidence") is not None and not math.isnan(v["confidence"]) and v["confidence"] > 0)


def conflict_count(rows, threshold=Fraction(0.7)):
    """Specialisms that name several classes, plus one if several specialisms are confident."""
    named = {(t, c) for _, t, _, c, _ in rows}
    split = sum(1 for t in {t for t, _ in named} if sum(1 for u, _ in named if u == t) > 1)
    return split + (len({t for _, t, _, _, p in rows if p > threshold}) > 1)


def ladder(attack, confidence, conflicts):
    """Level 0 to 3; a conflict lifts the two lower ones by one and bars the top."""
    c = round(float(confidence), 6)
    level = 0 if attack == "Benign" else sum(c >= step for step in (0.6, 0.8)) + (c >= 0.9 and not conflicts)
    if conflicts and level < 2:
        level += 1
    return ("Low", "Medium", "High", "Critical")[level]


def winner(scores, first):
    """The class with the largest score; of equal ones the first seen."""
    return min(scores, key=lambda c: (-scores[c], first[c]))


def decide(votes, strategy="weighted_voting", weights=None, default_w=0.5):
    rows = counted(votes)
    if not rows:
        return ("Unknown", "Unknown", 0.0, "Low", "default", 0)
    n = conflict_count(rows)
    if strategy == "highest_confidence":
        best, score = next((c, p) for _, _, _, c, p in rows if p == max(r[4] for r in rows))
    else:
        majority = strategy == "majority_voting"
        given = {m: Fraction(w) for m, w in (weights or {"lstm": 0.6, "svm": 0.4}).items()}
        total = sum(given.values())
        if abs(total - 1) > Fraction(1, 100):
            given = {m: w / total for m, w in given.items()}
        share = {r: Fraction(1) if majority else given.get(r[2], Fraction(default_w)) for r in rows}
        models = [r[2] for r in rows]
        walk = rows if majority else sorted(rows, key=lambda r: (models.index(r[2]), r[0]))
        order = [r[3] for r in walk]
        exact = {c: sum(share[r] * (1 if majority else r[4]) for r in rows if r[3] == c) / sum(share.values()) for c in order}
        # scores that differ by less than the engine's rounding are ties
        best = winner({c: round(s, 9) for c, s in exact.items()}, {c: order.index(c) for c in order})
        score = exact[best]
        strategy = strategy if majority else "weighted_voting"
    attack = best if best in CLASSES else "Unknown"
    return (attack, best, float(score), ladder(attack, score, n), strategy, n)
