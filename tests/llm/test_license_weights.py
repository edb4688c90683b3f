"""Words outside the templates weigh by their own document frequency (operator 5)."""

import math
from collections import Counter

import pytest

from netvigil.llm import licenses

COMMON = "return value index number string list table result".split()


def brute(files):
    """Cosine of the best line or whole file, with idf over all words of all files."""
    n, df = len(files), Counter(w for t in files for w in set(licenses._words(t)))

    def vector(text):
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(licenses._words(text)).items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {w: a / norm for w, a in v.items()}

    rows = [vector(x) for t in licenses.TEMPLATES.values() for x in t]
    return {t: max(sum(a * r.get(w, 0) for w, a in v.items()) for v in map(vector, [*t.split("\n"), t]) for r in rows) for t in files}


def test_common_words_beside_a_notice_do_not_hide_it(spark):
    plain = [f"{' '.join(COMMON)} u{i}" for i in range(300)]
    noted = [f"{' '.join(COMMON[:k])} Released under the MIT License. {' '.join(COMMON[k:2 * k])}" for k in range(1, 5)]
    files = plain + noted + noted[:2] + ["x1 x2 x3 x4 x5 x6 Released under the MIT License."]
    rows = [(i, f"d{i}/f", t) for i, t in enumerate(files)]
    got = {r.doc_id: r for r in licenses.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = brute(files)
    assert len(got) == len(files)
    for i, t in enumerate(files[300:], 300):
        assert got[i].cosine == pytest.approx(want[t], abs=1e-9) and got[i].own == ("MIT" if want[t] >= licenses.FILE_THRESHOLD else None)
    assert all(got[i].own == "MIT" for i in range(300, 306)) and all(got[i].own is None and got[i].cosine == 0 for i in range(300))
