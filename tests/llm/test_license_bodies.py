"""Full licences license their directory; wrapped headers are found (operator 5)."""

import textwrap

from netvigil.llm import licenses
from netvigil.llm.license_bodies import BODIES

PLAIN = "def value of the list and return it to the table\nfor index in range number string result value"


def test_full_licences_license_their_directory(spark):
    files = [(i, f"{name}/LICENSE", f"{name} License\n\nCopyright (c) 2020 Some Body\n\n{text}") for i, (name, text) in enumerate(BODIES.items())]
    files += [(100 + i, f"{name}/src/a/x.py", f"{PLAIN} x{i}") for i, name in enumerate(BODIES)]
    files += [(200 + i, f"other/{i}/y.py", f"{PLAIN} y{i}") for i in range(60)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(BODIES):
        assert got[i] == (name, "own") and got[100 + i] == (name, name)
    assert all(got[200 + i] == (None, None) for i in range(60))


def test_wrapped_headers_are_compared_as_one_block(spark):
    body = "\n".join(f"w{i} = value{i} + other{i}" for i in range(60))
    files, want = [], {}
    for name, forms in licenses.TEMPLATES.items():
        for mark in ("# ", " * "):
            lines = "\n".join(mark + x + ("\n" + mark if k == 0 else "") for k, x in enumerate(textwrap.wrap(forms[-1], 24)))
            want[len(files)] = name
            files.append((len(files), f"h{len(files)}/x.py", f"import thing{len(files)}\n{lines}\n{body}"))
    files += [(1000 + i, f"p{i}/x.py", f"{PLAIN}\n{body}\nz{i}") for i in range(200)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {i: got[i] for i in want} == {i: (name, "own") for i, name in want.items()}
    assert all(got[1000 + i] == (None, None) for i in range(200))
