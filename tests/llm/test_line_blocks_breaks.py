"""Blocks that stand apart inside an unmarked article do not end it (operator 9)."""

import pytest

from netvigil.llm import html_extract

BLOCK = "<div class='ad'><p>Buy</p><p>now</p><p>here</p><p>cheap</p></div>"


@pytest.mark.parametrize("block", [BLOCK, BLOCK.replace("div class='ad'", "form").replace("/div", "/form"), BLOCK.replace("class='ad'", "class='related'")])
def test_all_parts_of_an_unmarked_article_stay(block):
    parts = [[f"Part {k}", *[f"{'long words here ' * n}{k} {i}." for i in range(4)]] for k, n in enumerate((8, 12, 6))]
    body = (block + "<h3>Between</h3>" + block).join("".join(f"<p>{x}</p>" for x in p) for p in parts)
    page = f"<ul class='menu'><li>Home</li><li>News</li><li>About</li></ul><div>{body}</div><div id='footer'>{'foot ' * 50}</div>"
    got = html_extract.main_text(page)
    assert got == "\n".join(x for p in [parts[0], ["Between"], parts[1], ["Between"], parts[2]] for x in p)
