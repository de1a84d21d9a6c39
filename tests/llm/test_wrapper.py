"""Wrapper induction on hosts of copies, hosts of many shapes and parts with misleading names."""

from __future__ import annotations

import json
import random

from wakegrid.llm import wrapper
from wakegrid.llm.wrapper import extract_pages, fold, host_trees, main_text, set_apart, tree

PAGE = "<body><div class=top>Welcome to the site</div><article><h1>{}</h1><p>{}</article></body>"


def extracted(spark, htmls: list[str], url: str = "http://h.example/") -> list[str]:
    df = spark.createDataFrame([(k, url, h) for k, h in enumerate(htmls)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in extract_pages(df).orderBy("page_id").collect()]


def test_copies_of_a_page_are_no_template(spark):
    own = [PAGE.format(f"Title {k}", f"Words of {k}") for k in range(6)]
    got = extracted(spark, [PAGE.format("Hot", "What all copies say")] * 60 + own)
    assert got == ["Hot\nWhat all copies say"] * 60 + [f"Title {k}\nWords of {k}" for k in range(6)]
    # copies that differ in what is not text, and a host of nothing else
    assert extracted(spark, [f"<script>n={k}</script>" + PAGE.format("Hot", "Say") for k in range(12)]) == ["Hot\nSay"] * 12


def test_template_counts_pages_that_differ(spark):
    """On 5 of 6 different pages, though most rows are copies of the page without it."""
    body = "<body><div class=a>{}</div><div class=b>{}</div></body>"
    rows = [body.format("Template line", f"own {k}") for k in range(5)] + [body.format("Other line", "hot")] * 40
    assert extracted(spark, rows) == [f"own {k}" for k in range(5)] + ["Other line\nhot"] * 40


def test_article_of_near_copies_is_kept(spark):
    rows = [f"<body><p>visit {k}</p><article><h1>Hot</h1><p>All say this</article></body>" for k in range(20)]
    assert extracted(spark, rows) == ["Hot\nAll say this"] * 20


def test_shapes_are_folded_in_levels(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(wrapper, "FAN", 4)
    r = random.Random(2)
    made = {json.dumps([r.choice(["p", "ul", "h2", "pre", "table"]) for _ in range(6)]) for _ in range(150)}
    htmls = ["<body><article>" + "".join(f"<{t}>{k} {i}</{t}>" for i, t in enumerate(json.loads(m))) + "</article></body>" for k, m in enumerate(sorted(made))]
    monkeypatch.setattr(wrapper, "kept", lambda df, name, kept=wrapper.kept: sizes.append(name) or kept(df, name))
    trees = host_trees(spark.createDataFrame([("http://h.example", h) for h in htmls], "url string, html string")).collect()
    assert len(trees) == 1 and trees[0]["pages"] == len(htmls)
    assert len(sizes) >= 4, sizes
    monkeypatch.undo()
    assert fold([trees[0]["tree"]]) == trees[0]["tree"]
    assert extracted(spark, htmls) == ["\n".join(f"{k} {i}" for i in range(6)) for k in range(len(htmls))]


def test_names_that_set_nothing_apart():
    for tag, rest in [("div", ' style="overflow:hidden"'), ("div", " class='overflow-hidden'"), ("div", ' title="hidden gems"'), ("body", ' class="no-sidebar"'), ("body", ' class="right-sidebar"'), ("article", " class=legal"), ("section", ' id="related-work"'), ("div", ' class="post meta-analysis"'), ("div", ' aria-hidden="false"'), ("div", ' data-x="display:none"')]:
        assert not set_apart(tag, rest), (tag, rest)
    for tag, rest in [("div", " hidden"), ("div", ' hidden=""'), ("div", ' style="color:red; display: none"'), ("div", " class=ad"), ("div", ' class="ad-slot"'), ("div", ' class="x site-footer"'), ("div", ' id="comments"'), ("section", " class=related-posts"), ("div", ' class="more-stories"'), ("div", ' class="post-meta"'), ("div", ' role="navigation"'), ("nav", "")]:
        assert set_apart(tag, rest), (tag, rest)
    # names that set all text of a page apart
    assert main_text(tree('<body><div class="legal"><p>The law</div><div hidden>no</div></body>'), {}, set()) == "The law"


def test_main_slot_overrules_its_name(spark):
    body = '<body><h1>Title {k}</h1><div class="legal"><p>' + "Long words of the law {k}. " * 5 + '</p></div><div class="comments">I say {k}</div></body>'
    got = extracted(spark, [body.format(k=k) for k in range(8)])
    assert got == [f"Title {k}\n" + (f"Long words of the law {k}. " * 5).strip() for k in range(8)]


def test_deep_pages(spark):
    """10,000 nested elements: all text in its order, what is set apart stays so, and pages still align."""
    def page(depth: int, k: int) -> str:
        return "<body><div class=top>Same words</div>" + "".join(f"<div><p>in {i} of {k}" for i in range(depth)) + "<nav><div>gone</div></nav>" + "".join(f"</div>out {i}" for i in range(depth)) + "</body>"

    def told(depth: int, k: int) -> list[str]:
        return [f"in {i} of {k}" for i in range(depth)] + [f"out {i}" for i in range(depth)]

    for depth in (3, wrapper.DEEP + 3, 1500, 10_000):
        assert main_text(tree(page(depth, 1)), {}, set()).split("\n") == ["Same words", *told(depth, 1)]
    nested = "<div>" * 400 + "<aside>" + "<div>" * 400 + "gone" + "</div>" * 400 + "</aside>kept" + "</div>" * 400
    assert main_text(tree(nested), {}, set()) == "kept"
    got = extracted(spark, [page(2000, k) for k in range(6)])
    assert all("Same words" not in t and f"in 1999 of {k}" in t and "gone" not in t for k, t in enumerate(got))


def test_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, host string, tree string, fixed string")
    assert extract_pages(df).count() == 0
    odd = spark.createDataFrame([(1, None, None, "h", "t", "f"), (None, "http://h/", "<p>x", "h", "t", "f"), (1, None, "", "h", "t", "f")], df.schema)
    assert sorted((r["page_id"] or 0, r["text"]) for r in extract_pages(odd).collect()) == [(0, "x"), (1, ""), (1, "")]
