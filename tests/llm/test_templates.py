"""Pages whose template, wrappers and marks decide what their main text is."""

import time

from hanmoa.llm import templates


def texts(spark, pages):
    rows = [(i, "http://a.com/", p) for i, p in enumerate(pages)]
    got = templates.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_template_text_goes_from_articles_by_class(spark):
    pages = [f"<body><article><p>Sign up now<p>story {i}</article>" for i in range(2)]
    pages += ["<body><article><p>Sign up now<p>copied one<p>copied two</article>"] * 4
    assert texts(spark, pages) == ["story 0", "story 1", *["copied one\n\ncopied two"] * 4]


def test_wrappers_and_loose_marks_stay(spark):
    shells = [
        "<body class=no-sidebar><article>{}</article>",
        "<body><div class=has-sidebar><article>{}</article></div>",
        "<body><article class='post no-comments'>{}</article>",
        "<body><form><article>{}</article><nav>m</nav></form>",
        "<body><div class=widget><main>{}</main></div>",
        "<body><article><div class=entry-header>{}</div><div class=comments-area>c</div></article>",
    ]
    for shell in shells:
        assert texts(spark, [shell.format(f"story {i}") for i in range(3)]) == [f"story {i}" for i in range(3)], shell
    once = "<body><article>story {}<div class={}>aside</div></article>"
    assert texts(spark, [once.format(0, "notice"), once.format(1, "x"), once.format(2, "x")])[0] == "story 0\n\naside"
    assert texts(spark, [f"<body><div>a long story {i}</div><div class=comments><article>c{i}</article></div>" for i in range(2)]) == ["a long story 0", "a long story 1"]


def test_all_marks_of_an_element_count(spark):
    many = " ".join(f"{c}{c}" for c in "abcdefghij") + " w-1/2 md:x sidebar"
    pages = [f"<body><div class='{many}'>advert {i}</div><div>story {i}</div>" for i in range(3)]
    assert texts(spark, pages) == [f"story {i}" for i in range(3)]
    other = many.replace("jj", "kk").replace("sidebar", "x")
    assert templates._step("div", f"class='{many}'") != templates._step("div", f"class='{other}'") and "/" not in templates._step("div", f"class='{many}'")


def blocks(page):
    return [t for kind, _, t in templates.tokens(page) if kind == "text"]


def test_tags_are_read_as_browsers_read_them():
    assert blocks("<p data-x=don't>Hello</p>") == ["Hello"]
    assert blocks("<p title='a > b' data=\"c > d\" x = 'e>'>Hello <b class=x'y>you</b></p>") == ["Hello you"]
    assert blocks("a < b <3 c<!-->d<!-- > -->e<![CDATA[ f ]]>g</>h<?php x ?>i") == ["a < b <3 cdeghi"]
    assert blocks("x<p title='never closed>y</p>") == ["x"] and blocks("x<p") == ["x"] and blocks("x<script>y</script") == ["x"]
    assert blocks("<title>t</TITLE x>a<style></styles></style>b") == ["ab"]
    assert blocks(f"&#{'9' * 5000};&#x1F600;&amp;&#65") == ["\ufffd😀&A"]


def test_very_long_pages_take_time_in_proportion():
    for part in ("<a ", "<p x='", "<div>", "</div>", "<div></p></div>", "<!--", "</script", "<script>", "<b>x", "&#1", "<div class=a>", "='"):
        began = time.process_time()
        sum(len(t) for _, _, t in templates.tokens(part * (1_000_000 // len(part))))
        assert time.process_time() - began < 3, part
    deep = "<div>" * 1000 + "text" + "</div>" * 1000 + "<article>after</article>"
    assert blocks(deep) == ["text", "after"]
