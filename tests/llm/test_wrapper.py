from clickgap.llm import wrapper

PAGE = "page_id long, url string, html string, host string, text string"


def text_of(html):
    return "\n\n".join(s for _, s in wrapper.blocks(wrapper.parse(html)))


def test_article_without_furniture():
    html = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head>
    <body><header>site</header><nav><ul><li>menu</ul></nav><div class="ad">buy</div>
    <article><header><h1>Ti&amp;tle &copy</h1></header><p>one<br>two <b>three
    <p>four &lt;tag&gt; &#233;&nbsp;x<form>f</form><div id="comments"><p>nice!</p></div>
    <aside>side</aside><div class="social-share">share</div><p class="lead">five</p><ul><li>six<li>seven</ul>
    </article><div class="cookieNotice">cookies</div><footer>foot</footer></body>"""
    assert text_of(html) == "Ti&tle ©\n\none two three\n\nfour <tag> é x\n\nfive\n\nsix\n\nseven"


def test_pages_without_marks_and_broken_pages():
    assert text_of("<div>a<p>b</div>c") == "a\n\nb\n\nc"
    assert text_of("plain & text") == "plain & text"
    assert text_of("<p>open <i>never closed") == "open never closed"
    assert text_of("</p></div>x<!-- y <p> --> z") == "x z"
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert text_of("<script>never ends <p>") == "" and text_of("") == "" and text_of("<") == "<"
    assert text_of("<div class='download-area'>kept</div><div class='adverts'>gone</div>") == "kept"


def test_words_that_do_not_name_the_element():
    for name in ("content has-sidebar", "no-sidebar", "page-with-comments", "hasSidebar", "sidebar-layout"):
        assert text_of(f"<div class='{name}'><p>a</p></div>") == "a"
        assert text_of(f"<div class='{name}'><article><p>a</p></article><div class='sidebar'>b</div></div>") == "a"
    # a word never excludes what holds the article or main
    assert text_of("<div class='content sidebar'><article>a</article><div id='comments'><article>b</article></div></div>") == "a"
    assert text_of("<div id='menu'><main><div class='sidebar-right'><article>a</article></div></main></div>") == "a"
    # but other articles of marked elements stay out
    assert text_of("<article>a</article><div class='related'><article>b</article></div>") == "a"
    assert text_of("<main><p>a</p><div id='comments'><article class='comment'>b</article></div></main>") == "a"


def test_slug_ids_inside_an_article():
    html = """<article><h2 id='related-work'>Related work</h2><p>one</p><section id='social-history'><p>two</p></section>
    <h2><span id='Notice'>Notice</span></h2><section id='comments'><p>nice!</p></section>
    <section id='x' class='related'>more</section><div id='share'>share</div></article>"""
    assert text_of(html) == "Related work\n\none\n\ntwo\n\nNotice"


def matched(a, b):
    ra, rb = wrapper.parse(a), wrapper.parse(b)
    wrapper.nodes(ra), wrapper.nodes(rb)
    return wrapper.match_trees(ra, rb)


def brute_size(x, y):
    """Simple tree matching by its recursion."""
    if x.tag != y.tag or x.mark != y.mark:
        return 0
    m, n = len(x.children), len(y.children)
    t = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1],
                          t[i - 1][j - 1] + brute_size(x.children[i - 1], y.children[j - 1]))
    return t[m][n] + 1


def test_tree_matching_equals_the_recursion():
    import random
    rng = random.Random(1)

    def page(depth):
        if depth == 0:
            return "x"
        return "".join(f"<{t}>{page(depth - 1)}</{t}>" for t in rng.choices(["div", "span", "section"], k=rng.randrange(4)))
    for _ in range(150):
        a, b = page(4), page(4)
        pairs = matched(a, b)
        assert len(pairs) == brute_size(wrapper.parse(a), wrapper.parse(b))
        assert all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_very_deep_pages():
    a, b = "<div>" * 4000 + "a", "<div>" * 3999 + "<p>b</p><div>a"
    assert len(matched(a, b)) == 4001


def test_constant_nodes_are_template(spark):
    rows = [(i, f"http://h.com/{i}", f"<div><p>Welcome to our site</p><p>Story {i} tells {i * 7}</p><p>Read more below</p></div>",
             None, None) for i in range(20)]
    rows += [(100 + i, f"http://copy.com/{i}", "<div><p>Same story</p><p>everywhere</p></div>", None, None) for i in range(20)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i] == f"Story {i} tells {i * 7}" for i in range(20))
    assert all(got[100 + i] == "Same story\n\neverywhere" for i in range(20))     # copies prove nothing


def test_ids_of_a_page_do_not_break_the_alignment(spark):
    rows = [(i, f"http://h.com/{i}", f"<div id='post-{i}'><p>Welcome to our site</p><p>Story {i}</p></div>", None, None)
            for i in range(20)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i] == f"Story {i}" for i in range(20))


def test_odd_rows(spark):
    rows = [(1, None, None, "a", "b"), (2, "http://x.org", "", None, None), (None, "odd", "<p>q</p>", None, None),
            (3, "//user@X.org:80/a?b", "<p>" + "w " * 200_000 + "</p>", None, None), (3, "", "<p>again</p>", None, None),
            (4, "http://x.org/", "<p>" + "<b>" * 3000 + "deep", None, None)]
    df = spark.createDataFrame(rows, PAGE)
    got = wrapper.extract(df).collect()
    assert sorted((len(r.text), r.page_id is None) for r in got) == sorted(
        [(0, False), (0, False), (1, True), (399_999, False), (5, False), (4, False)])
    assert wrapper.extract(df.limit(0)).count() == 0
