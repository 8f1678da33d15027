import html
import random

from polyad.llm.html_main import extract, main_text

P1 = "The first paragraph, which is long enough, has commas, and says something of interest to readers."
P2 = "A second paragraph &amp; more: it goes on,   and on,\n and ends here &eacute;&#233;."
PAGE = f"""<!DOCTYPE html><html><head><title>T, t</title><style>p{{}}</style><script>var a="</p><p>no, no, no";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><p>Welcome, dear reader, to this fine site of ours, enjoy.</p></header>
<nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav><div class="ad">Buy this, now, or that, for less, today, everyone.</div>
<div id=wrap><article><h1>Head <i>line</i></h1><p>{P1}<p>{P2}<br>after</p><aside>Aside, aside, aside, with lots of text in it.</aside>
<ul><li>item 1<li>item 2</ul><form><p>Your name, please, and your address, and all.</p></form>
<div class="comments"><p>Reader says, this is great, really, truly great, wow.</p></div></article></div>
<div class="sidebar"><p>Popular, posts, of, the, week, and so on and so forth.</p></div><!-- c, c --><footer>&copy; me, you</footer>"""
WANT = "\n\n".join(["Head line", P1, "A second paragraph & more: it goes on, and on, and ends here éé. after", "item 1", "item 2"])


def test_article():
    assert main_text(PAGE) == WANT
    assert main_text(PAGE.upper().replace("&AMP;", "&amp;").replace("&EACUTE;", "&eacute;")).split("\n\n")[0] == "HEAD LINE"


def test_without_article_tag():
    body = f"<body><div class=menu><a>x</a></div><div id=content><h2>Title</h2><p>{P1}</p><p>{P1}</p></div><div class=footer><p>{P1}</p></div>"
    assert main_text(body) == f"Title\n\n{P1}\n\n{P1}"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body><script>x") == main_text("<!-- open") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>a < b</p><p>unclosed <a href='x>y") == "a < b\n\nunclosed y"
    for cut in range(0, len(PAGE), 7):
        assert isinstance(main_text(PAGE[:cut]), str)
    long = f"<article>{'<p>' + P1 + '</p>'}" * 3000
    assert main_text(long).count(P1) == 3000
    assert main_text("<div>" * 3000 + P1) == P1


def test_random_pages(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(40):
        blocks = [" ".join(rng.choice(["alpha", "beta,", "gamma", "<x>", "&", "é", "delta."]) for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 8))]
        body = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
        rows.append((i, None, f"<body><nav><a>m</a></nav><main>{body}</main><footer>x, y, z</footer></body>", "extra"))
        want.append("\n\n".join(blocks))
    rows.append((None, "u", None, None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(spark, df).collect()
    assert [r.text for r in out] == [*want, ""]
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract(spark, df.limit(0)).count() == 0


def test_wrappers_are_not_cut():
    text = f"<p>{P1}</p><p>{P1}</p><p>{P1}</p>"
    want = "\n\n".join([P1] * 3)
    around = "<body><nav><a href=/>Home</a></nav>{}<div class=footer><p>Imprint, privacy, and terms of use.</p></div></body>"
    for body in (f"<form id=aspnetForm><article>{text}</article></form>", f"<form><div>{text}</div></form>", f"<div class=page-with-sidebar><div>{text}</div></div>", f"<div class=content-widget>{text}</div>", f"<form><div class=content-widget>{text}</div><div class=sidebar>Popular, posts</div></form>", f"<header><h1>Site</h1></header><form>{text}</form>"):
        assert main_text(around.format(body)).split("Site\n\n")[-1] == want, body
    assert main_text(around.format(f"<article>{text}</article><form><p>{'Your name, please. ' * 50}</p></form>")) == want
    assert main_text(around.format(f"<h1>Head</h1>{text}<div class=comments><p>{'Great, really. ' * 50}</p></div>")) == f"Head\n\n{want}"
    assert main_text(around.format(f"<div>{text}</div><div style='display:none'><p>{'Hidden, all of it. ' * 50}</p></div>")) == want


def test_names_only_weigh():
    text = f"<p>{P1}</p><p>{P1}</p><p>{P1}</p>"
    want = "\n\n".join([P1] * 3)
    around = "<body><nav><a href=/>Home</a></nav>{}<div class=footer><p>Imprint, privacy, and terms of use.</p></div></body>"
    for body in (f'<div class="layout-with-sidebar"><div id="content">{text}</div></div>', f'<div class="entry header-image">{text}</div>', f'<div class="social-history">{text}</div>', f'<article><p class="notice-period">{P1}</p><p class="related-work">{P1}</p><p>{P1}</p></article>', f'<div id=wrap><div class="social-history">{text}</div><div class="sidebar-left"><p>{P1}</p></div></div>'):
        assert main_text(around.format(body)) == want, body
    menu = "<ul class=promo-grid-x><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"
    assert main_text(around.format(f"<article>{text}{menu}<div class=newsletter-cta>Join now</div></article>")) == want


def brute_scores(html):
    """Scores from the bottom up by walking all pairs of a block and a block above it."""
    from polyad.llm import html_main as H

    nodes, texts = H.parse(html)
    score, size = [0.0] * len(nodes), [[0, 0, 0] for _ in nodes]
    for n, text, link in texts:
        b, k = n.block.index, len(text.strip())
        size[b] = [size[b][0] + k, size[b][1] + k * link, size[b][2] + text.count(",")]
    for n in nodes:
        chars, links, commas = size[n.index]
        if n.block is not n or chars < 25:
            continue
        points = (1 + commas + min(chars / 100, 3)) * (1 - links / chars)
        up, share = n, 1.0
        while up.parent is not None:
            up = up.parent.block
            score[up.index] += points * share
            share /= 2
    return score


def test_scores_match_brute_force(monkeypatch):
    from polyad.llm import html_main as H

    rng = random.Random(9)
    for _ in range(60):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<section>", "</section>", P1, "short, text "]) for _ in range(rng.randrange(1, 80)))
        kept = []
        parse = H.parse
        monkeypatch.setattr(H, "parse", lambda h: kept.append(parse(h)) or kept[-1])
        H.main_text(html)
        monkeypatch.setattr(H, "parse", parse)
        want = brute_scores(html)
        assert all(abs(n.score - w) < 1e-6 for n, w in zip(kept[0][0], want))


def test_nesting_takes_linear_time():
    import time

    for html in ("<div>" * 8000 + P1, "<b>" * 8000 + "<p>x" * 8000, "<div>" * 8000 + "</section>" * 8000, "<li>" * 8000 + P1, "<div><b>" * 4000 + f"<p>{P1}" * 4000):
        began = time.time()
        assert isinstance(main_text(html), str)
        assert time.time() - began < 2
    assert len(main_text("<article><p>" + "A long, plain sentence. " * 500_000)) > 10_000_000


def test_columns_of_other_tables(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{P1}</p></article>", 7)], "page_id long, url string, html string, n_chars long")
    assert [tuple(r) for r in extract(spark, df).collect()] == [(1, "u", P1, len(P1))]
