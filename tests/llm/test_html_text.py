import html
import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from rankflow.llm import html_text as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-banner">We use cookies. Please agree, or leave.</div>
<div id=content><h1>A&nbsp;title &amp; more</h1><p>First   paragraph, with <b>bold</b>
and a <a href=/x>link</a>. It goes on for a while, so that it counts.
<p>Second paragraph &lt;here&gt;; it is <span class="ad">buy this</span> long enough, and has commas.</p>
<ul><li>one point, which is short</li><li>another point.</li></ul>
<blockquote>Said someone, once.</blockquote>
<form><label>Mail</label><input name=q><button>Go</button></form></div>
<aside>Read also: something else, somewhere.</aside>
<div id="comments"><p>I think, as a reader, that this is a very long comment; it has points, too. Really!</p></div>
<footer>&copy; someone. All rights, reserved.</footer></body></html>"""


def test_article_without_the_rest():
    assert m.main_text(PAGE).split("\n") == [
        "A title & more",
        "First paragraph, with bold and a link. It goes on for a while, so that it counts.",
        "Second paragraph <here>; it is",
        "long enough, and has commas.",
        "one point, which is short",
        "another point.",
        "Said someone, once.",
    ]


def test_one_long_paragraph_or_section_does_not_drop_the_others():
    long = " ".join(["A long sentence, with commas, that goes on."] * 60)
    short = ["A first paragraph, which is not so long, but has points. It counts, too.", "The last paragraph, also short, ends the text. So it does, indeed."]
    page = f"<body><nav><a href=/>Home</a></nav><div id=story><h1>Heading</h1><p>{short[0]}</p><p>{long}</p><p>{short[1]}</p></div><footer>All rights, reserved.</footer></body>"
    assert m.main_text(page).split("\n") == ["Heading", short[0], long, short[1]]
    page = f"<body><div id=story><section><h2>One</h2><p>{short[0]}</p></section><section><h2>Two</h2><p>{long}</p><p>{long}</p></section><section><h2>Three</h2><p>{short[1]}</p></section></div></body>"
    assert m.main_text(page).split("\n") == ["One", short[0], "Two", long, long, "Three", short[1]]


def test_names_around_the_article_do_not_bar_it():
    text = ["A first paragraph, which has points. It counts, too.", "A second one, which is longer, goes on for a while. It ends here."]
    story = f"<h1>Heading</h1><p>{text[0]}</p><p>{text[1]}</p>"
    side = "<div class=sidebar><p>Read also, if you like, something else.</p></div><div id=comments><article><p>I think, as a reader, not so.</p></article></div>"
    for name in ("layout has-sidebar", "no-sidebar", "post tags-politics", "category-search", "widget-text-editor", "post comments-open"):
        for inside in (story, f"<article>{story}</article>", f"<main>{story}</main>"):
            page = f'<body><nav><a href=/>Home</a></nav><div class="{name}">{inside}{side}</div><footer>All rights, reserved.</footer></body>'
            assert m.main_text(page).split("\n") == ["Heading", *text], (name, inside)
    # Parts of one kind count together; hidden articles, teasers and long comments stay out.
    page = "<body>" + "".join(f'<div class="widget-text-editor"><p>{t}</p></div>' for t in text * 2) + side + "</body>"
    assert m.main_text(page).split("\n") == text * 2
    assert m.main_text(f"<body><div hidden><article>{story}</article></div></body>") == ""
    page = f"<body><div><h1>Heading</h1><p>{text[0]}</p><p>{text[1]}</p></div><div class=related><article><p>A teaser, short.</p></article></div><div id=comments>" + "<p>I think, as a reader, that this is long.</p>" * 9 + "</div></body>"
    assert m.main_text(page).split("\n") == ["Heading", *text]


STORY = ["A first paragraph, which has points. It counts, too.", "A second one, which is longer, goes on for a while. It ends here, at last.", "The third, like the others, has commas; it is there for the ratios."]


def test_forms_names_and_open_elements():
    """Pages on which more than the ratios would have lost the article."""
    story = "<h1>Heading</h1>" + "".join(f"<p>{t}</p>" for t in STORY)
    want = ["Heading", *STORY]
    assert m.main_text(f"<body><form action=x><div>{story}</div><input name=q></form></body>").split("\n") == want
    assert m.main_text(f"<body><form><div id=main>{story}</div><label>Mail</label></form><footer>All rights, reserved.</footer></body>").split("\n") == want
    assert m.main_text(f"<body><div class='post search-result'>{story}</div></body>").split("\n") == want
    assert m.main_text(f"<html><head><title>Open<body><div>{story}</div></body>").split("\n") == want
    assert m.main_text(f"<html><head><script>var a = 1;<body><div>{story}</div></body>").split("\n") == want
    many = "<div>" * 70
    assert m.main_text(f"<body><nav>{many}<a href=/>Home</a></nav><div>{story}</div></body>").split("\n") == want
    deep = "<div>" * 600
    assert m.main_text(f"<body>{deep}{story}</div></body>").split("\n") == want
    small = f"<body><div id=x>{story}<form><p>Your name, please, and mail. Then send it.</p></form></div></body>"
    assert m.main_text(small).split("\n") == want


def test_boxes_inside_the_content_node():
    """Link lists, calls to share or subscribe and pointers elsewhere stay out; short pieces of text stay in."""
    story = f"<h1>Heading</h1><p>{STORY[0]}</p><div class=share>Share on X</div><p>{STORY[1]}</p><ul><li><a href=/1>Read this</a></li><li><a href=/2>And that</a></li></ul><p>{STORY[2]}</p><p>Yes.</p><table><tr><td>12, or so.</td><td>None.</td></tr></table><div>Subscribe to our list</div><div class=related>Related: foo, bar. And more, of it.</div>"
    want = ["Heading", *STORY, "Yes.", "12, or so.", "None."]
    for page in (f"<body><div id=content>{story}</div></body>", f"<body><article>{story}</article></body>", f"<body><section>{story}</section><div>Links</div></body>"):
        assert m.main_text(page).split("\n") == want


def test_pages_without_an_article_element():
    """Marked-up expectations: what lies in data-want is the text."""
    r = random.Random(4)
    sentence = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(k)).capitalize() + ","[: r.randint(0, 1)] + " so it is."
    good = total = extra = 0
    for k in range(60):
        parts, want = [], []
        for i in range(r.randint(3, 12)):
            t = sentence(r.randint(4, 60))
            want.append(t)
            parts.append(r.choice(("<p>%s</p>", "<p>%s", "<div><p>%s</p></div>", "<blockquote>%s</blockquote>" if i else "<p>%s</p>")) % t)
            if r.random() < 0.2:
                want.append(h := "Part " + str(i))
                parts.append(f"<h2>{h}</h2>")
        if want[-1].startswith("Part"):
            want.pop(), parts.pop()
        menu = "<ul>" + "".join(f"<li><a href=/{j}>{sentence(1)}</a></li>" for j in range(8)) + "</ul>"
        around = r.choice(("<div id=page><div class=body-%d>%%s</div>%%s</div>" % k, "<table><tr><td>%s</td></tr></table>%s", "<section>%s</section><div>%s</div>", "<form>%s</form>%s"))
        side = f"<div class=sidebar><p>{sentence(9)}</p></div>{menu}<div class='user-comments'><p>{sentence(12)}</p><p>{sentence(9)}</p></div>"
        page = f"<html><head><title>x</title></head><body><div class=top>{menu}</div>" + around % ("".join(parts), side) + "<div id=footer>Copyright, us.</div></body></html>"
        got = m.main_text(page).split("\n")
        good += len(set(want) & set(got))
        total += len(want)
        extra += len(set(got) - set(want))
        if set(got) - set(want):
            print(page, got, want)
    assert good == total and extra <= 0.01 * total


def test_given_pages():
    """The pages' articles hold a heading and paragraphs between <article> and </article>."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    for page in pages.html:
        inside = page.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        parts = re.split(r"</?(?:p|h1|li|ul|div|br)[^>]*>", inside)
        want = [x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x]
        assert m.main_text(page).split("\n") == want


def test_broken_pages():
    for bad in ("", "<", "<p", "</p></div>", "<!--", "<script>", "<a <b <c", "text only, no tags.", "<p>x<", "&#xD800;&#0;&bogus;"):
        assert isinstance(m.main_text(bad), str)
    assert m.main_text("<article><p>One, two.<p>Three, four. <!-- <p>no</p> ") == "One, two.\nThree, four."
    began = time.time()
    for piece in ("<div>", "<a ", '<a "', "<p>x", "<script>", "<!-- ", "</div>", "<b class=ad>", "&amp;", "<div>x", "<div class=ad>x", "<title>", "<form>x", "<h2>x", "<article>x", "<li><a href=x>y</a>"):
        m.main_text(piece * 30_000)
    assert time.time() - began < 60


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 1), (None, None, None, None, 2), (1, "u", PAGE, "x", 1), (2, "", "", "y", None)], "page_id long, url string, html string, text string, n_chars int")
    rows = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in m.extract(df).collect()))
    assert len(rows) == 4 and all(n == k for _, n, k in rows) and rows[0][1] == 0
    assert m.extract(df.where(F.lit(False))).count() == 0


LONG = ["A first paragraph of some length, which has points, as paragraphs do. It counts, too.", "A second one, which is longer, goes on for a while and a while more. It ends here, at last.", "The third, like the others, has commas; it is there for no other reason, or so they say."]


def wrapped(inside, tag="article"):
    return f"<html><body><nav><a href=/>Home</a></nav><{tag}>{inside}</{tag}><footer>All rights, reserved.</footer></body></html>"


def lines(page):
    return m.main_text(page).split("\n")


def test_attributes_count_by_their_exact_names():
    story = "".join(f"<p>{t}</p>" for t in LONG)
    for around in ('<div title="A hidden gem">%s</div>', '<section aria-label="Hidden costs">%s</section>', '<article data-hidden="false">%s</article>', "<div data-role=comment data-class='ad'>%s</div>", '<div alt="class=ad id=comments hidden">%s</div>', "<div title=' style=display:none '>%s</div>"):
        assert lines(wrapped(around % story)) == LONG, around
        assert lines(wrapped(around % story, "div")) == LONG, around
    for p in ('<p data-style="display:none">%s</p>', '<p title="hidden">%s</p>', "<p data-hidden>%s</p>", "<p style='color:red'>%s</p>", '<p aria-hidden="false">%s</p>'):
        assert lines(wrapped("".join(p % t for t in LONG))) == LONG, p
    for p in ("<p hidden>%s</p>", "<p HIDDEN=''>%s</p>", "<p style='color:red; display : none'>%s</p>", '<p aria-hidden="true">%s</p>', "<p aria-hidden=true class=x>%s</p>"):
        assert lines(wrapped(story + p % "This one is not to be seen, by anyone. Not at all, ever.")) == LONG, p
    for link in ('<a href="/w/hidden" title="Hidden variable">hidden variable</a>', '<a href="/x?role=comment">hidden variable</a>', "<a href=/x?class=ad&id=share>hidden variable</a>", "<span class=ad-hoc>hidden variable</span>", '<em data-id="comments">hidden variable</em>'):
        text = [f"It is a {link} that they speak of, in general. Others, however, do not.", *LONG]
        assert lines(wrapped("".join(f"<p>{t}</p>" for t in text))) == ["It is a hidden variable that they speak of, in general. Others, however, do not.", *LONG], link


def test_buttons_and_labels_need_no_attributes():
    for bare in ("<button>Accept all</button>", "<label>Your mail.</label>", "<button type=button>Accept all</button>"):
        assert lines(wrapped(f"<p>{LONG[0]}</p>{bare}<p>{LONG[1]}</p>")) == LONG[:2]
        half = LONG[2].split("; ")
        assert lines(wrapped(f"<p>{LONG[0]}</p><p>{half[0]}; {bare}{half[1]}</p><p>{LONG[1]}</p>")) == [LONG[0], LONG[2], LONG[1]]


def test_names_inside_of_the_article_are_for_the_ratios():
    p = [f"<p>{t}</p>" for t in LONG]
    for name in ("search", "related-work", "comments", "sharing", "tags"):
        assert lines(wrapped(f"{p[0]}<h2 id='{name}'>On this</h2>{p[1]}{p[2]}")) == [LONG[0], "On this", *LONG[1:]], name
    for name in ("related-work", "search", "notices", "promotion"):
        assert lines(wrapped(f"{p[0]}<section id='{name}'><h2>On this</h2>{p[1]}{p[2]}</section>")) == [LONG[0], "On this", *LONG[1:]], name
    short = "<p>Mail, please.</p>"
    for name in ("newsletter", "share", "related"):
        assert lines(wrapped(f"{p[0]}<div class='{name}'>{short}</div>{p[1]}{p[2]}")) == LONG, name
    # What readers wrote stays out, however long it is.
    assert lines(wrapped("".join(p) + f"<section id=comments><p>{LONG[1]}</p><p>{LONG[2]}</p></section>")) == LONG


def test_code_and_boxes_without_punctuation():
    p = [f"<p>{t}</p>" for t in LONG]
    for around in ("article", "main", "div"):
        assert lines(wrapped(f"{p[0]}<div class=code>let x = 1</div>{p[1]}{p[2]}", around)) == [LONG[0], "let x = 1", *LONG[1:]]
        assert lines(wrapped(f"{p[0]}<pre>let x = 1</pre>{p[1]}{p[2]}", around)) == [LONG[0], "let x = 1", *LONG[1:]]
    plain = ["Roses are red and violets are blue", "Sugar is sweet and so are you", "No marks stand in any of these lines"]
    page = "<html><body><ul><li><a href=/>Home</a></li></ul>" + "".join(f"<div>{t}</div>" for t in plain) + "</body></html>"
    assert lines(page) == plain


def test_nested_names_to_any_depth():
    deep = 200
    names = "".join(f"<div class='widget w{i}'>" for i in range(deep))
    page = f"<body><div id=story>{''.join(f'<p>{t}</p>' for t in LONG * 3)}</div>{names}<p>Short, this.</p>{'</div>' * deep}</body>"
    assert lines(page) == LONG * 3


REALISTIC = [
    # A blog in divs, with a byline, tags and a comment form.
    """<body class="home blog"><div id="header"><a href="/"><img src=l.png></a><div class="menu"><ul><li><a href=/a>About</a></li><li><a href=/c>Contact</a></li></ul></div></div><div id="wrap"><div class="entry"><h1>On gardens</h1><div class="entry-content"><p>Gardens are old, and they are made by hand. So it was, and so it is.</p><p>My own one is small, but the soil is good; I dug it twice, in spring.</p><blockquote>A garden, they say, is never done.</blockquote><p>What grows there? Beans, mostly, and a rose or two.</p></div><div class="tags">Filed under <a href=/t/1>Plants</a></div></div><div id="sidebar"><h3>Recent</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></div><div id="footer">Copyright 2020, me.</div></body>""",
    # A newspaper in sections, with a paywall notice and related links.
    """<body><header><a href=/>The Paper</a></header><section class="story-body"><h1>Town votes on bridge</h1><p>The town council voted on Monday, after a long debate, to build a new bridge. It will open in May.</p><p>"We are glad," said the mayor, who had pushed for it. Others were not so sure.</p><h2>What it costs</h2><p>The bridge costs two million, of which the state pays half. The rest, it is hoped, comes from tolls.</p></section><div class="related"><h3>Related</h3><a href=/1>Old bridge closed</a><a href=/2>Ferry returns</a></div><div class="paywall">Subscribe now, and read on.</div><footer>All rights reserved.</footer></body>""",
    # A manual with code.
    """<body><div class="navbar"><a href=/>Docs</a> <a href=/api>API</a></div><div class="content"><h1>Install</h1><p>First, fetch the package with the tool that you use. It takes a minute, at most.</p><pre>get package</pre><p>Then, start it. If all is well, you will see a prompt; if not, read the log.</p><ul><li>Linux, any kind, works.</li><li>So does a Mac, from 2015 on.</li></ul></div><div class="footer">Built with care.</div></body>""",
    # A table layout of long ago.
    """<html><body><table width=100%><tr><td width=150><a href=1.htm>Home</a><br><a href=2.htm>Links</a></td><td><h2>My trip to the sea</h2><p>We left at dawn, by train, and it rained all the way down to the coast. Nobody minded, since we had tea, and a pack of cards.<p>At noon the sun came out, the sea was calm, and we swam for an hour or so. It was cold, as it always is in June, but we did not care!<p>Then we went home, tired, but glad.</td></tr></table><center><font size=1>Last change: 1999</font></center></body></html>""",
    # A forum answer: main, with a vote button and readers' comments.
    """<body><nav><a href=/>Q</a></nav><main><h1>How do I sort a list?</h1><p>I have a list, and I want it sorted by its second part. How is it done, please?</p><button>Vote</button><p>You pass a key: a function, which takes one item and gives what is compared. It is stable, too.</p><div class="comments"><p>Thanks, this worked for me, and saved my day. Great!</p></div></main></body>""",
    # A recipe with a list and a newsletter box.
    """<body><div id=top><a href=/>Food</a></div><article><h1>Soup</h1><p>This soup is quick, and it is good on cold days. Serve it hot, with bread.</p><h2 id="related-tools">What you need</h2><ul><li>two onions, sliced</li><li>salt, as you like</li></ul><div class="newsletter-signup"><p>Get more, by mail.</p></div><p>Fry the onions until they are brown, then add water. Cook for an hour, and stir now and then.</p></article></body>""",
    # A press release with a hidden paragraph and a script inside.
    """<body><div class="cookie-notice">We use cookies, as all do. <button>OK</button></div><div class=release><h1>New pump announced</h1><p>The maker announced a new pump today, which uses half as much power. It ships in June.</p><script>track("<p>no</p>")</script><p style="display:none">For machines only, not for you. Never to be seen.</p><p>"It took three years," says the chief engineer, "but it works, and it lasts."</p></div><div class="social"><a href=/x>Share</a></div></body>""",
    # Sections with ids that sound like something else.
    """<body><article><h1>A survey of sorting</h1><section id="introduction"><p>Sorting is old, and much has been said about it. We add a little, and sum up the rest.</p></section><section id="related-work"><h2>Related work</h2><p>Knuth wrote it all down, once, and most of it still holds. Later work is on caches, mostly.</p></section><section id="search"><h2>Search</h2><p>Once sorted, a list is searched in few steps, each of which halves it. That is, by and large, the point.</p></section></article><footer>Preprint, not reviewed.</footer></body>""",
    # Paragraphs by line breaks inside of one box.
    """<body><div class=nav><a href=/>Start</a></div><div class=post><h3>A note</h3><div>It was late, and the lamp was out, but I wrote on. There was no more to say, and I said it.</div><div>In the morning, of course, I tore it up. One should not write at night, or so I think.</div></div><div class=nav><a href=/2>Next</a></div></body>""",
    # A press page around a form, as some sites wrap all of it.
    """<body><form id=aspnet action=/p><div class=menu><a href=/>Home</a></div><div id=main><h1>Opening hours</h1><p>We are open on weekdays, from nine to five, and on Saturdays until noon.</p><p>On holidays, of which there are many, we are closed; please call, then, or write.</p></div><input type=hidden name=v value=1></form></body>""",
]
WANTED = [
    ["On gardens", "Gardens are old, and they are made by hand. So it was, and so it is.", "My own one is small, but the soil is good; I dug it twice, in spring.", "A garden, they say, is never done.", "What grows there? Beans, mostly, and a rose or two."],
    ["Town votes on bridge", "The town council voted on Monday, after a long debate, to build a new bridge. It will open in May.", '"We are glad," said the mayor, who had pushed for it. Others were not so sure.', "What it costs", "The bridge costs two million, of which the state pays half. The rest, it is hoped, comes from tolls."],
    ["Install", "First, fetch the package with the tool that you use. It takes a minute, at most.", "get package", "Then, start it. If all is well, you will see a prompt; if not, read the log.", "Linux, any kind, works.", "So does a Mac, from 2015 on."],
    ["My trip to the sea", "We left at dawn, by train, and it rained all the way down to the coast. Nobody minded, since we had tea, and a pack of cards.", "At noon the sun came out, the sea was calm, and we swam for an hour or so. It was cold, as it always is in June, but we did not care!", "Then we went home, tired, but glad."],
    ["How do I sort a list?", "I have a list, and I want it sorted by its second part. How is it done, please?", "You pass a key: a function, which takes one item and gives what is compared. It is stable, too."],
    ["Soup", "This soup is quick, and it is good on cold days. Serve it hot, with bread.", "What you need", "two onions, sliced", "salt, as you like", "Fry the onions until they are brown, then add water. Cook for an hour, and stir now and then."],
    ["New pump announced", "The maker announced a new pump today, which uses half as much power. It ships in June.", '"It took three years," says the chief engineer, "but it works, and it lasts."'],
    ["A survey of sorting", "Sorting is old, and much has been said about it. We add a little, and sum up the rest.", "Related work", "Knuth wrote it all down, once, and most of it still holds. Later work is on caches, mostly.", "Search", "Once sorted, a list is searched in few steps, each of which halves it. That is, by and large, the point."],
    ["A note", "It was late, and the lamp was out, but I wrote on. There was no more to say, and I said it.", "In the morning, of course, I tore it up. One should not write at night, or so I think."],
    ["Opening hours", "We are open on weekdays, from nine to five, and on Saturdays until noon.", "On holidays, of which there are many, we are closed; please call, then, or write."],
]


def test_realistic_pages():
    for page, want in zip(REALISTIC, WANTED, strict=True):
        assert lines(page) == want
