from marlstone.llm import htmltext

ONE, TWO = "The first paragraph has enough words to be read as text.", "The second one is just as long and must not get lost."


def texts(page):
    return [t[-1] for t in htmltext.tags(page) if t[-1]], "".join(page[a:b] for a, b in kept(page))


def kept(page):
    at = 0
    for start, end, *_ in htmltext.tags(page):
        yield at, start
        at = end
    yield at, len(page)


def test_left_out_elements_without_an_end():
    tree = htmltext.model()
    for tag in ("<svg/>", '<svg class="i"/>', "<svg class='i' />", "<object data='x'>", "<button>", "<select>", "<video src=a/b>", "<audio/>", "<iframe src='a'/>", "<template>", "<noscript>", "<canvas>"):
        page = f"<article><p>{ONE}</p>{tag}<p>{TWO}</p></article>"
        assert ONE in htmltext.main_text(page, tree) and TWO in htmltext.main_text(page, tree), tag
        assert texts(page)[1] == ONE + TWO


def test_left_out_elements_with_an_end():
    for tag in ("svg", "object", "button", "select", "video", "iframe", "script", "style", "title", "textarea"):
        assert texts(f"<p>{ONE}</p><{tag} a='>'>gone <p>too</p></{tag.upper()} ><p>{TWO}</p>")[1] == ONE + TWO
    for tag in ("script", "style"):
        assert texts(f"<p>{ONE}</p><{tag}>gone<p>{TWO}</p>")[1] == ONE
    for tag in ("title", "textarea"):
        assert texts(f"<p>{ONE}</p><{tag}><p>{TWO}</p>")[1] == ONE + TWO
    assert texts("<p>a</p><object data=x/>gone</object><p>b</p>")[1] == "ab"
    assert texts("<p>a</p><svg/><p>b</p><svg><path/>gone</svg><p>c</p>")[1] == "abc"
    assert texts("a <!-- gone")[1] == "a "
    assert texts("<button>" * 20000 + "end")[1] == "end"


def test_what_names_mislead_about_stays():
    tree = htmltext.model()
    for page in (
        f"<article><h1>A title</h1><div class='story widgets-2'><p>{ONE}</p><p>{TWO}</p></div></article>",
        f"<main><h1>A title</h1><div id='related-work'><p>{ONE}</p><p>{TWO}</p></div></main>",
        f"<main><h1>A title</h1><p>{ONE}</p><p class='footer-note'>{TWO}</p></main>",
        f"<article><p>{ONE}</p><button>Go<p>{TWO}</p><p>Third one, and it is also long enough to be read.</p></article>",
        f"<article><p>{ONE}</p><select><option>a<p>{TWO}</p><select></select></article>",
        f'<article><p>{ONE} <a href="x>link</a> and more.</p><p class="y">{TWO}</p></article>',
    ):
        got = htmltext.main_text(page, tree)
        assert ONE in got and TWO in got and "<" not in got and "href" not in got, (page, got)
    for page in (f"<article><p>{ONE}</p><div class='comments'><p>{TWO}</p></div></article>", f"<article><p>{ONE}</p><div class='ad-slot'><p>{TWO}</p></div></article>", f"<main><p>{ONE}</p></main><div class='cookie-notice'><p>{TWO}</p></div>", f"<main><p>{ONE}</p></main><div class='sidebar widget-3'><p>{TWO}</p></div>"):
        assert htmltext.main_text(page, tree) == ONE, page


def test_broken_tags_take_linear_time():
    import time

    tree = htmltext.model()
    for unit in ("<a '", '<a "', "<a \"'", "<a", "<", "<!", "<!-- ", "<a b='>", "<p x=\"", "<button>", "&amp", "<a href='x>l</a>"):
        page = f"<p>{ONE}</p>" + unit * ((1 << 20) // len(unit))
        began = time.process_time()
        got = htmltext.main_text(page, tree)
        assert time.process_time() - began < 20, unit
        assert isinstance(got, str)


def test_deep_nesting_is_linear():
    import time

    from marlstone.llm import htmltext

    tree = htmltext.model()
    began = time.time()
    for open_, close in (("<div>", "</div>"), ("<div class='a b'>", "</div>"), ("<section>", ""), ("<ul><li>", "</b></x>"), ("<div></x>", "")):
        n = 1_000_000 // len(open_ + close)
        assert isinstance(htmltext.main_text("<article>" + open_ * n + "<p>A text of some words that stands deep inside.</p>" + close * n, tree), str)
    assert time.time() - began < 30


def test_paragraphs_of_links_in_an_article_stay():
    from marlstone.llm import htmltext

    tree = htmltext.model()
    prose = "<p>The first of some paragraphs, with words enough to be told apart from all the rest of a page.</p>"
    for links in ('<p>Visit <a>one</a> <a>two</a></p>', '<p>See <a href="x>link</a> now</p>', '<p><a href="/x">All of this paragraph is a link to somewhere</a></p>'):
        got = htmltext.main_text(f"<body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>Title</h1>{prose}{links}{prose}</article><footer><p><a href=b>Terms</a></p></footer>", tree)
        assert len(got.split("\n\n")) == 4 and "Home" not in got and "Terms" not in got
    menu = f'<article><h1>T</h1>{prose}<nav><p><a href="/a">Next</a></p></nav><div class="share"><p><a href="/b">Share this</a></p></div></article>'
    assert "Next" not in htmltext.main_text(menu, tree) and "Share" not in htmltext.main_text(menu, tree)
