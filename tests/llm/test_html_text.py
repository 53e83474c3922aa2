"""The one-pass reader of tags against a slow one by characters, and pages that must keep or lose their parts."""

import random
import time

import pytest

from weftline.llm import html_text

SPACE = "\t\n\f\r "


def slow_tags(page):
    """Tags and comments by the states of the standard, a character at a time; a quoted value without an end goes to the tag's end."""
    out, i, n = [], 0, len(page)
    while i < n:
        if page[i] != "<":
            i += 1
            continue
        start = i
        rest = page[i + 1 : i + 2]
        closing = rest == "/"
        j = i + 1 + closing
        letter = j < n and page[j].isascii() and page[j].isalpha()
        if not letter:
            if page[i : i + 4] == "<!--":
                j = i + 4
                if page[j : j + 1] == ">":
                    j += 1
                elif page[j : j + 2] == "->":
                    j += 2
                else:
                    while j < n and page[j : j + 3] != "-->" and page[j : j + 4] != "--!>":
                        j += 1
                    j = min(n, j + (3 if page[j : j + 3] == "-->" else 4))
            elif rest in ("!", "?") or (closing and j < n):
                while j < n and page[j] != ">":
                    j += 1
                j = min(n, j + 1)
            else:
                i += 1
                continue
            out.append((start, j, None))
            i = j
            continue
        name, attrs, state, key, value, quote = "", {}, "name", "", "", ""

        def keep():
            if key:
                attrs.setdefault(key.lower(), value)

        while j < n:
            c = page[j]
            if state == "name":
                if c in SPACE + "/":
                    state = "before"
                elif c == ">":
                    break
                else:
                    name += c
            elif state == "before":
                if c == ">":
                    break
                if c not in SPACE + "/":
                    key, value, state = c, "", "key"
            elif state == "key":
                if c in SPACE:
                    state = "after"
                elif c == "/":
                    keep()
                    state = "before"
                elif c == ">":
                    keep()
                    break
                elif c == "=":
                    state = "value"
                else:
                    key += c
            elif state == "after":
                if c == "=":
                    state = "value"
                elif c not in SPACE:
                    keep()
                    state = "before"
                    continue
            elif state == "value":
                if c in "\"'":
                    if page.find(c, j + 1) >= 0:
                        state, quote = "quoted", c
                    else:
                        state, quote = "quoted", ">"
                elif c == ">":
                    keep()
                    break
                elif c not in SPACE:
                    value, state = c, "plain"
            elif state == "quoted":
                if c == quote:
                    keep()
                    state = "before"
                    if c == ">":
                        break
                else:
                    value += c
            elif state == "plain":
                if c in SPACE:
                    keep()
                    state = "before"
                elif c == ">":
                    keep()
                    break
                else:
                    value += c
            j += 1
        if j >= n:
            out.append((start, n, None))
            break
        out.append((start, j + 1, (closing, name.lower(), attrs)))
        i = j + 1
    return out


def test_tags_equal_a_slow_reader():
    r = random.Random(11)
    pieces = ["<", ">", "</", "<!--", "-->", "--!>", "<!", "<?", "/", "=", '"', "'", " ", "\n", "a", "B", "p", "div", "class=", 'id="x y"', "é", "-", "<a", "<p ", "='", "/>", "text"]
    for _ in range(30_000):
        page = "".join(r.choices(pieces, k=r.randint(0, 14)))
        got = [(s, e, None if name is None else (closing, name, attrs or {})) for s, e, closing, name, attrs in html_text.tags(page)]
        assert got == slow_tags(page), page


LONG = "A sentence of the article, which is long enough to count, goes here. "


@pytest.mark.parametrize(
    "page,want",
    [
        ("<!--><h1>Title</h1><p>one long text</p>", "Title\n\none long text"),
        ("<!---><p>text</p><!-- gone --!><p>more</p>", "text\n\nmore"),
        ("<p class=it's>long text</p><p>don't stop</p>", "long text\n\ndon't stop"),
        (f'<p>{LONG}</p><a href="x>link</a>', LONG.strip()),
        ('<form id="aspnetForm"><div id="content">article text</div><input value="3"><button>Send</button></form>', "article text"),
        (f'<p>{LONG}</p><form class="content"><label>Name</label><p>Write to us, please, if you like.</p></form>', LONG.strip()),
        (f'<div class="body"><p>{LONG * 3}</p></div><div class="comment-body">I disagree, this is bad, really.</div><ul class="commentlist"><li>me too, thanks a lot</li></ul><div id="user-1" class="comment-content">no</div>', (LONG * 3).strip()),
        (f'<div class="commentary"><p>{LONG}</p></div>', LONG.strip()),
        (f'<div class="post comments-open"><p>{LONG * 2}</p></div>', (LONG * 2).strip()),
        (f'<div><p class="lead">The lead of it, in a few words.</p><div class="body"><p>{LONG * 9}</p></div></div>', f"The lead of it, in a few words.\n\n{(LONG * 9).strip()}"),
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p></div></div>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f'<div><div><p>{LONG * 5}</p></div><div><a href="1">One</a> <a href="2">Two</a></div></div>', (LONG * 5).strip()),
        ("<p>1 < 2 &amp; 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<p>cut off <b", "cut off"),
        ("<!-- never ends <p>text</p>", ""),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece,end", [("<a ", '">'), ('<a b="', ""), ("<a b='x\" ", ">"), ("<!-- ", ""), ("<", ""), ("</ ", ""), ("<p class='", "'>"), ("<script>", ""), ("&", ";"), ("<form>", "x"), ("<div class=comment>", "x")])
def test_time_grows_with_the_page(piece, end):
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        html_text.main_text("<p>" + LONG + piece * n + end)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_columns_that_clash(spark):
    rows = html_text.extract_main_text(spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", 5, "t")], "page_id long, url string, html string, n_chars long, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, "u", LONG.strip(), len(LONG.strip()))]
