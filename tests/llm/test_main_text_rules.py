"""Main text against a second reader written from the contract, and pages that
need the rules of HTML to be read."""

from html.parser import HTMLParser

import pytest

from gridquarry.llm.main_text import main_text

PROSE = "The river rose in the night, and by morning the lower fields were under water. "
LONG = PROSE * 5


class Reader(HTMLParser):
    """Blocks of a page without menus, adverts and the like; for pages whose
    main text is all that stands outside them."""

    LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "script", "style"}
    EMPTY = {"br", "img", "hr", "meta", "link", "input", "wbr"}
    LINE = {"b", "i", "a", "em", "strong", "span"}
    NAMES = {"ad", "sidebar", "comments", "menu", "notice"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [[]]

    def handle_starttag(self, tag, attrs):
        names = set((dict(attrs).get("class") or "").split())
        if tag not in self.LINE and tag not in {"wbr", "img", "input"}:
            self.blocks.append([])
        if tag not in self.EMPTY:
            self.open.append((tag, tag in self.LEFT_OUT or bool(names & self.NAMES)))

    def handle_endtag(self, tag):
        if tag not in self.LINE:
            self.blocks.append([])
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not any(out for _, out in self.open):
            self.blocks[-1].append(data)


def second(page: str) -> str:
    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(x for x in (" ".join("".join(b).split()) for b in reader.blocks) if x)


def test_pages_against_a_second_reader(spark):
    # Whole table: each page has its text in one container, the rest in named or tagged parts.
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    same = [main_text(r.html) == second(r.html) for r in rows]
    assert len(same) == 250 and all(same)


PAGES = {
    "value without quotes": ("<p title=don't>" + LONG + "</p><p>" + PROSE + "</p>", LONG + PROSE),
    "slash in such a value": ("<article><p>" + LONG + "</p><p><a href=/foo/>A link</a> " + PROSE + "</p></article>", LONG + "A link " + PROSE),
    "quote in a name": ('<p x"y>' + LONG + "</p>", LONG),
    "tag with > in a value": ('<p title="a > b">' + LONG + "</p>", LONG),
    "page in a form": ("<form id=site action=/x/><div id=content><p>" + LONG + "</p><p>" + LONG + "</p></div><input type=hidden><button>Go</button></form>", LONG + LONG),
    "form beside a text": ("<div class=post><p>A short page.</p><form action=/c><p>Name</p><p>Email</p><label>Comment</label><p>Send it</p></form></div>", "A short page."),
    "form in a text": ("<article><p>" + LONG + "</p><form><p>Your name, and address</p></form><p>" + PROSE + "</p></article>", LONG + PROSE),
    "void elements in words": ("<article><p>super<wbr>cali a<img src=x>b, one<br>two. " + LONG + "</p></article>", "supercali ab, one two. " + LONG),
    "advert in a line": ("<article><p>" + LONG + "<span class=ad>cheap shoes</span> " + PROSE + "</p></article>", LONG + PROSE),
    "name of a part, but prose": ("<article><p>" + LONG + "</p><div class=search>" + LONG + "</div></article>", LONG + LONG),
    "teaser": ("<article><p>" + LONG + "</p><div class=related-posts><a href=x>Ten things you did not know</a> and more</div></article>", LONG),
    "reader comments": ("<article><p>" + LONG + "</p><div class=comments><p>" + LONG + "</p></div></article>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    page, text = PAGES[name]
    assert main_text(page) == " ".join(text.split())


def test_broken_quotes_take_linear_time():
    assert PROSE.strip() in main_text("<p>" + PROSE + "</p>" + "<p a='b c=\"d " * 20_000)
