"""Page parsing by the rules of HTML, its cost, and the ratios against a plain version over the standard library's parser."""

import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from ledgerflow.llm import tag_paths

LONG = "Some text of the page, which is long enough. It has marks, too."


@pytest.mark.parametrize("attributes, want", [
    ("title=it's", True), ('title=5"', True), ("title=a'b>c", False), ("it's", True), ("title='a>b'", True), ('title="a>b"', True), ("title = 'x'", True),
    ("a=b=c'", True), ("title='hidden class=ad'", True), ("data-id=ad data-class='menu'", True), ("class=ad", None), ("hidden", None), ("CLASS='ad' ", None),
    ("title='unclosed", None),
])
def test_attributes(attributes, want):
    """True: just the text; False: with what follows the first ``>``; None: nothing of the element."""
    first = "First. " * 20 + "Of all, and the longest."
    got = tag_paths.main_text(f"<article><div>{first}</div><p {attributes}>{LONG}</p></article>")
    assert got == first + ("" if want is None else f"\n{LONG}" if want else f"\nc>{LONG}")


@pytest.mark.parametrize("unit", ["<div>text ", "<div class=ad>text ", "<b>text ", "</x>a <i>", "<p><button><div>t ", "<ul><li>x ", "<p a='", "<p " + "a " * 50, "<table><tr><td>x ", "<a=", "<p a   "])
def test_cost_grows_with_the_length_only(unit):
    def seconds(n):
        page, best = unit * n, 1e9
        for _ in range(3):
            t = time.perf_counter()
            tag_paths.main_text(page)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(16_000) < 10 * seconds(4_000) + 0.05  # linear: 4 times; quadratic: 16


class Plain(HTMLParser):
    """(path, in an article, text, linked characters) of the blocks of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.run = [], [], []
        self.feed(page)

    def end(self):
        text = " ".join("".join(x for x, _ in self.run).split())
        if text:
            path = [t for t in self.stack if t not in ("a", "b")]
            self.blocks.append(("/".join(path), "article" in path, text, min(len(text), sum(len(x.strip()) for x, a in self.run if a))))
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.end()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.end()
        self.stack.pop()

    def handle_data(self, data):
        self.run.append((data, "a" in self.stack))


def plain_text(page):
    blocks = Plain(page).blocks
    by_path = defaultdict(list)
    for path, *rest in blocks:
        by_path[path].append(rest)
    ratio = {}
    for path, own in by_path.items():
        length = sum(len(t) for _, t, _ in own) / len(own)
        marks = sum(len(re.findall("[.,;:!?]", t)) for _, t, _ in own) / len(own)
        ratio[path] = length / (length + 60) * (0.5 + 0.5 * marks / (marks + 1))
    smooth = defaultdict(list)
    for i, (path, *_) in enumerate(blocks):
        near = [(2, path), *[(1, blocks[k][0]) for k in (i - 1, i + 1) if 0 <= k < len(blocks)]]
        smooth[path].append(sum(w * ratio[x] for w, x in near) / sum(w for w, _ in near))
    score = {}
    for path, own in by_path.items():
        linked = sum(n for *_, n in own) / sum(len(t) for _, t, _ in own)
        score[path] = sum(smooth[path]) / len(own) * (1 if path.endswith(("h1", "h2")) else 1 - linked)
    top = max(score.values(), default=1) or 1
    prior = 0.45 * sum(len(t) for _, inside, t, _ in blocks if inside) / max(1, sum(len(t) for _, _, t, _ in blocks))
    return "\n".join(t for path, inside, t, _ in blocks if score[path] / top + (prior if inside else -prior) >= 0.5)


def test_ratios_against_a_plain_version():
    rng = random.Random(8)

    def words():
        return "".join(rng.choice(["wind ", "water. ", "a ", "stone, ", "the long way "]) for _ in range(rng.choice([1, 3, 12, 40])))

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            text = rng.choice([words(), f"{words()}<b>{words()}</b>{words()}", f"<a href='x'>{words()}</a>", f"{words()}<a>{words()}</a>"])
            return "<{0}>{1}</{0}>".format(rng.choice(["p", "h2", "p", "li"]), text)
        return "<{0}>{1}</{0}>".format(rng.choice(["div", "section", "article", "ul"]), "".join(part(depth - 1) for _ in range(rng.randrange(1, 5))))

    some = 0
    for _ in range(400):
        page = "<html><body>" + "".join(part(3) for _ in range(rng.randrange(1, 5))) + "</body></html>"
        want = plain_text(page)
        assert tag_paths.main_text(page) == want
        some += 0 < len(want) < len("\n".join(b[2] for b in Plain(page).blocks))
    assert some > 100
