"""HTML main-text extraction as a maximum-scoring subsequence.

A page is a sequence of words and tags. Each word scores the log-odds that words of its
kind stand in main text, each tag a negative weight; one linear scan finds the contiguous
run with the largest total. A word's kind is that of its block: how much of it is link text,
how long it is, whether it ends as a sentence does, its block element, the class,
id and role words around it, and whether it lies in an article or main element. Blocks of
boilerplate score nothing, so they don't part the text around them, and are cut from the run.

Weights are learned from labelled pages: those with one article or main element, which
labels its words as main text but for elements that say they are none (nav, aside, form ...).
They are counted over at most `most_pages` pages (those with the smallest hash of page_id), a
documented bound, on top of the prior counts below. Every page is extracted whole.

An article or main element decides while it holds at least half of the page's likely text.
Otherwise (no such element, or only a teaser) words are scored by the other kinds alone.

Null and empty html give an empty text; so does a page without a positive run. Broken markup
(unclosed tags and quotes, stray end tags, comments or scripts that never end) is read as
browsers do where it matters here; every step moves on, so time is linear in the page. Null
urls pass; repeated rows give repeated results; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words of class, id and role attributes.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())
BOILER = frozenset(
    "nav aside footer form head noscript template button select dialog menu svg math object audio video canvas script style title textarea iframe noframes xmp".split()
)
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist respond disqus replies cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended widget toolbar skip login search pagination pager copyright".split()
)
ROLES = frozenset(
    "navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split()
)
CONTENT = frozenset(("article", "main"))
#: A class word after one of these tells what stands beside the element, not what it is.
BESIDE = frozenset("has with no without".split())
#: Kinds of headers, which are no boilerplate inside main text.
HEADERS = frozenset(("header",))
#: What a start tag of the key ends, if it is the innermost open block.
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
    "option": ("option",),
}

#: Words of each kind in main text and elsewhere, and tags, before any page is counted.
PRIOR = {
    "word": (700, 300), "tag": (60, 240), "link most": (10, 120), "link some": (60, 40), "link none": (630, 140),
    "short": (40, 120), "middle": (160, 110), "long": (500, 70), "sentence": (600, 90), "loose": (100, 210), "marked": (1, 150), "plain": (699, 150),
    "heading": (70, 15), "paragraph": (560, 80), "item": (30, 120), "other": (40, 85),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(
    r"(?:^|(?<=[\s\"'/]))(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|\Z))",
    re.I,
)
_PIECE = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_END = (".", "!", "?", "\u2026", ":", ";", "\u3002", '."', ".)", "!)", "?)")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    tags: int  # before it, since the last block
    boiler: bool
    content: bool  # in an article or main element
    element: str  # its innermost block element


def tokens(page: str):
    """(kind, name, attributes or text) of a page in order: kind "text", "open" or "close". Linear: each step starts where the last one ended."""
    at, n, closing = 0, len(page), {}
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        after = page[start + 1 : start + 2]
        slash = after == "/"
        name = _NAME.match(page, start + 1 + slash)
        if name is None and after not in ("!", "?", "/"):
            yield "text", "", page[at : start + 1]  # a lone sign
            at = start + 1
            continue
        if start > at:
            yield "text", "", page[at:start]
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            continue
        here = name.end()
        while True:
            stop = _STOP.search(page, here)
            if stop is None:
                return  # a tag that never ends takes the rest, as in browsers
            sign, here = stop[0], stop.end()
            if sign == ">":
                break
            if page[name.end() : stop.start()].rstrip()[-1:] != "=" and page[stop.start() - 1] != "=":
                continue  # a quote that opens no value
            if here >= closing.get(sign, n + 1):
                continue  # known to be the last of its kind
            end = page.find(sign, here)
            if end < 0:
                closing[sign] = here
                continue
            here = end + 1
        low = name[0].lower()
        yield ("close" if slash else "open"), low, page[name.end() : here - 1]
        at = here
        if low in RAW and not slash:
            end = _RAW_END[low].search(page, at)
            if end is None:
                return
            at = end.end()


def _is_boiler(tag: str, attributes: str, in_content: bool, weights: dict[str, float]) -> bool:
    """Whether an element says by its name, role, class or id that it isn't main text."""
    if tag in BOILER or (tag == "header" and not in_content):
        return True
    if tag in CONTENT or tag in ("html", "body") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                if _marked(word, in_content) and weights.get("class " + word, -1.0) < 0:
                    return True
    return False


def _marked(word: str, in_content: bool) -> bool:
    pieces = _PIECE.findall(word)
    for k, piece in enumerate(pieces):
        if piece in BESIDE:
            return False
        if piece in MARKS and not (in_content and piece in HEADERS):
            return True
    return False


def blocks(page: str, weights: dict[str, float]) -> tuple[list[Block], dict[str, list[int]]]:
    """The blocks of a page in order; for each class word, the words under it in and outside of article and main elements."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int, tuple]] = []  # name, boilerplate, content, link, place of the innermost block, class words
    opened: dict[str, int] = {}
    seen: dict[str, list[int]] = {}
    tags = links = 0

    def close() -> None:
        nonlocal tags, links
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, boiler, content, _, _, classes = stack[-1] if stack else ("", False, False, False, -1, ())
            words = text.count(" ") + 1
            element = stack[stack[-1][4]][0] if stack and stack[-1][4] >= 0 else ""
            out.append(Block(text, words, min(links, words), tags, boiler, content, element))
            for c in classes:
                seen.setdefault(c, [0, 0])[0 if content else 1] += words
            tags = 0
        links = 0

    def pop(to: int) -> None:
        for entry in stack[to:]:
            opened[entry[0]] -= 1
        del stack[to:]

    for kind, tag, rest in tokens(page):
        if kind == "text":
            parts.append(rest)
            if stack and stack[-1][3]:
                links += len(_html.unescape(rest).split())
            continue
        tags += 1
        if tag == "br":
            parts.append(" ")
            continue
        if kind == "close":
            if opened.get(tag):
                i = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                under = stack[i - 1] if i else ("", False, False, False, -1, ())
                if stack[-1][4] >= i or stack[-1][1:3] != under[1:3]:
                    close()
                pop(i)
            elif tag in BLOCK:
                close()
            continue
        if tag in RAW:
            continue
        if tag in BLOCK:
            close()
            if stack and stack[-1][4] >= 0 and stack[stack[-1][4]][0] == "p":  # a block ends an open paragraph
                pop(stack[-1][4])
            while tag in ENDS and stack and stack[-1][4] >= 0 and stack[stack[-1][4]][0] in ENDS[tag]:
                pop(stack[-1][4])
        _, boiler, content, link, inner, classes = stack[-1] if stack else ("", False, False, False, -1, ())
        mine = boiler or _is_boiler(tag, rest, content, weights)
        if mine != boiler:
            close()
        if tag not in VOID and not rest.endswith("/"):
            found = [
                w for a, v in _ATTRIBUTE.findall(rest) if a.lower() == "class" for w in v.strip("\"'").lower().split()
            ] if "class" in rest.lower() else []
            stack.append(
                (
                    tag,
                    mine,
                    content or tag in CONTENT,
                    link or tag == "a",
                    len(stack) if tag in BLOCK else inner,
                    tuple(found) or classes,
                )
            )
            opened[tag] = opened.get(tag, 0) + 1
    close()
    return out, seen


#: Kinds of the innermost block element.
ELEMENT = {
    **{f"h{k}": "heading" for k in range(1, 7)},
    **dict.fromkeys(("p", "pre", "blockquote", "figcaption"), "paragraph"),
    **dict.fromkeys(("li", "td", "th", "dt", "dd", "option"), "item"),
}


def _kinds(b: Block) -> tuple[str, ...]:
    return (
        ELEMENT.get(b.element, "other"),
        "link most" if 2 * b.link_words > b.words else "link some" if b.link_words else "link none",
        "short" if b.words < 5 else "middle" if b.words < 15 else "long",
        "sentence" if b.text.endswith(_END) else "loose",
        "marked" if b.boiler else "plain",
    )


def _value(b: Block, weights: dict[str, float]) -> float:
    """Score of each word of a block by the kinds of its text."""
    return max(-3.0, min(3.0, weights["word"] + sum(weights[k] for k in _kinds(b))))


def log_odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log-odds of each kind, of words in main text against words elsewhere."""
    inside, outside = counts["word"]
    out = {
        k: math.log(((a + 1) / (inside + 1)) / ((b + 1) / (outside + 1))) for k, (a, b) in counts.items() if k != "word"
    }
    out["word"] = math.log((inside + 1) / (outside + 1))
    for k in (
        "link most",
        "link some",
        "link none",
        "short",
        "middle",
        "long",
        "sentence",
        "loose",
        "marked",
        "plain",
        "heading",
        "paragraph",
        "item",
        "other",
    ):
        out[k] = max(-2.0, min(2.0, out[k]))
    out["word"], out["tag"] = max(-0.5, min(1.0, out["word"])), max(-1.0, min(-0.1, out["tag"]))
    return out


DEFAULT = log_odds(PRIOR)
#: What each word of a deciding article or main element adds, and each other word loses; its tags cost nothing.
MARGIN = 4.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest total, the longest one where zeros border it; (0, 0) if no total is positive."""
    best, run, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0 or (total == 0 and run == (0, 0)):
            total, start = 0.0, i
        total += x
        if total > best or (total == best and best > 0 and run[0] == start):
            best, run = total, (start, i + 1)
    return run


def scored(found: list[Block], weights: dict[str, float]) -> list[float]:
    """The words and the tags before them of each block as one number; the scan over blocks equals the one over tokens, as words of a block score alike."""
    likely = [0 if b.boiler else b.words if _value(b, weights) > 0 or b.content else 0 for b in found]
    decides = 2 * sum(x for x, b in zip(likely, found, strict=True) if b.content) >= sum(likely) > 0
    out = []
    for b in found:
        if b.boiler:
            out.append(0.0)
        elif decides:
            out.append(b.words * (MARGIN if b.content else -MARGIN))
        else:
            out.append(b.words * _value(b, weights) + weights["tag"] * b.tags)
    return out


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of a page: the best run, without boilerplate, blocks joined by blank lines."""
    weights = weights or DEFAULT
    found, _ = blocks(page or "", weights)
    scores = scored(found, weights)
    start, end = best_run(scores)
    # blocks that a run takes along only because of what lies beyond stay out, unless an article decides
    return "\n\n".join(
        b.text for b, x in zip(found[start:end], scores[start:end], strict=True) if not b.boiler and (
            x > 0 or b.link_words * 2 <= b.words and x > -MARGIN * b.words
        )
    )


def learn_weights(pages: DataFrame, most_pages: int = 1000) -> dict[str, float]:
    """Log-odds from pages with exactly one article or main element, on top of the prior counts."""
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(
        F.xxhash64("page_id"), "page_id"
    ).limit(most_pages)

    def count(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}

            def add(kind, inside, n):
                seen.setdefault(kind, [0, 0])[0 if inside else 1] += n

            for page in b.column("html").to_pylist():
                if page is None or len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
                    continue
                found, classes = blocks(page, DEFAULT)
                for x in found:
                    inside = x.content and not x.boiler
                    add("word", inside, x.words)
                    add("tag", inside, x.tags)
                    for kind in _kinds(x):
                        add(kind, inside, x.words)
                for word, (inside, outside) in classes.items():
                    add("class " + word, True, inside)
                    add("class " + word, False, outside)
            yield pa.RecordBatch.from_pydict(
                {"kind": list(seen), "a": [v[0] for v in seen.values()], "b": [v[1] for v in seen.values()]},
                schema=pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]),
            )

    rows = pages.join(F.broadcast(ids), "page_id").select(F.col("html").cast("string").alias("html"))
    got = rows.mapInArrow(count, "kind string, a long, b long").groupBy("kind").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    # class words only matter where they are marks; others never reach the driver
    marks = [r for r in got.where("kind not like 'class %' or a + b >= 20").limit(10_000).collect()]
    counts = dict(PRIOR)
    for r in marks:
        base = counts.get(r["kind"], (0, 30))
        counts[r["kind"]] = (base[0] + r["a"], base[1] + r["b"])
    return log_odds(counts)


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars."""
    typed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    weights = weights or learn_weights(typed)

    def work(batches):
        for b in batches:
            texts = [extract(p.as_py(), weights) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    b.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return typed.mapInArrow(work, "page_id long, url string, text string, n_chars long")
