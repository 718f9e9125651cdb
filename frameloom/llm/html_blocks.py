"""Leaf text blocks of a page and the features the labeller reads: tag path, hashed words, shape."""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+", re.I)
DIGIT = re.compile(r"\d")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements by what they do to text. Anything not named here is a block.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "head", "select", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag ends these open elements, up to the container in between.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

PATH_BUCKETS, WORD_BUCKETS, SHAPES = 384, 128, 8
WIDTH = PATH_BUCKETS + WORD_BUCKETS + SHAPES


@dataclass
class Block:
    path: np.ndarray
    text: str
    linked: int


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for name, value in NAMED.findall(attributes) if attributes else ():
        name = name.lower()
        if name in ("class", "id", "role"):
            out += [f".{w.lower()}" for w in NAME.findall(CAMEL.sub(" ", value)) if len(w) > 1]
        elif name == "style":
            out += [".hidden"] * ("none" in value.lower() and "display" in value.lower())
        else:
            out.append(".hidden")
    return tuple(out)


class _Open:
    """The open elements, at any depth: where each tag is among them, and their tokens' path vector, kept as they come and go.

    Finding an element and reading the vector take no walk over the stack, so deeply nested pages take linear time.
    """

    def __init__(self):
        self.tags: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.times: dict[str, int] = {}
        self.counts = np.zeros(PATH_BUCKETS, dtype=np.float32)
        self.path: np.ndarray | None = None

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append((tag, tokens))
        for t in tokens:
            self.times[t] = self.times.get(t, 0) + 1
            if self.times[t] == 1:
                self.counts[_bucket(t, PATH_BUCKETS)] += 1
        self.path = None

    def cut(self, depth: int) -> None:
        """Close all but the outermost `depth` elements."""
        while len(self.tags) > depth:
            tag, tokens = self.tags.pop()
            self.at[tag].pop()
            for t in tokens:
                self.times[t] -= 1
                if not self.times[t]:
                    del self.times[t]
                    self.counts[_bucket(t, PATH_BUCKETS)] -= 1
            self.path = None

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, -1 without any."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def path_vector(self) -> np.ndarray:
        """Hashed tokens of the open elements: each once as such, and the innermost three once more."""
        if self.path is None:
            self.path = self.counts.copy()
            inner: tuple[str, ...] = ()
            for _, tokens in reversed(self.tags[-3:]):
                inner = tokens + inner
            for t in inner[-3:]:
                self.path[_bucket("<" + t, PATH_BUCKETS)] += 0.5
        return self.path


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order: runs of text without a block element's edge inside, character references decoded,
    white space as one space. Text of RAW elements and comments is no text; a line break is white space."""
    out: list[Block] = []
    stack = _Open()
    pieces: list[str] = []
    linked, links, at = 0, 0, 0
    page = page or ""

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(stack.path_vector(), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            pieces.append(text)
            if links:
                linked += len(text)

    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag == "head":  # it may lack its end
                end = re.compile(r"</head\s*>|<body[\s>]|<(?:article|main|nav|header|div|p|h1)[\s>]", re.I).search(page, at)
                at = (end.end() if end[0][:6].lower() == "</head" else end.start()) if end else len(page)
            elif not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag not in INLINE:
                say(" ")
        elif tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag in INLINE:
            continue
        elif tag in ("br", "img", "input", "embed"):
            say(" ")
        elif tag in VOID:
            flush()
        elif closing:
            flush()
            links = 0
            k = stack.last((tag,))
            if k >= 0:
                stack.cut(k)
        else:
            flush()
            links = 0
            ends, within = ENDS.get(tag, ("", ()))
            k = stack.last(ends.split())
            if k > stack.last(within):
                stack.cut(k)
            top = stack.tags[-1][0] if stack.tags else ""
            if top in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (top == "p" or tag[0] == "h"):
                stack.cut(len(stack.tags) - 1)
            if not attributes.endswith("/") or tag == "p":
                stack.push(tag, _tokens(tag, attributes))
    flush()
    return out


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


_words: dict[str, int] = {}


def _word_bucket(word: str) -> int:
    n = _words.get(word)
    if n is None:
        if len(_words) > 100_000:
            _words.clear()
        n = _words[word] = _bucket(word.strip(".,:;!?()"), WORD_BUCKETS)
    return n


def features(found: list[Block], start: int = 0) -> np.ndarray:
    """A row per block: path, all words hashed (counts, to length 2), and shape: length, words, links, marks, digits, place.
    start: number in its page of the first block."""
    out = np.zeros((len(found), WIDTH), dtype=np.float32)
    for k, b in enumerate(found):
        row = out[k]
        row[:PATH_BUCKETS] = b.path
        words = b.text.lower().split()
        counts = np.bincount([_word_bucket(w) for w in words], minlength=WORD_BUCKETS)
        row[PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = counts * (2 / math.sqrt(float(counts @ counts)))
        n = len(b.text)
        row[-SHAPES:] = (
            math.log1p(n) / 5, min(n, 400) / 400, b.linked / n, b.text.count(".") / (1 + len(words)), (n - len(DIGIT.sub("", b.text))) / n,
            min(start + k, 8) / 8, float(b.text[-1] in ".!?…"), float("©" in b.text),
        )
    return out
