"""HTML as Markdown: headings, paragraphs, emphasis, links, images, code, quotes, nested lists and tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text is not shown, those that stand on lines of their own, the signs of emphasis, and elements without content.
_QUIET = frozenset("script style noscript template head title".split())
_BLOCK = frozenset("address article aside body div dl dt dd fieldset figure figcaption footer form header html main nav p section".split())
_SIGNS = {"em": "*", "i": "*", "strong": "**", "b": "**", "del": "~~", "s": "~~"}
_VOID = frozenset("area base col embed input link meta param source track wbr".split())


class _Frame:
    """An open element that shapes the lines in it."""

    def __init__(self, tag: str, first: str = "", rest: str = "", start: int = 1) -> None:
        self.tag, self.first, self.rest, self.number = tag, first, rest, start
        self.blocks: list[str] = []  # finished
        self.words: list[str] = []  # of the paragraph that is open
        self.tight = False
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.head = False
        self.language = ""


class MarkdownWriter(HTMLParser):
    """Reads HTML once, front to back, with a stack of open frames: what a frame holds becomes lines of the one around it when it ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.frames = [_Frame("page")]
        self.quiet = 0
        self.links: list[tuple[str, int]] = []
        self.pre = 0

    # Words

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        top = self.frames[-1]
        if self.pre:
            top.words.append(data)
        elif top.tag not in ("table", "tr", "ul", "ol") or data.strip():
            flat = re.sub(r"\s+", " ", data)
            top.words.append(re.sub(r"([\\`*_\[\]])", r"\\\1", flat) if not any(f.tag == "code" for f in self.frames) else flat)

    def _paragraph(self) -> None:
        """End the open paragraph of the top frame."""
        top = self.frames[-1]
        text = "".join(top.words)
        top.words = []
        if self.pre:
            return
        lines = [" ".join(x.split()) for x in text.split("\n")]
        text = "\n".join(lines).strip().replace("\n", "  \n")
        if text:
            top.blocks.append(text)

    def _push(self, frame: _Frame) -> None:
        self._paragraph()
        self.frames.append(frame)

    def _pop(self) -> _Frame:
        self._paragraph()
        return self.frames.pop()

    def _text(self, frame: _Frame) -> str:
        out = ""
        for i, b in enumerate(frame.blocks):
            out += ("\n" if frame.tight and (b.startswith(("- ", "1. ")) or re.match(r"\d+\. ", b)) else "\n\n") * (i > 0) + b
        return out

    # Elements

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in _QUIET:
            self.quiet += 1
        if self.quiet or tag in _VOID:
            return
        top = self.frames[-1]
        if tag == "br":
            top.words.append("\n")
        elif tag == "hr":
            self._paragraph()
            top.blocks.append("---")
        elif tag == "img":
            top.words.append(f"![{' '.join(given.get('alt', '').split())}]({given.get('src', '')})")
        elif tag in _SIGNS:
            top.words.append(_SIGNS[tag])
        elif tag == "code" and not self.pre:
            self.frames.append(_Frame("code"))
        elif tag == "a" and "href" in given:
            self.links.append((given["href"], len(top.words)))
        elif re.fullmatch("h[1-6]", tag):
            self._push(_Frame(tag))
        elif tag == "pre":
            self._push(_Frame("pre"))
            self.pre += 1
        elif tag == "code" and self.pre:
            top.language = next((w[9:] for w in given.get("class", "").split() if w.startswith("language-")), "")
        elif tag in ("ul", "ol"):
            start = given.get("start", "1")
            self._push(_Frame(tag, start=int(start) if re.fullmatch(r"\d{1,9}", start) else 1))
        elif tag == "li":
            if any(f.tag == "li" for f in self.frames[self._list() + 1 :]):
                self._until("li")
            self._push(_Frame("li"))
        elif tag in ("blockquote", "table"):
            self._push(_Frame(tag))
        elif tag == "tr":
            if top.tag in ("td", "tr"):
                self._until("tr")
            self._push(_Frame("tr"))
        elif tag in ("td", "th"):
            if self.frames[-1].tag == "td":
                self._until("td")
            frame = _Frame("td")
            frame.head = tag == "th"
            self._push(frame)
        elif tag in _BLOCK:
            self._paragraph()

    def _list(self) -> int:
        return max((i for i, f in enumerate(self.frames) if f.tag in ("ul", "ol", "table")), default=0)

    def _until(self, tag: str) -> None:
        """End the frames down to the innermost of that tag, if it is open within the nearest list or table."""
        if any(f.tag == tag for f in self.frames):
            while True:
                done = self.frames[-1].tag == tag
                self._close()
                if done:
                    return

    def handle_endtag(self, tag: str) -> None:
        if tag in _QUIET:
            self.quiet = max(0, self.quiet - 1)
            return
        if self.quiet or tag in _VOID or tag in ("br", "hr", "img"):
            return
        top = self.frames[-1]
        if tag in _SIGNS:
            self._emphasis(_SIGNS[tag])
        elif tag == "a":
            if self.links:
                href, at = self.links.pop()
                words = "".join(top.words[at:])
                top.words[at:] = [f"[{words.strip()}]({href})"] if words.strip() else []
        elif tag in ("pre", "blockquote", "ul", "ol", "li", "tr", "table") or re.fullmatch("h[1-6]", tag):
            self._until(tag)
        elif tag == "code":
            if not self.pre:
                self._until("code")
        elif tag in ("td", "th"):
            self._until("td")
        elif tag in _BLOCK:
            self._paragraph()

    def _emphasis(self, sign: str) -> None:
        """Close an emphasis: its sign may not stand beside blanks, and an empty one is none."""
        words = self.frames[-1].words
        at = next((i for i in range(len(words) - 1, -1, -1) if words[i] == sign), None)
        if at is None:
            return
        inner = "".join(words[at + 1 :])
        bare = inner.strip()
        words[at:] = [inner[: len(inner) - len(inner.lstrip())] + sign + bare + sign + inner[len(inner.rstrip()) :]] if bare else [inner]

    def _close(self) -> None:
        if self.frames[-1].tag == "code":
            frame = self.frames.pop()
            text = "".join(frame.words).strip()
            if text:
                mark = "`" * (1 + max((len(x) for x in re.findall("`+", text)), default=0))
                pad = " " if text.startswith("`") or text.endswith("`") else ""
                self.frames[-1].words.append(f"{mark}{pad}{text}{pad}{mark}")
            return
        if self.frames[-1].tag == "pre":
            frame = self.frames.pop()
            self.pre -= 1
            body = "".join(frame.words).strip("\n")
            mark = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))
            self.frames[-1].blocks.append(f"{mark}{frame.language}\n{body}\n{mark}")
            return
        frame = self._pop()
        out, tag = self.frames[-1], frame.tag
        text = self._text(frame)
        if tag[0] == "h" and text:
            out.blocks.append("#" * int(tag[1]) + " " + " ".join(text.split()))
        elif tag == "blockquote" and text:
            out.blocks.append("\n".join(("> " + x).rstrip() for x in text.split("\n")))
        elif tag == "li":
            numbered = next((f for f in reversed(self.frames) if f.tag in ("ul", "ol")), None)
            mark = "- "
            if numbered is not None and numbered.tag == "ol":
                mark, numbered.number = f"{numbered.number}. ", numbered.number + 1
            lines = [x if i == 0 or not x.strip() else " " * len(mark) + x for i, x in enumerate(text.split("\n"))]
            out.blocks.append(mark + "\n".join(lines) if text else mark.rstrip())
        elif tag in ("ul", "ol") and frame.blocks:
            out.blocks.append("\n".join(frame.blocks))
            if out.tag == "li":
                out.tight = True
        elif tag == "td":
            row = self.frames[-1]
            cell = " ".join(text.split()).replace("|", "¦")
            if row.tag == "tr":
                row.row = [*(row.row or []), cell]
                row.head = row.head or frame.head
            elif text:
                out.blocks.append(text)
        elif tag == "tr" and frame.row:
            table = next((f for f in reversed(self.frames) if f.tag == "table"), None)
            (table or out).rows.append(frame.row)
        elif tag == "table":
            out.blocks += frame.blocks
            if frame.rows:
                wide = max(map(len, frame.rows))
                rows = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in frame.rows]
                out.blocks.append("\n".join([rows[0], "| " + " | ".join(["---"] * wide) + " |", *rows[1:]]))
        elif text:
            out.blocks.append(text)

    def text(self) -> str:
        self.close()
        while len(self.frames) > 1:
            self._close()
        self._paragraph()
        return self._text(self.frames[0])


def convert(page: str | None) -> str | None:
    if page is None:
        return None
    writer = MarkdownWriter()
    writer.feed(page)
    return writer.text()


def from_html(page: Column) -> Column:
    """A page's HTML as Markdown, read once in the order it stands; null stays null. Emphasis is closed where its element is, lists nest by indentation and are numbered from their start, a table's first row is its head, and bars in cells become ¦."""

    @F.pandas_udf("string")
    def converted(pages: pd.Series) -> pd.Series:
        return pages.map(convert)

    return converted(page)
