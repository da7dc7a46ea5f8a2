"""A tokenizer for the markup of web pages: one pass with a forward index, in linear time whatever the page.

Nothing in a page is an error. A construct that does not end is not searched for twice: that no end is to be
found beyond a place is remembered. Comments, declarations, marked sections and processing instructions are
skipped to their end, one without an end of its own to the next `>`; without any `>` it is text. A quote that
never closes does not hold its tag open beyond the next `>`.
"""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"[A-Za-z][^\t\n\r\f />\x00]*")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
#: Elements whose content is no markup; of those of the second group character references count.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_REFERENCES = frozenset("title textarea".split())


class _Finder:
    """The next place of a pattern from any place on; what was found last is kept, and that there is none."""

    def __init__(self, pattern: re.Pattern | str, text: str):
        self.find = (lambda at: text.find(pattern, at)) if isinstance(pattern, str) else (lambda at: m.start() if (m := pattern.search(text, at)) else -1)
        self.since = self.place = -2

    def __call__(self, at: int) -> int:
        if not (self.since <= at and (self.place == -1 or at <= self.place)) or self.since == -2:
            self.since, self.place = at, self.find(at)
        return self.place


class Tokenizer:
    """Calls the handlers of a subclass for each token of a page, in order."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None: ...

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None: ...

    def handle_data(self, data: str) -> None: ...

    def read(self, page: str) -> None:
        """Tokenize a whole page."""
        less, greater, special = _Finder("<", page), _Finder(">", page), _Finder(_SPECIAL, page)
        comment, raw_ends = _Finder(re.compile("--!?>"), page), {}
        ends: dict[int, int] = {}  # of a tag, by the place of a quote in it
        said: list[str] = []  # text that is not handed over yet
        at, size = 0, len(page)

        def flush() -> None:
            if said:
                self.handle_data(unescape("".join(said)))
                said.clear()

        while at < size:
            open_ = less(at)
            if open_ != at:
                said.append(page[at:] if open_ < 0 else page[at:open_])
                at = size if open_ < 0 else open_
                continue
            after = page[at + 1 : at + 2]
            name = _NAME.match(page, at + 2 if after == "/" else at + 1)
            if not name:
                if page.startswith("<!--", at):
                    end = at + 4 if page.startswith(("<!-->", "<!--->"), at) else comment(at + 4)
                    end = greater(max(end, at + 4)) if end >= 0 else greater(at)
                elif after in ("!", "?", "/") and after:
                    end = greater(at)
                else:
                    end = -1
                if end < 0:
                    said.append("<")
                    at += 1
                else:
                    at = end + 1
                continue
            end = greater(name.end()) if after == "/" else _tag_end(page, name.end(), special, ends)
            if end < 0:
                end = greater(name.end())
            if end < 0:
                said.append("<")
                at += 1
                continue
            flush()
            tag = name[0].lower()
            if after == "/":
                self.handle_endtag(tag)
                at = end + 1
                continue
            attrs, said_to = [], name.end()
            for m in _ATTRIBUTE.finditer(page, name.end(), end):
                attrs.append((m[1].lower(), unescape(_unquoted(m[2])) if m[2] else None))
                said_to = m.end()
            closed = page[end - 1] == "/" and end > said_to
            (self.handle_startendtag if closed else self.handle_starttag)(tag, attrs)
            at = end + 1
            if not closed and (tag in RAW or tag in RAW_REFERENCES):
                if tag not in raw_ends:
                    raw_ends[tag] = _Finder(re.compile(rf"(?i)</{tag}(?=[\s/>])"), page)
                stop = raw_ends[tag](at)
                if stop < 0 and tag in RAW:
                    stop = size
                if stop > at:
                    self.handle_data(page[at:stop] if tag in RAW else unescape(page[at:stop]))
                    at = stop
        flush()


def _tag_end(page: str, at: int, special: _Finder, ends: dict[int, int]) -> int:
    """The `>` that ends a tag, quoted ones left out; -1 if there is none."""
    passed = []
    while True:
        place = special(at)
        if place < 0 or page[place] == ">":
            end = place
            break
        if place in ends:
            end = ends[place]
            break
        passed.append(place)
        shut = page.find(page[place], place + 1)
        if shut < 0:
            end = -1
            break
        at = shut + 1
    for place in passed:
        ends[place] = end
    return end


def _unquoted(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1] else value
