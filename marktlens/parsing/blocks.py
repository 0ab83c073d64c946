"""Fields of pages by place: which elements stand within which others.

A place is a chain of steps parted by blanks, each a tag, a .class, an #id or an [attribute=value], several of which may be joined (`p.lead`); the
last is the element itself, the others are around it, in order, at any depth. A page is read once: open elements are a stack, and an element whose place is
asked for is found with its own text, all text within it and its attributes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without an end, and those that hold no text of the page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}


@dataclass(eq=False)
class Found:
    """An element: the name that it was asked for by, its attributes, the texts in it (its own, and all), and what was found around it."""

    name: str
    attributes: dict[str, str]
    around: tuple[Found, ...]
    own: list[str] = field(default_factory=list)
    all: list[str] = field(default_factory=list)
    inside: dict[str, list[Found]] = field(default_factory=dict)  # what was found within it, by name

    def within(self, other: Found) -> bool:
        return any(x is other for x in self.around)

    @property
    def text(self) -> str:
        return clean(" ".join(self.all))

    @property
    def first(self) -> str:
        """The first text of its own that isn't blank."""
        return next((t for t in map(clean, self.own) if t), "")


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


def _fits(step: tuple[str, ...], tag: str, attributes: dict[str, str]) -> bool:
    classes = attributes.get("class", "").split()

    def one(s: str) -> bool:
        if s[0] == "[":
            name, _, value = s[1:-1].partition("=")
            return attributes.get(name) == value
        return s[1:] in classes if s[0] == "." else s[1:] == attributes.get("id") if s[0] == "#" else s == tag

    return all(map(one, step))


class Page(HTMLParser):
    """The elements of a page that stand at the places asked for, in order; an element may be found by several names."""

    def __init__(self, html: str | None, places: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.places = [(name, [tuple(re.findall(r"\[[^\]]+\]|[.#]?[^.#\[]+", s)) for s in place.split()]) for name, place in places.items()]
        self.stack: list[tuple[str, dict[str, str], list[Found]]] = []
        self.found: list[Found] = []
        self.inside: dict[str, list[Found]] = {}
        self.feed(html or "")
        self.close()

    def _stands(self, steps: list[tuple[str, ...]]) -> bool:
        left = len(steps) - 1
        for tag, attributes, _ in reversed(self.stack):
            if left and _fits(steps[left - 1], tag, attributes):
                left -= 1
        return left == 0

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        around = tuple(f for _, _, found in self.stack for f in found)
        here = [Found(name, attributes, around) for name, steps in self.places if _fits(steps[-1], tag, attributes) and self._stands(steps)]
        self.found += here
        for f in here:
            for held in (self.inside, *(x.inside for x in around)):
                held.setdefault(f.name, []).append(f)
        if tag not in VOID:
            self.stack.append((tag, attributes, here))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:  # what was left open within it ends too
            del self.stack[at:]

    def handle_data(self, data):
        if any(tag in SILENT for tag, _, _ in self.stack):
            return
        for depth, (_, _, found) in enumerate(self.stack):
            for f in found:
                f.all.append(data)
                if depth == len(self.stack) - 1:
                    f.own.append(data)

    def named(self, name: str, within: Found | None = None) -> list[Found]:
        return list((self if within is None else within).inside.get(name, ()))

    def one(self, name: str, within: Found | None = None) -> Found | None:
        return next(iter((self if within is None else within).inside.get(name, ())), None)
