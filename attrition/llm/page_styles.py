"""What a page's own style sheets and ``style`` attributes say about whether an
element shows: ``display`` and ``visibility``, by the cascade (important over
ordinary, inline over sheets, then specificity, then the later rule).

Read are rules whose selector is one compound (``tag.class#id``, ``*``,
``[hidden]``), at the top level, in layers, in ``@supports`` (taken as met unless
negated) and in ``@media`` that applies to a screen of ``WIDTH`` × ``HEIGHT`` pixels;
a query with a feature not known here doesn't apply.  Selectors with combinators,
pseudo-classes or other attributes, and nested rules, are passed over."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The screen that pages are laid out for, in pixels.
WIDTH, HEIGHT = 1280, 720

# Media features that hold on that screen, length units in pixels.
HOLDS = frozenset(("orientation:landscape", "prefers-color-scheme:light", "prefers-reduced-motion:no-preference", "prefers-contrast:no-preference",
                   "hover:hover", "hover", "any-hover:hover", "pointer:fine", "any-pointer:fine", "scripting:enabled", "color", "update:fast"))
FAILS = frozenset(("orientation:portrait", "prefers-color-scheme:dark", "prefers-reduced-motion:reduce", "prefers-contrast:more",
                   "hover:none", "any-hover:none", "pointer:coarse", "pointer:none", "any-pointer:none", "scripting:none", "monochrome"))
UNIT = {"px": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "in": 96.0, "": 1.0}

_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|<!--|-->", re.S)
_PIECE = re.compile(r"([^{};]*)([{};]|\Z)")
_COMPOUND = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#]-?[A-Za-z_][\w-]*)*)(\[hidden\])?\Z")
_PART = re.compile(r"([.#])([\w-]+)")
_DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)[^!]*?(!\s*important)?\s*\Z", re.I)
_EDGE = re.compile(r"(min|max)-(width|height):([\d.]+)([a-z]*)\Z")
_RANGE = re.compile(r"(?:([\d.]+)([a-z]*)(<=|>=|<|>))?(width|height)(?:(<=|>=|<|>|=)([\d.]+)([a-z]*))?\Z")
_COMPARE = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}

Declared = tuple[str, str, bool]


def declarations(text: str) -> Iterator[Declared]:
    """(property, value, important) of each ``display`` and ``visibility``."""
    for part in text.split(";"):
        m = _DECLARED.match(part)
        if m:
            yield m[1].lower(), m[2].lower(), bool(m[3])


def _number(digits: str, unit: str) -> float | None:
    return float(digits) * UNIT[unit] if unit in UNIT and digits.count(".") < 2 and digits != "." else None


def _feature(text: str) -> bool | None:
    """Whether a media feature holds; None: not known."""
    text = re.sub(r"\s+", "", text)
    if text in HOLDS or text in FAILS:
        return text in HOLDS
    size = {"width": float(WIDTH), "height": float(HEIGHT)}
    if m := _EDGE.match(text):
        limit = _number(m[3], m[4])
        return None if limit is None else size[m[2]] >= limit if m[1] == "min" else size[m[2]] <= limit
    if (m := _RANGE.match(text)) and (m[3] or m[5]):
        sides = [(_number(m[1], m[2]), m[3], size[m[4]])] if m[3] else []
        sides += [(size[m[4]], m[5], _number(m[6], m[7]))] if m[5] else []
        if any(a is None or b is None for a, _, b in sides):
            return None
        return all(_COMPARE[op](a, b) for a, op, b in sides)
    return None


def media_applies(query: str) -> bool:
    """Whether a media query list applies to the screen."""
    def one(text: str) -> bool:
        m = re.match(r"(not|only)\b\s*(.*)\Z", text, re.S)
        negated, text = bool(m and m[1] == "not"), m[2] if m else text
        held = True
        for part in re.split(r"(?<![\w-])and(?![\w-])", text):
            part = part.strip()
            value = _feature(part[1:-1]) if part[:1] == "(" and part[-1:] == ")" else part in ("screen", "all")
            if value is None:
                return False
            held = held and value
        return held != negated

    query = query.strip().lower()
    return not query or any(one(q.strip()) for q in query.split(","))


def _inner(prelude: str, selectors: list[str], applies: bool) -> tuple[list[str], bool]:
    """The selectors, and whether they apply, inside a block."""
    if prelude[:1] != "@":
        return ([], False) if selectors else ([s.strip() for s in prelude.split(",")], applies)
    m = re.match(r"@([\w-]+)\s*(.*)\Z", prelude, re.S)
    kind, rest = (m[1].lower(), m[2]) if m else ("", "")
    if kind == "media":
        return selectors, applies and media_applies(rest)
    if kind == "supports":
        return selectors, applies and not re.match(r"not\b", rest, re.I)
    return (selectors, applies) if kind == "layer" else ([], False)


class Styles:
    """The rules of all sheets of a page; ``of`` gives an element's values."""

    def __init__(self) -> None:
        # by id, class, tag or "*" of the compound: (tag, parts, [hidden], specificity, order, declarations)
        self.rules: dict[str, list[tuple]] = {}
        self.order = 0

    def add_sheet(self, css: str, media: str = "") -> None:
        if not media_applies(media):
            return
        css = _NOISE.sub(" ", css)
        stack: list[tuple[list[str], bool]] = [([], True)]
        held = [""]
        for m in _PIECE.finditer(css):
            text, mark = m[1], m[2]
            if mark == "{":
                stack.append(_inner(text.strip(), *stack[-1]))
                held.append("")
                continue
            held[-1] += text + ";"
            if mark == "}" and len(stack) > 1:
                self._add(*stack.pop(), held.pop())
        while len(stack) > 1:
            self._add(*stack.pop(), held.pop())

    def _add(self, selectors: list[str], applies: bool, text: str) -> None:
        found = list(declarations(text)) if selectors and applies else []
        if not found:
            return
        self.order += 1
        for selector in selectors:
            m = _COMPOUND.match(selector)
            if not m or not selector:
                continue
            tag, parts = (m[1] or "*").lower(), _PART.findall(m[2])
            names = frozenset(a + b for a, b in parts)
            rank = (0, sum(a == "#" for a, _ in parts), sum(a == "." for a, _ in parts) + bool(m[3]), int(tag != "*"))
            place = next((a + b for a, b in parts if a == "#"), None) or next(iter(sorted(names)), None) or tag
            self.rules.setdefault(place, []).append((tag, names, bool(m[3]), rank, self.order, found))

    def of(self, name: str, attrs: dict[str, str]) -> dict[str, str]:
        """``display`` and ``visibility`` of an element, where they are declared."""
        best: dict[str, tuple] = {}
        own = {"." + c for c in attrs.get("class", "").split()} | ({"#" + attrs["id"]} if attrs.get("id") else set())
        if self.rules:
            for place in (*own, name, "*"):
                for tag, names, hidden, rank, order, found in self.rules.get(place, ()):
                    if tag in ("*", name) and names <= own and (not hidden or "hidden" in attrs):
                        for prop, value, important in found:
                            best[prop] = max(best.get(prop, ((),)), ((important, rank, order), value))
        if "style" in attrs:
            for n, (prop, value, important) in enumerate(declarations(_NOISE.sub(" ", attrs["style"]))):
                best[prop] = max(best.get(prop, ((),)), ((important, (1,), n), value))
        return {prop: value for prop, (_, value) in best.items()}
