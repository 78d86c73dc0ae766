"""Literals that every match of a pattern holds, so that patterns can be looked up like terms.

A cover is a list of strings, one of which at least is in every text that the pattern matches. Some
patterns have none (``.*``, ``[ab]+``); they have to be searched.
"""

from __future__ import annotations

import re

#: Regular expressions that use more than this are searched: groups with other options, names,
#: look-around, quoting, comments.
_SPECIAL_GROUP = re.compile(r"\(\?(?!:)")
_QUANTIFIER = re.compile(r"[*+?]|\{(\d+)(?:,\d*)?\}")
_SPACE = " \t\n\x0b\x0c\r"

Cover = list[str] | None


def _better(a: Cover, b: Cover) -> Cover:
    """The cover whose shortest literal is longer; of equals the one with fewer literals."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda cover: (min(map(len, cover)), -len(cover)))


def like_cover(pattern: str) -> Cover:
    """The longest piece between wildcards."""
    pieces, piece, at = [], "", 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\" and at + 1 < len(pattern):
            at += 1
            piece += pattern[at]
        elif sign in "%_":
            pieces.append(piece)
            piece = ""
        else:
            piece += sign
        at += 1
    longest = max([*pieces, piece], key=len)
    return [longest] if longest else None


class _Reader:
    """Reads alternatives of sequences of parts, each with its cover."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def alternatives(self) -> Cover:
        covers = [self.sequence()]
        while self.at < len(self.pattern) and self.pattern[self.at] == "|":
            self.at += 1
            covers.append(self.sequence())
        if any(cover is None for cover in covers):
            return None
        return sorted({literal for cover in covers for literal in cover})

    def sequence(self) -> Cover:
        best: Cover = None
        literal = ""

        def closed() -> None:
            nonlocal best, literal
            best, literal = _better(best, [literal] if literal else None), ""

        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            sign, cover = self.part()
            least = self.quantifier()
            if sign is not None and least is None:
                literal += sign
                continue
            # A repeated sign is there once more often than not at all, but not only once.
            if sign is not None and least:
                literal += sign
            closed()
            if sign is None and (least is None or least):
                best = _better(best, cover)
        closed()
        return best

    def part(self) -> tuple[str | None, Cover]:
        """A sign that stands for itself, in lower case, or the cover of something else."""
        sign = self.pattern[self.at]
        self.at += 1
        if sign == "(":
            if self.pattern.startswith("?:", self.at):
                self.at += 2
            cover = self.alternatives()
            if not self.pattern.startswith(")", self.at):
                raise ValueError("group without an end")
            self.at += 1
            return None, cover
        if sign == "[":
            self.skip_class()
            return None, None
        if sign == "\\":
            escaped = self.pattern[self.at : self.at + 1]
            self.at += 1
            if not escaped or escaped.isalnum():
                if escaped not in ("d", "D", "s", "S", "w", "W", "b", "B"):
                    raise ValueError("another escape")
                return None, None
            return self.plain(escaped)
        if sign in ".^$":
            return None, None
        return self.plain(sign)

    @staticmethod
    def plain(sign: str) -> tuple[str | None, Cover]:
        # Case is ignored for plain letters only, so other signs end a literal.
        return (sign.lower(), None) if sign.isascii() else (None, None)

    def skip_class(self) -> None:
        at = self.at + (self.pattern[self.at : self.at + 1] == "^")
        if self.pattern[at : at + 1] == "]":
            raise ValueError("class that begins with its end")
        while self.pattern[at : at + 1] != "]":
            if self.pattern[at : at + 1] in ("", "[") or self.pattern.startswith("&&", at):
                raise ValueError("nested class")
            at += 2 if self.pattern[at] == "\\" else 1
        self.at = at + 1

    def quantifier(self) -> int | None:
        """The least number of repeats, None without a quantifier."""
        found = _QUANTIFIER.match(self.pattern, self.at)
        if not found:
            return None
        self.at = found.end()
        if self.pattern[self.at : self.at + 1] in ("?", "+"):
            self.at += 1
        return int(found[1]) if found[1] else int(found[0] == "+")


def regex_cover(pattern: str) -> Cover:
    """Lower-case literals without signs beyond ASCII; None where the syntax is not known here."""
    if _SPECIAL_GROUP.search(pattern):
        return None
    reader = _Reader(pattern)
    try:
        cover = reader.alternatives()
    except ValueError:
        return None
    return cover if reader.at == len(pattern) else None


def word_part(literal: str) -> str:
    """The longest part of a literal without white space."""
    return max(re.split(f"[{_SPACE}]+", literal), key=len)
