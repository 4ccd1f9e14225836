"""Cutting a text where no piece of a splitting model can reach across: before spaces and line feeds."""

from __future__ import annotations

import re

from .piece_model import SPACE

_SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")


def segments(text: str) -> list[str]:
    """Segments in order. A segment stands for one space and itself, or for itself if it opens with a line feed."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    spread = text.replace("\n", " \n")
    if "  " not in spread and spread[0] != " ":
        return spread.split(" ")
    return [x[1:] if x[0] == " " else x for x in _SEGMENT.findall(" " + text)]
