"""Cutting texts: overlapping chunks and paragraph fragments (W8, W9), free of Spark sessions for the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def chunks(size: int = 38_000, overlap: int = 2_500) -> Callable[[str], Iterator[tuple]]:
    """start and text of chunks of at most `size` characters, cut at spaces, each beginning `overlap` before the last one's end."""

    def cut(text: str) -> Iterator[tuple]:
        start = 0
        while True:
            end = min(len(text), start + size)
            if end < len(text):
                space = text.rfind(" ", start + overlap + 1, end)
                end = space if space > start + overlap else end
            yield start, text[start:end]
            if end >= len(text):
                return
            start = end - overlap

    return cut


CHUNK_FIELDS = "start int, chunk string"


def fragments(target: int = 450, heading: int = 60, least: int = 120) -> Callable[[str], Iterator[tuple]]:
    """Paragraphs packed into fragments of about `target` characters; a short line is a heading and opens a new one once
    the fragment so far has `least` characters (W9)."""

    def pack(text: str) -> Iterator[tuple]:
        now = ""
        for line in (x.strip() for x in text.split("\n")):
            if not line:
                continue
            opens = len(line) < heading and len(now) > least
            if now and (opens or len(now) + 1 + len(line) > target):
                yield (now,)
                now = ""
            now = f"{now}\n{line}" if now else line
        if now:
            yield (now,)

    return pack


FRAGMENT_FIELDS = "fragment string"
