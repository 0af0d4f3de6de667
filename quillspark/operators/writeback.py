"""Edits of source files by line, for headings and paragraphs.

Edits are planned by a query; what reaches the driver is one row per edited block.
Each file is read, patched from its end to its start and written; edits of several
files are not one transaction.
"""

from __future__ import annotations


class WriteBackError(ValueError):
    pass


def source_text(block_type: str, content: str, depth: int | None) -> str:
    """The Markdown of a heading or paragraph."""
    if block_type == "heading":
        return "#" * max(depth or 1, 1) + " " + content
    if block_type == "paragraph":
        return content
    raise WriteBackError(f"write-back is for heading/paragraph blocks, not {block_type}")


def _lines(text: str) -> tuple[list[str], str]:
    tail = "\n" if text.endswith("\n") else ""
    return (text[:-1] if tail else text).split("\n") if text else [], tail


def replace_or_delete(text: str, edits: list[tuple[int, int, str | None]]) -> str:
    """``edits``: first and last line (from 1) and the new text, or None to delete.

    A deleted block takes one blank line with it: the one after, else the one before.
    """
    lines, tail = _lines(text)
    for first, last, new in sorted(edits, key=lambda e: -e[0]):
        a, b = first - 1, min(last, len(lines))
        if a >= b:
            continue
        if new is not None:
            lines[a:b] = [new]
            continue
        if b < len(lines) and not lines[b].strip():
            b += 1
        elif a > 0 and not lines[a - 1].strip():
            a -= 1
        del lines[a:b]
    return "\n".join(lines) + tail


def insert(text: str, additions: list[tuple[int | None, str]]) -> str:
    """``additions``: the line (from 1) after which to insert, None for the end, and the new text.

    New blocks are set off by blank lines; several at one place keep their order.
    """
    lines, tail = _lines(text)
    placed = [(len(lines) if at is None else min(at, len(lines)), i, new) for i, (at, new) in enumerate(additions)]
    for at, _, new in sorted(placed, key=lambda p: (-p[0], -p[1])):
        before = [""] if at > 0 and lines[at - 1].strip() else []
        after = [""] if at < len(lines) and lines[at].strip() else []
        lines[at:at] = [*before, new, *after]
    return "\n".join(lines) + tail
