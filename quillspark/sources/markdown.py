"""A line-based Markdown block scanner.

It reads the common subset of Markdown into flat nodes in document order; nesting
is added afterwards by the interval numbering.  One paragraph is one block; a
table gives a row block, its cells, and after the header row an alignment block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import number_intervals, with_block_ids
from ..schema import BLOCKS, NODES

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(?:\s+(.*)|$)")
_ALIGN = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:\s*(\S+)(?:\s+[\"'(](.*)[\"')])?\s*$")
_FOOTNOTE = re.compile(r"^ {0,3}\[\^([^\]]+)\]:\s*(.*)$")
_CHECK = re.compile(r"^\[([ xX])\]\s+(.*)$", re.S)


def inline_text(s: str) -> str:
    """Text without inline marks."""
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"!?\[([^\]]*)\]\[[^\]]*\]", r"\1", s)
    s = re.sub(r"(`+)(.+?)\1", r"\2", s)
    s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    s = re.sub(r"(?<![\w*])\*(?=\S)([^*]+?)(?<=\S)\*(?!\w)", r"\1", s)
    s = re.sub(r"(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)", r"\1", s)
    return re.sub(r"~~(.+?)~~", r"\1", s)


def slug(s: str) -> str:
    return "-".join("".join(c if c.isalnum() or c == " " else "-" for c in s.lower()).split())


def _scalar(s: str):
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s in ("true", "True"):
        return True
    if s in ("false", "False"):
        return False
    if s in ("", "null", "~"):
        return None
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", s):
        return float(s)
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", s[1:-1]) if x.strip()]
    return s


def front_matter(raw: str) -> dict:
    """Top-level keys of simple YAML: scalars, lists; a nested mapping stays text."""
    out: dict = {}
    key, nested = None, []

    def finish():
        if key is not None and nested:
            items = [line.strip() for line in nested if line.strip()]
            out[key] = [_scalar(i[1:]) for i in items] if all(i.startswith("-") for i in items) else "\n".join(nested)

    for line in raw.split("\n"):
        m = re.match(r"^([A-Za-z_][\w .-]*?)\s*:(?:\s+(.*))?$", line)
        if m:
            finish()
            key, nested = m[1], []
            out[key] = _scalar(re.sub(r"\s+#.*$", "", m[2] or ""))
        elif key is not None and line.strip() and not line.lstrip().startswith("#"):
            nested.append(line)
    finish()
    return out


def _cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return [inline_text(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", s)]


def scan(text: str) -> Iterator[dict]:
    """Nodes: block_type, content, depth, lang, properties (dict), start and end line (from 1)."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [line.rstrip("\r") for line in lines]
    n, i = len(lines), 0

    def node(kind, content, a, b, depth=0, lang="", **properties):
        return {"block_type": kind, "content": content, "depth": depth, "lang": lang, "properties": properties, "start": a + 1, "end": b + 1}

    if n and lines[0] in ("---", "+++"):
        end = next((j for j in range(1, n) if lines[j].rstrip() == lines[0]), None)
        if end is not None:
            raw = "\n".join(lines[1:end])
            yield node("yaml", raw, 0, end, **front_matter(raw)) if lines[0] == "---" else node("toml", raw, 0, end)
            i = end + 1

    def starts_block(j: int) -> bool:
        s = lines[j]
        return bool(not s.strip() or _ATX.match(s) or _FENCE.match(s) or _RULE.match(s) or s.lstrip().startswith(">") or _ITEM.match(s) or s.strip() == "$$" or _FOOTNOTE.match(s) or re.match(r"^ {0,3}</?[A-Za-z][\w-]*(?:\s[^>]*)?/?>\s*$", s))

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        a = i
        m = _FENCE.match(line)
        if m:
            mark, info = m[1], m[2].strip().split(None, 1)
            close = re.compile(r"^ {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}\s*$")
            i += 1
            while i < n and not close.match(lines[i]):
                i += 1
            extra = {"fence": True} | ({"lang": info[0]} if info else {}) | ({"meta": info[1]} if len(info) > 1 else {})
            b = node("code", "\n".join(lines[a + 1 : i]), a, min(i, n - 1), lang=info[0] if info else "")
            yield b | {"properties": extra}
            i += 1
            continue
        if line.startswith(("    ", "\t")):
            while i < n and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
            last = max(j for j in range(a, i) if lines[j].strip())
            yield node("code", "\n".join(re.sub(r"^(?: {4}|\t)", "", s) for s in lines[a : last + 1]), a, last, fence=False)
            continue
        m = _ATX.match(line)
        if m:
            content = inline_text((m[2] or "").strip())
            yield node("heading", content, a, a, depth=len(m[1]), slug=slug(content))
            i += 1
            continue
        if _RULE.match(line):
            yield node("horizontal_rule", "", a, a)
            i += 1
            continue
        if line.strip() == "$$" or (line.strip().startswith("$$") and line.strip().endswith("$$") and len(line.strip()) > 4):
            s = line.strip()
            if s != "$$":
                yield node("math", s[2:-2].strip(), a, a)
                i += 1
                continue
            i += 1
            while i < n and lines[i].strip() != "$$":
                i += 1
            yield node("math", "\n".join(lines[a + 1 : i]), a, min(i, n - 1))
            i += 1
            continue
        if line.lstrip().startswith(">"):
            while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or not starts_block(i)):
                i += 1
            yield node("blockquote", inline_text("\n".join(re.sub(r"^\s*>\s?", "", s) for s in lines[a:i])), a, i - 1)
            continue
        m = _ITEM.match(line)
        if m:
            indent, mark, body = len(m[1].expandtabs(4)), m[2], [m[3] or ""]
            i += 1
            while i < n and lines[i].strip() and not _ITEM.match(lines[i]) and (lines[i].startswith(" ") or not starts_block(i)):
                body.append(lines[i].strip())
                i += 1
            content, extra = "\n".join(body), {}
            c = _CHECK.match(content)
            if c:
                content, extra = c[2], {"checked": c[1] != " "}
            yield node("list", inline_text(content), a, i - 1, ordered=mark[0].isdigit(), level=indent // 2, **extra)
            continue
        m = _FOOTNOTE.match(line)
        if m:
            body = [m[2]]
            i += 1
            while i < n and lines[i].startswith(("    ", "\t")):
                body.append(lines[i].strip())
                i += 1
            yield node("footnote", inline_text("\n".join(body)), a, i - 1, ident=m[1])
            continue
        m = _DEFINITION.match(line)
        if m:
            yield node("definition", m[1], a, a, url=m[2], **({"label": m[3]} if m[3] else {}))
            i += 1
            continue
        if "|" in line and i + 1 < n and "-" in lines[i + 1] and _ALIGN.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            row = 0
            while i < n and lines[i].strip() and ("|" in lines[i] or i == a + 1):
                if i == a + 1:
                    yield node("table_align", "", i, i)
                else:
                    cells = _cells(lines[i])
                    yield node("table_row", " | ".join(cells), i, i, row=row)
                    for column, c in enumerate(cells):
                        yield node("table_cell", c, i, i, row=row, column=column)
                    row += 1
                i += 1
            continue
        if _HTML.match(line):
            while i < n and lines[i].strip():
                i += 1
            yield node("html", "\n".join(lines[a:i]), a, i - 1)
            continue
        i += 1
        while i < n and not starts_block(i) and not re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
            i += 1
        under = re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]) if i < n else None
        content = inline_text("\n".join(s.strip() for s in lines[a:i]))
        if under:
            yield node("heading", content, a, i, depth=1 if under[1][0] == "=" else 2, slug=slug(content))
            i += 1
        else:
            yield node("paragraph", content, a, i - 1)


def nodes(texts: DataFrame, spans: bool = True) -> DataFrame:
    """Nodes of (id, text) rows, in Python workers by Arrow batches."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(rows) > 10_000:
                    yield made(rows)
                    rows = []
                lines = None
                source = text.as_py() or ""
                for k, x in enumerate(scan(source), 1):
                    lines = lines or source.split("\n")
                    span = {"start_line": x["start"], "start_col": 1, "end_line": x["end"], "end_col": len(lines[x["end"] - 1].rstrip("\r")) + 1} if spans else None
                    rows.append((doc, k, x["block_type"], x["content"], x["depth"], x["lang"], json.dumps(x["properties"], sort_keys=True, ensure_ascii=False), span))
            if rows:
                yield made(rows)

    def made(rows):
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.struct([(f, pa.int32()) for f in ("start_line", "start_col", "end_line", "end_col")])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.name for f in NODES.fields])

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, NODES)


def parse_blocks(texts: DataFrame, spans: bool = True) -> DataFrame:
    """The block table of (id, text) rows."""
    numbered = with_block_ids(number_intervals(nodes(texts, spans)).drop("parent_ord", "path"))
    return numbered.select(*[f.name for f in BLOCKS.fields])


def render_node(block_type: str, content: str, depth: int = 0, lang: str = "", properties: dict | None = None) -> str:
    """A node as Markdown source."""
    p = properties or {}
    if block_type == "heading":
        return "#" * max(depth, 1) + " " + content
    if block_type == "code":
        return f"```{lang}\n{content}\n```"
    if block_type == "list":
        check = "" if "checked" not in p else ("[x] " if p["checked"] else "[ ] ")
        return "  " * p.get("level", 0) + ("1. " if p.get("ordered") else "- ") + check + content
    if block_type == "blockquote":
        return "\n".join("> " + s for s in content.split("\n"))
    return {"horizontal_rule": "---", "yaml": f"---\n{content}\n---", "toml": f"+++\n{content}\n+++", "math": f"$$\n{content}\n$$", "definition": f"[{content}]: {p.get('url', '')}", "footnote": f"[^{p.get('ident', '')}]: {content}"}.get(block_type, content)
