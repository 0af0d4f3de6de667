"""Text renderings of a result, made on the driver for people to read.

For data use ``DataFrame.write``; these take what a terminal or a page shows.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

WIDTH = 60


def cell(v) -> str:
    """A value as text: whole floats without fraction, NULL for null."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v):
        return str(int(v))
    return str(v)


def fetch(df: DataFrame) -> tuple[list[str], list[list]]:
    return df.columns, [list(r) for r in df.collect()]


def to_table(columns: list[str], rows: list[list]) -> str:
    if not columns:
        return "(no columns)\n"
    if not rows:
        return "(0 rows)\n"
    texts = [[cell(v).replace("\r", "").replace("\n", " ") for v in r] for r in rows]
    texts = [[t if len(t) <= WIDTH else t[: WIDTH - 1] + "…" for t in r] for r in texts]
    wide = [max(len(c), *(len(r[i]) for r in texts)) for i, c in enumerate(columns)]
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in wide) + c
    line = lambda r: "│" + "│".join(f" {t:<{w}} " for t, w in zip(r, wide)) + "│"
    return "\n".join([rule("┌", "┬", "┐"), line(columns), rule("├", "┼", "┤"), *map(line, texts), rule("└", "┴", "┘"), f"({len(rows)} row{'s' * (len(rows) != 1)})"]) + "\n"


def to_json(columns: list[str], rows: list[list]) -> str:
    return json.dumps([dict(zip(columns, r)) for r in rows], ensure_ascii=False, default=str)


def to_csv(columns: list[str], rows: list[list]) -> str:
    def quote(s: str) -> str:
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s

    return "".join(",".join(quote(cell(v) if v is not None else "") for v in r) + "\n" for r in [columns, *rows])


def to_tsv(columns: list[str], rows: list[list]) -> str:
    return "".join("\t".join(cell(v) for v in r) + "\n" for r in [columns, *rows])


def to_markdown(columns: list[str], rows: list[list]) -> str:
    line = lambda r: "| " + " | ".join(cell(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n"
    return line(columns) + line(["---"] * len(columns)).replace("\\|", "|") + "".join(map(line, rows))


def to_html(columns: list[str], rows: list[list]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>\n"


RENDERERS = {"table": to_table, "json": to_json, "csv": to_csv, "tsv": to_tsv, "markdown": to_markdown, "html": to_html}


def render(df: DataFrame, form: str = "table") -> str:
    return RENDERERS[form](*fetch(df))


def blocks_to_html(rows: list) -> str:
    """Selected blocks (block_type, content, depth, lang) as a page fragment."""
    out, in_list = [], False
    for r in rows:
        text = html.escape(r["content"])
        if in_list and r["block_type"] != "list":
            out.append("</ul>")
            in_list = False
        if r["block_type"] == "list":
            if not in_list:
                out.append("<ul>")
                in_list = True
            out.append(f"<li>{text}</li>")
        elif r["block_type"] == "heading":
            out.append(f"<h{r['depth']}>{text}</h{r['depth']}>")
        elif r["block_type"] == "code":
            out.append(f'<pre><code class="language-{html.escape(r["lang"])}">{text}</code></pre>')
        elif r["block_type"] == "blockquote":
            out.append(f"<blockquote>{text}</blockquote>")
        elif r["block_type"] == "horizontal_rule":
            out.append("<hr>")
        elif r["block_type"] == "html":
            out.append(r["content"])
        else:
            out.append(f"<p>{text}</p>")
    return "\n".join(out + ["</ul>"] * in_list)
