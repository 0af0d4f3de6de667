"""The selector language's subset: node selectors, select(...), to_text.

A program is compiled to a filter and a rendering, both Columns; anything outside
the subset is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"h": "heading", "heading": "heading", "code": "code", "list": "list", "text": "paragraph", "p": "paragraph", "paragraph": "paragraph", "blockquote": "blockquote", "html": "html", "yaml": "yaml", "toml": "toml", "math": "math", "hr": "horizontal_rule", "table_cell": "table_cell", "table_row": "table_row", "definition": "definition", "footnote": "footnote"}
_FIELDS = {"depth": "depth", "lang": "lang", "code_lang": "lang", "block_type": "block_type", "content": "content", "text": "content", "type": "block_type"}
_ATOM = re.compile(r"""\s*(?:(?P<op>==|!=|<=|>=|<|>|\(|\)|and\b|or\b|not\b|null\b|true\b|false\b)|\.(?P<field>[a-z_]+)|(?P<num>-?\d+)|"(?P<str>(?:[^"\\]|\\.)*)")""")


def _condition(text: str) -> Column:
    atoms, at = [], 0
    while at < len(text.rstrip()):
        m = _ATOM.match(text, at)
        if not m:
            raise NotImplementedError(f"selector condition: {text[at:]!r}")
        atoms.append(m)
        at = m.end()
    pos = 0

    def peek():
        return atoms[pos]["op"] if pos < len(atoms) else None

    def value():
        nonlocal pos
        m = atoms[pos]
        pos += 1
        if m["field"]:
            if m["field"] not in _FIELDS:
                raise NotImplementedError(f"selector field .{m['field']}")
            return ("field", _FIELDS[m["field"]])
        if m["num"]:
            return ("lit", int(m["num"]))
        if m["str"] is not None:
            return ("lit", re.sub(r"\\(.)", r"\1", m["str"]))
        if m["op"] in ("null", "true", "false"):
            return ("lit", {"null": None, "true": True, "false": False}[m["op"]])
        raise NotImplementedError(f"selector condition: {text!r}")

    def comparison() -> Column:
        nonlocal pos
        if peek() == "not":
            pos += 1
            return ~comparison()
        if peek() == "(":
            pos += 1
            inner = either()
            pos += 1
            return inner
        left = value()
        op = peek()
        if op not in ("==", "!=", "<", ">", "<=", ">="):
            raise NotImplementedError(f"selector condition: {text!r}")
        pos += 1
        right = value()
        if ("lit", None) in (left, right):  # an absent language or depth is written '' or 0 in the table
            field = left[1] if left[0] == "field" else right[1]
            absent = F.col(field) == (0 if field == "depth" else "")
            return absent if op == "==" else ~absent
        a, b = (F.col(v) if k == "field" else F.lit(v) for k, v in (left, right))
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def both() -> Column:
        nonlocal pos
        out = comparison()
        while peek() == "and":
            pos += 1
            out = out & comparison()
        return out

    def either() -> Column:
        nonlocal pos
        out = both()
        while peek() == "or":
            pos += 1
            out = out | both()
        return out

    result = either()
    if pos != len(atoms):
        raise NotImplementedError(f"selector condition: {text!r}")
    return result


def compile_selector(program: str) -> tuple[Column, bool]:
    """(filter, whether plain text is asked for)."""
    keep, plain = F.lit(True), False
    for stage in re.split(r"\|(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", program):
        s = stage.strip()
        m = re.fullmatch(r"\.(h)([1-6])", s)
        if m:
            keep = keep & (F.col("block_type") == "heading") & (F.col("depth") == int(m[2]))
        elif re.fullmatch(r"\.[a-z_]+", s) and s[1:] in _KINDS:
            keep = keep & (F.col("block_type") == _KINDS[s[1:]])
        elif s.startswith("select(") and s.endswith(")"):
            keep = keep & _condition(s[7:-1])
        elif s in ("to_text", "to_text()"):
            plain = True
        elif s != ".":
            raise NotImplementedError(f"selector stage {s!r}")
    return keep, plain


def markdown(prefix: str = "") -> Column:
    """A block as Markdown source, by its columns."""
    c = lambda n: F.col(prefix + n)
    kind = c("block_type")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(c("depth"), F.lit(1))), F.lit(" "), c("content")))
        .when(kind == "code", F.concat(F.lit("```"), c("lang"), F.lit("\n"), c("content"), F.lit("\n```")))
        .when(kind == "list", F.concat(F.lit("- "), c("content")))
        .when(kind == "blockquote", F.concat(F.lit("> "), F.replace(c("content"), F.lit("\n"), F.lit("\n> "))))
        .when(kind == "horizontal_rule", F.lit("---"))
        .when(kind == "math", F.concat(F.lit("$$\n"), c("content"), F.lit("\n$$")))
        .otherwise(c("content"))
    )


def run(blocks: DataFrame, program: str) -> DataFrame:
    """document_id, ord, output of the selected blocks."""
    keep, plain = compile_selector(program)
    return blocks.where(keep).select("document_id", "ord", (F.col("content") if plain else markdown()).alias("output"))


def run_text(program: str, content: str) -> str | None:
    """The program over one Markdown text, outputs joined by newlines; None for nothing or an error.

    For single texts (the ``mq`` function); works on the parser's nodes.
    """
    from ..sources.markdown import render_node, scan

    try:
        out = []
        for x in scan(content or ""):
            if _matches(program, x):
                plain = program.rstrip().endswith(("to_text", "to_text()"))
                out.append(x["content"] if plain else render_node(x["block_type"], x["content"], x["depth"], x["lang"], x["properties"]))
        return "\n".join(out) or None
    except (NotImplementedError, IndexError):
        return None


def _matches(program: str, node: dict) -> bool:
    for stage in re.split(r"\|(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", program):
        s = stage.strip()
        m = re.fullmatch(r"\.(h)([1-6])", s)
        if m:
            ok = node["block_type"] == "heading" and node["depth"] == int(m[2])
        elif re.fullmatch(r"\.[a-z_]+", s) and s[1:] in _KINDS:
            ok = node["block_type"] == _KINDS[s[1:]]
        elif s.startswith("select(") and s.endswith(")"):
            ok = _holds(s[7:-1], node)
        elif s in ("to_text", "to_text()", "."):
            ok = True
        else:
            raise NotImplementedError(s)
        if not ok:
            return False
    return True


def _holds(text: str, node: dict) -> bool:
    """The condition for one node, by the same grammar."""
    words = []
    at = 0
    while at < len(text.rstrip()):
        m = _ATOM.match(text, at)
        if not m:
            raise NotImplementedError(text)
        at = m.end()
        if m["field"]:
            field = _FIELDS.get(m["field"])
            if field is None:
                raise NotImplementedError(m["field"])
            value = node[field]
            words.append(repr(None if value in ("", 0) and field in ("lang", "depth") else value))
        else:
            words.append({"null": "None", "true": "True", "false": "False"}.get(m["op"], m["op"]) if m["op"] else (m["num"] or repr(re.sub(r"\\(.)", r"\1", m["str"]))))
    return _compare(words)


def _compare(words: list[str]) -> bool:
    """and/or/not over comparisons of literals."""
    import ast

    def ev(e):
        if isinstance(e, ast.Expression):
            return ev(e.body)
        if isinstance(e, ast.BoolOp):
            return (all if isinstance(e.op, ast.And) else any)(ev(v) for v in e.values)
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            return not ev(e.operand)
        if isinstance(e, ast.Compare) and len(e.ops) == 1:
            a, b = ast.literal_eval(e.left), ast.literal_eval(e.comparators[0])
            if isinstance(e.ops[0], ast.Eq):
                return a == b
            if isinstance(e.ops[0], ast.NotEq):
                return a != b
            if a is None or b is None:
                return False
            return {ast.Lt: a < b, ast.Gt: a > b, ast.LtE: a <= b, ast.GtE: a >= b}[type(e.ops[0])]
        raise NotImplementedError(ast.dump(e))

    return bool(ev(ast.parse(" ".join(words), mode="eval")))
