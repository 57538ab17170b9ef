"""Rich text trees to plain text and to markdown: the tree has no bounded depth, so it has no column type. Trees go to Python a hundred
rows at a time, so that its memory does not grow with the table. Texts that are a JSON string, or no tree at all, never leave the JVM."""

from __future__ import annotations

import json
from collections.abc import Generator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _run(walk: Generator) -> str:
    """The result of a walk over a tree. A walk yields the walks of a node's children and gets their texts, so a deep tree
    needs a long list here and no deep stack."""
    stack, text = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(text))
            text = None
        except StopIteration as end:
            stack.pop()
            text = end.value
    return text


def _children(node: dict) -> list[dict]:
    return [c for c in node.get("content") or [] if isinstance(c, dict)]


def plain(node: dict) -> Generator:
    kind = node.get("type", "")
    if kind == "text":
        return str(node.get("text", ""))
    if kind in ("hardBreak", "rule"):
        return "\n"
    inner = []
    for c in _children(node):
        inner.append((yield plain(c)))
    if kind in ("doc", "bulletList", "orderedList"):
        return "\n".join(inner)
    return "".join(inner) + ("\n" if kind in ("paragraph", "heading", "listItem") else "")


def bare(node: dict) -> Generator:
    """All text below a node, without any marks."""
    if node.get("type") == "text":
        return str(node.get("text", ""))
    inner = []
    for c in _children(node):
        inner.append((yield bare(c)))
    return "".join(inner)


#: Marks from the innermost to the outermost; code keeps others off.
MARKS = (("strong", "**{}**"), ("em", "*{}*"), ("strike", "~~{}~~"))


def marked(node: dict) -> str:
    text, marks = str(node.get("text", "")), {m.get("type"): m.get("attrs") or {} for m in node.get("marks") or [] if isinstance(m, dict)}
    if "code" in marks:
        return f"`{text}`"
    for mark, form in MARKS:
        if mark in marks:
            text = form.format(text)
    link = marks.get("link", {}).get("href")
    return f"[{text}]({link})" if link else text


def listed(node: dict, depth: int) -> Generator:
    """The items of a list: a lead for the first block of each, as many spaces for its others, nested lists deeper."""
    out = []
    for k, item in enumerate(_children(node), 1):
        lead = "- " if node["type"] == "bulletList" else f"{k}. "
        for c in _children(item):
            text = yield markdown(c, depth + 1 if c.get("type") in LISTS else depth)
            if c.get("type") not in LISTS:
                text = "  " * depth + lead + text.rstrip("\n") + "\n"
                lead = " " * len(lead)
            out.append(text)
    return "".join(out) + ("\n" if depth == 0 else "")


def table(node: dict) -> Generator:
    rows = []
    for row in _children(node):
        if row.get("type") == "tableRow":
            cells = []
            for cell in _children(row):
                cells.append((yield bare(cell)).strip())
            rows.append(cells)
    wide = max(map(len, rows), default=0)
    lines = ["|" + "".join(f" {c} |" for c in r + [""] * (wide - len(r))) + "\n" for r in rows]
    return "".join([*lines[:1], "|" + " --- |" * wide + "\n", *lines[1:]] if rows else []) + "\n"


LISTS = ("bulletList", "orderedList")


def markdown(node: dict, depth: int = 0) -> Generator:
    kind, attrs = node.get("type", ""), node.get("attrs") or {}
    if kind == "text":
        return marked(node)
    if kind in ("hardBreak", "rule", "media", "mediaSingle"):
        return {"hardBreak": "\n", "rule": "---\n\n"}.get(kind, "[attachment]\n\n")
    if kind in ("emoji", "inlineCard", "embedCard"):
        return str(attrs.get("text" if kind == "emoji" else "url", ""))
    if kind == "table":
        return (yield table(node))
    if kind in LISTS:
        return (yield listed(node, depth))
    if kind in ("mention", "heading", "codeBlock"):
        text = yield bare(node)
        return "@" + text if kind == "mention" else "#" * int(attrs.get("level", 1)) + f" {text}\n\n" if kind == "heading" else f"```{attrs.get('language') or ''}\n{text}\n```\n\n"
    inner = []
    for c in _children(node):
        inner.append((yield markdown(c, depth)))
    if kind == "blockquote":
        return "".join(f"> {line}\n" for x in inner for line in x.rstrip("\n").split("\n")) + "\n"
    return "".join(inner).rstrip("\n") + "\n\n" if kind == "paragraph" else "".join(inner)


def _spelled(text: str | None, spell) -> str | None:
    """The text of a tree in JSON, null if it is none; a tree deeper than the parser goes counts as none."""
    try:
        tree = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return _run(spell(tree)).strip() if isinstance(tree, dict) else None


def plain_text(value: Column) -> Column:
    """A field as from_json or get_json_object give it: a tree becomes its text, any other text stays."""

    @F.udf("string", useArrow=False)
    def of_tree(text: str | None) -> str | None:
        return text if (told := _spelled(text, plain)) is None else told

    tree = value.rlike(r'^\s*\{(?s:.*)"type"')
    return F.when(tree, of_tree(F.when(tree, value))).otherwise(value)


def _job(df: DataFrame, column: str, out: str, spell) -> DataFrame:
    @F.udf("string", useArrow=False)
    def of_tree(text: str | None) -> str:
        return _spelled(text, spell) or ""

    c = F.trim(column)
    string = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    return df.withColumn(out, F.when(c.startswith('"'), F.coalesce(string, F.lit(""))).when(c.startswith("{"), of_tree(F.when(c.startswith("{"), F.col(column)))).otherwise(""))


def rich_text_to_plaintext(df: DataFrame, column: str, out: str = "plain") -> DataFrame:
    return _job(df, column, out, plain)


def rich_text_to_markdown(df: DataFrame, column: str, out: str = "markdown") -> DataFrame:
    return _job(df, column, out, markdown)


def replaced_in_text(value: Column, replacements: list[tuple[str, str]]) -> Column:
    """JSON of a tree, or of a plain string, with find and replace, in order, on its text. value is as get_json_object gives
    it: JSON of an object, or a bare string."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def changed(t: str) -> str:
            for find, put in replacements:
                t = t.replace(find, put)
            return t

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                tree = json.loads(t)
            except (ValueError, RecursionError):
                tree = None
            if not isinstance(tree, dict):
                return json.dumps(changed(t))
            todo = [tree]
            while todo:
                node = todo.pop()
                if node.get("type") == "text" and isinstance(node.get("text"), str):
                    node["text"] = changed(node["text"])
                if isinstance(node.get("content"), list):
                    todo += [c for c in node["content"] if isinstance(c, dict)]
            return json.dumps(tree)

        return texts.map(one)

    return of(value)
