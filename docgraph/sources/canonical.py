"""The normal form of block markup: one way to write each document.

Blocks are parted by one blank line; attributes are written in the order id,
classes, entries; every heading carries its id; variables are replaced; a fence
is one longer than the longest bare run of ``=`` in its body; lists are indented
by two blanks a level and numbered on. A normal form is its own normal form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docgraph.sources.scan import ATTRIBUTE, DATA, FLOW, NUMBER, Scanner, value_text


def typed(text: str) -> bool:
    """Whether a bare text would be read as something other than itself."""
    return text in ("true", "false") or bool(NUMBER.match(text)) or text != text.strip() or (len(text) > 1 and text[0] == text[-1] == '"')


def attribute_text(raw: str | None) -> list[str]:
    """``.class``, ``key="value"``, ``key=1`` and ``flag`` of raw attributes, without the id; of a key given twice the last counts."""
    classes, entries = [], {}
    for tok in ATTRIBUTE.findall(raw.strip()[1:-1]) if raw else []:
        key, eq, value = tok.partition("=")
        if tok[0] == ".":
            classes.append(tok)
        elif tok[0] != "#":
            if not eq or value == "true":
                entries[key] = key
            elif value == "false" or NUMBER.match(value):
                entries[key] = f"{key}={value_text(value)}"
            else:
                entries[key] = key + '="' + re.sub('^"|"$', "", value) + '"'
    return classes + list(entries.values())


def entry_lines(body: str) -> list[str]:
    out = {}
    for line in body.split("\n"):
        at = line.find("=")
        if at > 0:
            value = line[at + 1 :].strip()
            if len(value) > 1 and value[0] == value[-1] == '"':
                out[line[:at].strip()] = value if typed(value[1:-1]) else value[1:-1]
            else:
                out[line[:at].strip()] = value_text(value)
    return [f"{k} = {v}" for k, v in out.items()]


class Writer:
    """Blocks of a scanned document by their parents."""

    def __init__(self, text: str | None):
        s = Scanner("", text)
        s.meta = {k: v.replace("{{", "\\{{") for k, v in s.meta.items()}  # a value isn't read again
        s.scan(0, len(s.lines), 0, 0)
        self.of: dict[int, list[dict]] = {}
        self.items: dict[int, list[dict]] = {}
        for r in s.rows:
            if r["tag"] == "block":
                self.of.setdefault(r["parent"], []).append(r)
            elif r["tag"] == "item":
                self.items.setdefault(r["seq"], []).append(r)

    def attrs(self, r: dict) -> str:
        parts = ([f"#{r['id']}"] if r.get("id") is not None else []) + attribute_text(r.get("raw_attrs"))
        return " {" + " ".join(parts) + "}" if parts else ""

    def listed(self, r: dict) -> str:
        out, numbers = [], {}
        for i, x in enumerate(self.items.get(r["seq"], [])):
            if i and x.get("loose"):
                out.append("")
            level = x["depth"]
            numbers = {k: v for k, v in numbers.items() if k <= level}
            if x["first"] is not None:
                numbers[level] = numbers[level] + 1 if level in numbers else x["first"]
            task = {"open": "[ ] ", "done": "[x] "}.get(x["kind"] or "", "")
            out.append("  " * level + (f"{numbers[level]}. " if x["first"] is not None else "- ") + task + x["text"])
        return "\n".join(out)

    def block(self, r: dict) -> str:
        if r["kind"] == "heading":
            return "#" * r["level"] + " " + r["text"] + self.attrs(r)
        if r["kind"] == "hidden":
            return "%%" + (" " + r["text"] if r["text"] else "")
        if r["kind"] == "footnote":
            return f"[^{r['id']}]: {r['text']}"
        if r["kind"] == "list":
            return self.listed(r)
        if r["kind"] == "paragraph":
            return r["text"]
        body = r["text"].split("\n") if r["text"] else []
        if r["type"] in DATA:
            body = entry_lines(r["text"])
        elif r["type"] in FLOW:
            body = self.text(r["seq"]).split("\n") if r["seq"] in self.of else []
        longest = max((len(x.rstrip()) for x in body if x.rstrip() and not x.rstrip().strip("=")), default=2)
        fence = "=" * max(3, longest + 1)
        return "\n".join([f"{fence} {r['type']}{self.attrs(r)}", *body, fence])

    def text(self, parent: int) -> str:
        return "\n\n".join(self.block(r) for r in self.of.get(parent, []))


def canonical(text: str | None) -> str:
    return Writer(text).text(0) + "\n"


def canonicalize(corpus: DataFrame) -> DataFrame:
    """(doc, text, same): the normal form of each document, and whether it was in it already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [canonical(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc": pdf["doc"], "text": out, "same": [a == b for a, b in zip(pdf["text"], out, strict=True)]})

    return corpus.select("doc", "text").mapInPandas(run, "doc string, text string, same boolean")
