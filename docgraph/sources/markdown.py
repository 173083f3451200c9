"""Markdown to block markup, a document at a time, with notes of what couldn't be carried over."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docgraph.sources.scan import RENDERERS, VARIABLE

FENCE = re.compile(r"^(\s*)(`{3,}|~{3,})(.*)$")
SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
RULE = re.compile(r"^\s*([-*_])(\s*\1){2,}\s*$")
FOOTNOTE = re.compile(r"^\[\^([^\]]+)\]:\s?(.*)$")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
ENTRY = re.compile(r"^([A-Za-z_][\w-]*)\s*:\s*(.*)$")
LINK = re.compile(r"(`[^`]*`)|<((?:https?|ftp)://[^>\s]+)>|<(mailto:)([^>\s]+)>")


def linked(text: str) -> str:
    """Autolinks as links, outside code spans."""
    return LINK.sub(lambda m: m[1] or (f"[{m[2]}]({m[2]})" if m[2] else f"[{m[4]}]({m[3]}{m[4]})"), text)


def escaped(text: str) -> str:
    """A literal ``{{name}}`` is kept from being read as a variable."""
    return VARIABLE.sub(lambda m: "\\" + m[0] if m[2] else m[0], text)


def anchor(text: str) -> str:
    """The id that a heading has where code stays in it."""
    bare = "".join(c for c in text.replace("`", "").lower() if c.isalnum() or c.isspace() or c in "_-")
    return re.sub(r"\s+", "-", bare.strip())


class Converter:
    def __init__(self, text: str | None):
        self.lines = re.sub(r"\r\n?", "\n", text or "").split("\n")
        self.out: list[str] = []
        self.notes: list[str] = []
        self.counts: Counter[str] = Counter()

    def put(self, kind: str, body: list[str], attrs: str = "", ident: str | None = None) -> None:
        """A block whose fence is longer than any run of ``=`` alone on a line of it; without an id of its own it is numbered within its type."""
        if kind != "meta":
            if ident is None:
                self.counts[kind] += 1
                ident = f"{kind}-{self.counts[kind]}"
            attrs = " {" + " ".join(x for x in (f"#{ident}", attrs) if x) + "}"
        longest = max((len(x.strip()) for x in body if x.strip() and not x.strip().strip("=")), default=2)
        fence = "=" * max(3, longest + 1)
        self.out += [f"{fence} {kind}{attrs}", *body, fence]

    def until(self, k: int, ends) -> int:
        return next((j for j in range(k, len(self.lines)) if ends(self.lines[j])), len(self.lines))

    def front(self) -> int:
        """Leading entries between dashes become meta; the line after them."""
        if self.lines[0] != "---":
            return 0
        end = self.until(1, lambda x: x in ("---", "..."))
        if end == len(self.lines):
            return 0
        body = []
        for x in self.lines[1:end]:
            m = ENTRY.match(x)
            if m:
                value = m[2].strip()
                if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                    value = value[1:-1]
                plain = bool(value) and not re.search(r'[\s"]', value)
                body.append(f"{m[1]}={value}" if plain else m[1] + '="' + value.replace('"', '\\"') + '"')
            elif x.strip():
                self.notes.append(f"frontmatter line not converted: {x}")
        self.put("meta", body)
        self.out.append("")
        return end + 1

    def step(self, k: int) -> int:
        """Converts what starts at line k; the line after it."""
        line = self.lines[k]
        after = self.lines[k + 1] if k + 1 < len(self.lines) else None
        if m := FENCE.match(line):
            mark = m[2]

            def ends(x: str) -> bool:
                bare = x.strip()
                return len(x) - len(x.lstrip()) <= 3 and len(bare) >= len(mark) and not bare.strip(mark[0])

            end = self.until(k + 1, ends)
            info = (m[3].split() or [""])[0]
            if info in RENDERERS:
                self.put("diagram", self.lines[k + 1 : end], f"format={info}")
            else:
                self.put("code", self.lines[k + 1 : end], f"lang={info}" if info else "")
            return end + 1
        if line.strip() == "$$":
            end = self.until(k + 1, lambda x: x.strip() == "$$")
            self.put("math", self.lines[k + 1 : end])
            return end + 1
        ruled = RULE.match(line)
        if line.strip() and not ruled and after is not None and re.match(r"^(=+|-+)\s*$", after):
            self.out.append(("# " if after[0] == "=" else "## ") + escaped(line.strip()))
            return k + 2
        if ruled:
            self.notes.append(f"dropped thematic break at line {k + 1}")
            return k + 1
        if m := FOOTNOTE.match(line):
            end = self.until(k + 1, lambda x: not re.match(r"^\s{2,}\S", x))
            body = [x for x in (m[2].strip(), *(x.lstrip() for x in self.lines[k + 1 : end])) if x]
            self.put("note", [escaped(linked(x)) for x in body], ident=m[1].strip())
            return end
        if line.lstrip().startswith(">"):
            end = self.until(k, lambda x: not x.lstrip().startswith(">"))
            self.put("note", [escaped(re.sub(r"^\s*>\s?", "", x)) for x in self.lines[k:end]])
            return end
        if "|" in line and after is not None and SEPARATOR.match(after):
            end = self.until(k + 2, lambda x: "|" not in x)
            self.put("table", self.lines[k:end])
            return end
        m = HEADING.match(line)
        if m and "`" in m[2] and not re.search(r"\{[^}]*\}\s*$", m[2]) and anchor(m[2]):
            self.out.append(f"{m[1]} {escaped(m[2])} {{#{anchor(m[2])}}}")
            return k + 1
        text = escaped(linked(line))
        if re.search("<[a-zA-Z/]", re.sub("`[^`]*`", "", text)):
            self.notes.append(f"raw HTML kept as text at line {k + 1}: {line.strip()[:40]}")
        self.out.append(text)
        return k + 1


def convert(text: str | None) -> tuple[str, list[str]]:
    """The markup, and notes of what was dropped or kept as it is."""
    c = Converter(text)
    k = c.front()
    while k < len(c.lines):
        k = c.step(k)
    out = "\n".join(c.out)
    return (out if out.endswith("\n") else out + "\n"), c.notes


def convert_corpus(docs: DataFrame) -> DataFrame:
    """(doc, text, notes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [convert(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc": pdf["doc"], "text": [t for t, _ in done], "notes": [n for _, n in done]})

    return docs.select("doc", "text").mapInPandas(run, "doc string, text string, notes array<string>")
