"""Deltas for people: workflow commands and a markdown summary."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from duplet.operators import delta as d

NOTICE, WARNING, ERROR = "notice", "warning", "error"
# Wording that tools and readers of the output know.
NOTHING = "No new duplication vs the merge-base."
INTRODUCTION = "New duplication introduced by this change, relative to its merge-base. Nothing here blocks a merge: extract the shared logic where that makes sense, or leave it if the similarity is coincidental."
WITHHELD = "{} further finding(s) withheld by the `report.max_findings` cap. Raise or remove it to see them all."
LABELS = {d.NEW: "new", d.UNREFERENCED: "became unreferenced", d.WORSENED: "worsened"}


def percent(share: float) -> str:
    return f"{share * 100:.0f}%"


def escape_message(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def escape_property(text: str) -> str:
    return escape_message(text).replace(":", "%3A").replace(",", "%2C")


@dataclass(frozen=True)
class Annotation:
    file: str
    message: str
    start_line: int | None = None
    end_line: int | None = None
    title: str | None = None
    severity: str = WARNING

    def command(self) -> str:
        """One line, whatever the message holds."""
        known = (("file", escape_property(self.file)), ("line", self.start_line), ("endLine", self.end_line), ("title", None if self.title is None else escape_property(self.title)))
        return f"::{self.severity} {','.join(f'{k}={v}' for k, v in known if v is not None)}::{escape_message(self.message)}"


class Summary:
    """Markdown, block by block."""

    def __init__(self) -> None:
        self._blocks: list[str] = []
        self._tight: list[bool] = []  # bullets follow each other without a blank line

    def _add(self, text: str, tight: bool = False) -> Summary:
        self._blocks.append(text)
        self._tight.append(tight)
        return self

    def heading(self, level: int, text: str) -> Summary:
        if not 1 <= level <= 6:
            raise ValueError("heading levels go from 1 to 6")
        return self._add(f"{'#' * level} {text}")

    def paragraph(self, text: str) -> Summary:
        return self._add(text)

    def bullet(self, text: str) -> Summary:
        return self._add(f"- {text}", True)

    def table(self, headers: list[str], rows: list[list[str]]) -> Summary:
        if any(len(r) != len(headers) for r in rows):
            raise ValueError("a row is not as wide as the headers")
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
        return self._add("\n".join([line(headers), "|" + " --- |" * len(headers), *map(line, rows)]))

    def is_empty(self) -> bool:
        return not self._blocks

    def render(self) -> str:
        out = ""
        for text, tight in zip(self._blocks, self._tight, strict=True):
            out += text + ("\n" if tight else "\n\n")
        return out.rstrip("\n") + "\n" if out else ""

    def append_to(self, path: str | Path) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(self.render())


def _span(side: dict) -> str:
    return f"{side['file']}:{side['start_line']}-{side['end_line']}"


def rows_of(delta: d.Delta) -> dict[str, list[dict]]:
    return {"clones": [r.asDict(True) for r in delta.new_clones.collect()], "vocab": [r.asDict(True) for r in delta.vocab.collect()], "blocks": [r.asDict(True) for r in delta.new_blocks.collect()]}


def vocab_message(row: dict, other: str) -> str:
    if row["change"] == d.NEW:
        return f"new vocabulary overlap with {other}: {percent(row['overlap'])} ({row['shared']} shared identifiers)"
    if row["change"] == d.UNREFERENCED:
        return f"vocabulary overlap with {other} ({percent(row['overlap'])}) and neither side has inbound imports anymore"
    return f"vocabulary overlap with {other} grew from {percent(row['from_overlap'])} to {percent(row['to_overlap'])}"


def annotations(found: dict[str, list[dict]]) -> list[Annotation]:
    """Two for each clone and block, one on either side about the other; one, on side a, for each vocabulary finding."""
    out = []
    for r in found["clones"]:
        for on, other in ((r["a"], r["b"]), (r["b"], r["a"])):
            out.append(Annotation(on["file"], f"{percent(r['similarity'])} duplicate of `{other['qualname']}` at {_span(other)}", on["start_line"]))
    for r in found["vocab"]:
        out.append(Annotation(r["a"], vocab_message(r, r["b"])))
    for r in found["blocks"]:
        for on, other in ((r["a"], r["b"]), (r["b"], r["a"])):
            out.append(Annotation(on["file"], f"{r['tokens']} normalized tokens duplicated at {_span(other)}", on["start_line"]))
    return out


def summary(found: dict[str, list[dict]], withheld: int) -> Summary:
    out = Summary().heading(2, "Duplication delta")
    empty = not any(found.values())
    out.paragraph(NOTHING if empty else INTRODUCTION)
    if withheld:
        out.paragraph(WITHHELD.format(withheld))
    name = lambda s: f"{_span(s)} (`{s['qualname']}`)"
    if found["clones"]:
        out.heading(3, "New clone pairs").table(["Similarity", "A", "B"], [[percent(r["similarity"]), name(r["a"]), name(r["b"])] for r in found["clones"]])
    if found["vocab"]:
        out.heading(3, "Vocabulary findings").table(["Change", "A", "B", "Overlap"], [[LABELS[r["change"]], r["a"], r["b"], percent(r["overlap"])] for r in found["vocab"]])
    if found["blocks"]:
        out.heading(3, "New duplicated blocks").table(["Size", "A", "B"], [[f"{r['tokens']} tokens", _span(r["a"]), _span(r["b"])] for r in found["blocks"]])
    return out
