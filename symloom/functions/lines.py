"""Arrow-batched helpers for text that only a walk over its lines can read."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a reader of pages has as Python strings at once; a longer page stands alone.
SLICE = 1 << 20


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield first, last
        first = last


def page_rows(read: Callable[[str], Iterable[tuple]], fields: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A reader of Arrow batches (path, content): the path and what ``read`` finds in the text, as rows of path and ``fields``.

    Batches hold as many rows as they like; they are read, and their rows given on, in slices of about ``SLICE`` bytes.
    """
    schema = pa.schema({"path": pa.string(), **fields})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                pages = batch.slice(first, last - first)
                rows = [(p, *r) for p, c in zip(pages.column(0).to_pylist(), pages.column(1).to_pylist(), strict=True) if c for r in read(c)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


_OPEN, _CLOSE = re.compile(r"```(\w+)?", re.A), re.compile(r"```\s*$")


def fences(content: str) -> list[tuple[str, int, str]]:
    """(language, line of the opening fence, code) of the closed fences that are not empty."""
    out, start = [], None
    lines = content.split("\n")
    for number, line in enumerate(lines, 1):
        if line[:3] != "```":
            continue
        if start is None:
            if opened := _OPEN.match(line):
                start, language = number, (opened[1] or "").lower()
        elif _CLOSE.match(line):
            if number - start > 1:
                out.append((language, start, "\n".join(lines[start : number - 1])))
            start = None
    return out


line_blocks = page_rows(fences, {"language": pa.string(), "start_line": pa.int32(), "code": pa.string()})


# the ends of lines that ``.`` and ``$`` know in the regular expressions of SQL
_ENDS = r"\n\r\x85\u2028\u2029"
_LAST = rf"(?:\r\n|[{_ENDS}])?\Z"
_HEADING = re.compile(rf"#{{1,6}}\s+([^{_ENDS}]+){_LAST}", re.A)
_FRONT = re.compile(rf"---\n[\s\S]*?\n---(?:\n|(?={_LAST}))")


def headed_fences(content: str) -> list[tuple[str, int, str, str | None]]:
    """Fences with the title of the last heading at or before their line; headings are counted below the front matter."""
    blocks = fences(content)
    if not blocks:
        return []
    front = _FRONT.match(content)
    lines = content[front.end() :].split("\n") if front else content.split("\n")
    marks = [(number, found[1]) for number, line in enumerate(lines, 1) if line[:1] == "#" and (found := _HEADING.match(line))]
    at = [number for number, _ in marks]
    return [(*b, marks[i - 1][1] if (i := bisect_right(at, b[1])) else None) for b in blocks]


def joined_parens(code: str) -> str:
    """Line ends inside parentheses become spaces."""
    depth, out = 0, []
    for piece in re.split(r"([()\n])", code):
        depth += (piece == "(") - (piece == ")")
        out.append(" " if piece == "\n" and depth > 0 else piece)
    return "".join(out)


def headed_blocks(joined: tuple[str, ...], others: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A reader of pages: their fences in these languages with the heading above; in ``joined`` ones the line ends inside parentheses are spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in _slices(batch.content.str.len().fillna(0).to_numpy(np.int64)):
                pages = batch.iloc[first:last]
                rows = [
                    (p, language, line, joined_parens(code) if language in joined else code, heading)
                    for p, c in zip(pages.path, pages.content, strict=True)
                    if c
                    for language, line, code, heading in headed_fences(c)
                    if language in joined or language in others
                ]
                yield pd.DataFrame(rows, columns=["path", "language", "start_line", "code", "heading"])

    return run


@F.pandas_udf(T.StringType())
def join_paren_lines(code: pd.Series) -> pd.Series:
    return code.map(joined_parens, na_action="ignore")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def dedented(text: str) -> str:
    """Without the common indent; if the first line is flush, the common indent of the others goes."""
    lines = text.split("\n")
    if len(lines) == 1:
        return text.strip()
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return text
    rest = [_indent(lines[i]) for i in full[1:]]
    flush = _indent(lines[full[0]]) == 0 and bool(rest) and min(rest) > 0
    cut = min(rest) if flush else min(_indent(lines[i]) for i in full)
    first = full[0] + 1 if flush else 0
    return "\n".join(x if i < first or not x.strip() else x[cut:] for i, x in enumerate(lines))


@F.pandas_udf(T.StringType())
def dedent(text: pd.Series) -> pd.Series:
    return text.map(dedented, na_action="ignore")


_EXAMPLE = re.compile(r"(?:^|\n)([^\n]*)\n?[ \t]*```(\w*)[^\n]*\n([\s\S]*?)\n?[ \t]*```", re.A)


def examples(content: str) -> list[tuple[int, str, str, str]]:
    """(number, line before it, language, dedented code) of every fence, also an indented one."""
    return [(pos, m[1], m[2], dedented(m[3])) for pos, m in enumerate(_EXAMPLE.finditer(content))] if "```" in content else []


example_rows = page_rows(examples, {"pos": pa.int32(), "title": pa.string(), "language": pa.string(), "code": pa.string()})


_QUOTES = "\"'“”‘’`"


def admonition_head(line: str) -> tuple[str, str | None, str] | None:
    """(type, quoted title, inline text) of an opening line."""
    found = re.match(r"(?:!!!|\?\?\?)\+?\s*([\w-]+)\s*(.*)$", line.strip())
    if not found:
        return None
    kind, rest = found[1], found[2].strip()
    if rest and rest[0] in _QUOTES and rest[-1] in _QUOTES:
        return kind, rest[1:-1], ""
    return kind, None, rest


def admonition_list(content: str, level: int = 0, first: int = 1) -> list[tuple]:
    """(line, type, title, indent, level, content), outer blocks before the ones inside."""
    lines, out, i = content.split("\n"), [], 0
    while i < len(lines):
        head, at = admonition_head(lines[i]), i
        i += 1
        if head is None:
            continue
        indent, inside = _indent(lines[at]), []
        while i < len(lines) and (not lines[i].strip() or _indent(lines[i]) > indent):
            inside.append(lines[i][indent + 4 :] if len(lines[i]) >= indent + 4 else lines[i].lstrip())
            i += 1
        text = "\n".join([head[2], *inside] if head[2] else inside)
        if text.strip():
            kind = head[0]
            title = head[1] or re.sub(r"\b\w", lambda m: m[0].upper(), kind.replace("-", " "))
            out.append((first + at, kind.lower(), title, indent, level, text.strip()))
            out += admonition_list("\n".join(inside), level + 1, first + at + 1)
    return out


admonition_rows = page_rows(admonition_list, {"line": pa.int32(), "type": pa.string(), "title": pa.string(), "indent": pa.int32(), "level": pa.int32(), "content": pa.string()})


def _is_symbol(name: str) -> bool:
    """Class names, names with an underscore inside, names with a hyphen; no dunder and no plain lower-case names."""
    return bool(re.match("[A-Z]", name)) or not name.startswith("__") and ("_" in name and not name.startswith("_") or "-" in name)


def option_members(lines: list[str]) -> list[str]:
    """The symbol-like names of the ``members:`` list in the options below a directive."""
    found: list[str] = []
    listing, indent = False, 0
    for line in lines:
        text = line.strip()
        if not text:
            continue
        if text.startswith(":::") or ":" not in text and not text.startswith("-"):
            break
        if text.startswith("members:"):
            listing, indent = True, _indent(line)
            found += [re.sub(r"^-\s*", "", m).strip() for m in re.split(r"\s+-\s+", text[8:].strip())]
        elif listing and text.startswith("- "):
            found.append(text[2:].strip())
        elif listing and _indent(line) <= indent and not text.startswith("-"):
            listing = False
    return [m for m in found if m and not m.startswith("#") and _is_symbol(m)]


def subpage_parts(content: str, includes: dict[str, str] | None = None) -> tuple[str, list[str]]:
    text = re.sub(r"--8<--\s*[\"']([^\"']+)[\"']", lambda m: (includes or {}).get(m[1], ""), content)
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = text[end + 4 :].lstrip("\n")
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if x.strip().startswith(":::")]
    refs: list[str] = []
    for i in marks:
        words = lines[i].strip()[3:].split()
        if words and not words[0].startswith("#"):
            members = option_members(lines[i + 1 :])
            refs += [f"{words[0]}.{m}" for m in members] or [words[0]]
    return "\n".join(lines[: marks[0]] if marks else lines).rstrip(), refs


@F.pandas_udf(T.StructType().add("markdown", T.StringType()).add("symbol_refs", T.ArrayType(T.StringType())))
def subpage(content: pd.Series) -> pd.DataFrame:
    parts = [subpage_parts(c) if c is not None else (None, None) for c in content]
    return pd.DataFrame({"markdown": [p[0] for p in parts], "symbol_refs": [p[1] for p in parts]})
