"""Secret scans with one combined automaton: rules are compiled to a minimal deterministic automaton over bytes.

Two automata come from the same rules. The start automaton reads a text backwards once and marks, for every rule,
the bytes at which a match begins; the match automaton is run from such a byte only and gives the longest match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symloom.llm.text import row_slices, text_buffers

ANY = (1 << 256) - 1


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression over bytes, and a test that a match must pass to be kept.

    Expressions have literals, escapes (\\xNN, \\-quoted marks), classes, groups, ``|``, ``? * +`` and
    ``{n}``, ``{n,}``, ``{n,m}``. A match that fails the test still takes its bytes: the next one begins after it.
    """

    kind: str
    pattern: str
    keep: Callable[[bytes], bool] | None = None
    any_case: bool = False


def assigned_12(match: bytes) -> bool:
    """Whether the value after the first ':' or '=' has 12 bytes or more."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 12


def longer_18(match: bytes) -> bool:
    return len(match) >= 18


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", assigned_12, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", longer_18),
    Rule("hex", r"[0-9a-f]{16,}"),  # its matches are whole runs, so the least length can stand in the expression
)
RULES = (
    *BASE_RULES,
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Parser:
    """A rule's expression as a tree of ('set', mask), ('cat', xs), ('alt', xs) and ('rep', x, least, most)."""

    def __init__(self, rule: Rule):
        self.text, self.at, self.any_case = rule.pattern, 0, rule.any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def tree(self) -> tuple:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, item: tuple) -> tuple:
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        while self.peek() in ("?", "*", "+", "{"):
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                item = ("rep", item, int(low), int(high) if high else (None if comma else int(low)))
            else:
                item = ("rep", item, *bounds[sign])
        return item

    def byte(self) -> int:
        sign = self.take()
        if sign != "\\":
            return ord(sign)
        sign = self.take()
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(sign, ord(sign))

    def cased(self, mask: int) -> int:
        if self.any_case:
            for low in range(ord("a"), ord("z") + 1):
                if mask >> low & 1 or mask >> low - 32 & 1:
                    mask |= 1 << low | 1 << low - 32
        return mask

    def atom(self) -> tuple:
        sign = self.peek()
        if sign == "(":
            self.take()
            inner = self.tree()
            self.take()
            return inner
        if sign == "[":
            self.take()
            negated = self.peek() == "^" and bool(self.take())
            mask = 0
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.byte()
                mask |= sum(1 << b for b in range(low, high + 1))
            self.take()
            mask = self.cased(mask)
            return ("set", ANY & ~mask if negated else mask)
        if sign == ".":
            self.take()
            return ("set", ANY & ~(1 << 10))
        return ("set", self.cased(1 << self.byte()))


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def node(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, begin: int, backwards: bool) -> int:
        """Join ``tree`` behind state ``begin``; the state after it."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.moves[begin].append((tree[1], end))
            return end
        if kind == "cat":
            for item in reversed(tree[1]) if backwards else tree[1]:
                begin = self.add(item, begin, backwards)
            return begin
        if kind == "alt":
            end = self.node()
            for item in tree[1]:
                head = self.node()
                self.free[begin].append(head)
                self.free[self.add(item, head, backwards)].append(end)
            return end
        _, item, least, most = tree
        for _ in range(least):
            begin = self.add(item, begin, backwards)
        end = self.node()
        if most is None:
            loop = self.node()
            self.free[begin].append(loop)
            self.free[loop].append(end)
            self.free[self.add(item, loop, backwards)].append(loop)
            return end
        self.free[begin].append(end)
        for _ in range(most - least):
            begin = self.add(item, begin, backwards)
            self.free[begin].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """Transition array of shape (states, classes), the class of each byte, and each state's accepted rules (bits)."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int = field(default=-1)


def compile_rules(rules: tuple[Rule, ...], backwards: bool = False, search: bool = False) -> Automaton:
    """Subset construction over all rules, then minimisation. search: a match may begin at any byte."""
    nfa, finals = _Nfa(), {}
    root = nfa.node()
    for k, rule in enumerate(rules):
        head = nfa.node()
        nfa.free[root].append(head)
        finals[nfa.add(_Parser(rule).tree(), head, backwards)] = 1 << k
    masks = sorted({m for moves in nfa.moves for m, _ in moves})
    signatures: dict[tuple, int] = {}
    classes = np.array([signatures.setdefault(tuple(m >> b & 1 for m in masks), len(signatures)) for b in range(256)], dtype=np.uint8)
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signatures))]

    first = nfa.closure([root])
    known, rows = {first: 0}, []
    for states in (order := [first]):
        row = []
        for byte in samples:
            reached = {to for s in states for mask, to in nfa.moves[s] if mask >> byte & 1}
            following = nfa.closure(reached | {root} if search else reached)
            if following not in known:
                known[following] = len(known)
                order.append(following)
            row.append(known[following])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    accepts = np.array([sum({finals[s] for s in states if s in finals}) for states in order], dtype=np.int32)

    labels = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([labels[:, None], labels[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == labels.max():
            break
        labels = finer
    kept = np.unique(labels, return_index=True)[1]
    table, accepts = labels[table[kept]].astype(np.int32), accepts[kept]
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(table, classes, accepts, int(labels[0]), int(stuck[0]) if len(stuck) and not search else -1)


class Scanner:
    """Both automata of a rule set. Scanning works on many stretches of text at once, one byte of each a step."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, lane: int = 1024):
        self.rules, self.lane = rules, lane
        self.starts = compile_rules(rules, backwards=True, search=True)
        self.match = compile_rules(rules)
        width = self.starts.table.shape[1]
        self.flat = (self.starts.table * width).reshape(-1).astype(np.int32)
        self.flat_list = self.flat.tolist()
        self.home = self.starts.start * width
        self.hits = np.zeros(len(self.flat), dtype=np.int32)
        self.hits[::width] = self.starts.accepts
        # state after two bytes, where it is the same from whatever state they are read; else -1
        twice = self.starts.table[self.starts.table]
        known = (twice == twice[:1]).all(axis=0)
        self.settled = np.where(known, twice[0] * width, -1).reshape(-1).astype(np.int32)
        self.rows = [row.tolist() for row in self.match.table[:, self.match.classes]]

    def _begins(self, data: np.ndarray, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
        """Where matches begin, in order, and the rules (bits): one pass over the bytes from the last to the first.

        Longer inputs are taken in pieces of about ``most`` bytes, so that memory does not follow a text's length.
        """
        n, state, first = len(data), self.home, 0
        places, rules = [], []
        width = self.starts.table.shape[1]
        turned = data[::-1]
        while first < n:
            last = min(n, first + most)
            after = -1
            while last < n and after < 0:  # the next pair of bytes behind which the state is known
                after = int(self.settled[int(self.starts.classes[turned[last - 2]]) * width + int(self.starts.classes[turned[last - 1]])])
                last += after < 0
            at, mask = self._piece(turned[first:last], state)
            places.append(n - 1 - first - at)
            rules.append(mask)
            first, state = last, after
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at, mask = np.concatenate(places), np.concatenate(rules)
        order = np.argsort(at)
        return at[order], mask[order]

    def _piece(self, turned: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the turned bytes where matches begin, from state ``home`` on.

        The text is cut behind pairs of bytes that lead every state to one and the same, so that stretches can be
        read side by side.
        """
        classes = self.starts.classes[turned].astype(np.int32)
        n = len(turned)
        width = self.starts.table.shape[1]
        after = self.settled[classes[:-1] * width + classes[1:]]
        homes = np.flatnonzero(after >= 0) + 2
        wanted = np.arange(self.lane, n, self.lane)
        cuts = homes[np.minimum(np.searchsorted(homes, wanted), max(0, len(homes) - 1))] if len(homes) else np.zeros(0, np.int64)
        edges = np.unique(np.concatenate(([0], cuts[cuts < n], [n])))
        begin, length = edges[:-1], np.diff(edges)
        order = np.argsort(-length, kind="stable")
        place, length = begin[order].copy(), length[order]
        state = np.where(place > 0, after[np.maximum(place - 2, 0)] if len(after) else home, home).astype(np.int32)
        found, rules = [], []
        wide = int(np.searchsorted(-length, -4 * self.lane, side="left"))  # stretches over four times the usual length
        for k in range(wide):
            s, flat, hits, at = int(state[k]), self.flat_list, self.hits, int(place[k])
            for i, c in enumerate(classes[at : at + int(length[k])].tolist()):
                s = flat[s + c]
                if hits[s]:
                    found.append(np.array([at + i]))
                    rules.append(hits[s : s + 1])
        place, length, state = place[wide:], length[wide:], state[wide:]
        ends = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
        for live in ends.tolist():
            now = self.flat[state[:live] + classes[place[:live]]]
            state[:live] = now
            got = self.hits[now]
            if got.any():
                at = np.flatnonzero(got)
                found.append(place[at])
                rules.append(got[at])
            place[:live] += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(found), np.concatenate(rules)

    def _longest(self, data: bytes, at: int, bit: int) -> int:
        state, accepts, dead, end = self.match.start, self.match.accepts, self.match.dead, -1
        for i in range(at, len(data)):
            state = self.rows[state][data[i]]
            if state == dead:
                break
            if accepts[state] & bit:
                end = i + 1
        return end

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By row: (start, end, rule index) in code points; leftmost, longest, not overlapping within a rule."""
        lengths = np.diff(offsets)
        rows = len(lengths)
        total = int(offsets[-1] - offsets[0])
        joined = np.full(total + rows, 0xFF, dtype=np.uint8)  # 0xFF is in no UTF-8 text and parts the rows
        keep = np.ones(total + rows, dtype=bool)
        bounds = offsets[1:] - offsets[0] + np.arange(rows)
        keep[bounds] = False
        joined[keep] = data[offsets[0] : offsets[-1]]
        firsts = np.concatenate(([0], bounds + 1))
        at, mask = self._begins(joined)
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(at):
            return out
        owner = np.searchsorted(firsts, at, side="right") - 1
        for row in np.unique(owner).tolist():
            here = owner == row
            text = joined[firsts[row] : firsts[row + 1] - 1]
            raw, points = text.tobytes(), np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
            found = []
            for k, rule in enumerate(self.rules):
                past = 0
                for s in (at[here & (mask & (1 << k) != 0)] - firsts[row]).tolist():
                    if s < past:
                        continue
                    past = self._longest(raw, s, 1 << k)
                    if rule.keep is None or rule.keep(raw[s:past]):
                        found.append((int(points[s]), int(points[past]), k))
            if found:
                out[row] = sorted(found, key=lambda x: (x[0], x[2]))
        return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, slice_bytes: int = 1 << 22) -> DataFrame:
    """All columns of ``docs`` that are its id and text, with ``spans``: the kept matches of all rules.

    spans are ordered by start and then by the rule's place in ``rules``; offsets are code points of the whole
    text, the end exclusive. Null and empty texts have no spans; null ids and repeated rows are kept; a text of any
    length is scanned whole. No shuffle: tables of the automata, a few hundred kilobytes, travel with the tasks.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            spans = [[] for _ in range(batch.num_rows)]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1)
                last = min(last, batch.num_rows)
                for row, found in scanner.spans(data, offsets[first : last + 1]).items():
                    spans[first + row] = [{"kind": kinds[k], "start": s, "end": e} for s, e, k in found]
                first = last
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, text string, spans {_SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<{kind}>", slice_bytes: int = 1 << 22) -> DataFrame:
    """``docs`` with every secret replaced by its mark; overlapping secrets become one mark of the first kind.

    Columns stay as they are, but for n_chars, which follows the new text. Null texts stay null. Texts are scanned about
    ``slice_bytes`` at a time, longer ones alone.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
        if not found:
            return text
        out, past = [], 0
        for start, end, k in found:
            if start >= past:
                out += [text[past:start], mark.format(kind=kinds[k])]
            past = max(past, end)
        return "".join([*out, text[past:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            columns = list(batch.columns)
            found: dict[int, list] = {}
            for first, last in row_slices(offsets, slice_bytes):
                found |= {first + r: x for r, x in scanner.spans(data, offsets[first : last + 1]).items()}
            if found:
                texts = columns[at].to_pylist()
                for row, spans in found.items():
                    texts[row] = clean(texts[row], spans)
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    lengths = columns[counted].to_pylist()
                    for row in found:
                        lengths[row] = len(texts[row])
                    columns[counted] = pa.array(lengths, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: counts of the base kinds, the base spans' SHA-256, all spans as text."""
    found = scan(docs, rules)
    base = [r.kind for r in BASE_RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, everything = [[] for _ in base], [], []
            for spans in batch.column(1).to_pylist():
                mine = [s for s in spans if s["kind"] in base]
                for k, kind in enumerate(base):
                    counts[k].append(sum(s["kind"] == kind for s in mine))
                said = lambda xs: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in xs)
                digests.append(hashlib.sha256(said(mine).encode()).hexdigest())
                everything.append(said(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(everything, pa.string())],
                ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return found.select("doc_id", "spans").mapInArrow(run, schema)
