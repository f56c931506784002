"""Repair of damaged conversations: cheapest edits by a dynamic program over a grammar that all conversations share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.text import cut

#: States of the turn grammar `(s?(ua)+)?`: at the start, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The turn that an insertion or a new role makes in each state, and inserted turns that lead from a state to an end.
ONWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Symbols: 0 to 3 for turns of roles s, u, a and others, 4 to 7 for truncated ones, 8 for what must be deleted.
OTHER, TRUNCATED, GONE, LEAVES = 3, 4, 8, 9
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


def _leaf(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the cheapest edits of one turn from a state to another, insertions before it included."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for first in range(4):
        state, audit, cost = first, "", 0
        for _ in range(3):
            ends = [(state, DELETE_COST, "D")]
            if symbol != GONE:
                extra = TRUNCATED_COST if symbol >= TRUNCATED else 0
                kept = {0: SYSTEM if state == START else None, 1: USER if ONWARD[state] == USER else None, 2: ASSISTANT if state == USER else None}.get(symbol % TRUNCATED)
                ends += [(ONWARD[state], extra + REROLE_COST, "R")] + ([(kept, extra, "K")] if kept is not None else [])
            for last, price, edit in ends:
                found[first, last] = min(found.get((first, last), (FAR, "")), (cost + price, audit + edit))
            state, audit, cost = ONWARD[state], audit + "I", cost + INSERT_COST
    return found


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, rank, via) of one transfer matrix after another, for arrays of matrices [n, 4, 4].

    rank orders the audits that lead from one state by their text. Audits of the same turns from the same state never
    begin one another, as each ends in a turn's own edit; so ranks of the parts decide that of the whole.
    """
    cost = left[0][:, :, :, None] + right[0][:, None, :, :]
    rank = left[1][:, :, :, None].astype(np.int64)
    via = (cost * 8 + rank).argmin(axis=2)
    cost = np.minimum(np.take_along_axis(cost, via[:, :, None, :], 2)[:, :, 0], FAR)
    order = np.take_along_axis(left[1], via, 2).astype(np.int64) * 4 + np.take_along_axis(right[1], via, 1)
    order += np.where(cost >= FAR, 1 << 20, 0) + np.arange(4) * 0
    return cost, order.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable").astype(np.int8), via.astype(np.int8)


class Grammar:
    """Rules (left, right) of two symbols each, with the transfer matrix and the audit rope of every symbol."""

    def __init__(self, rounds: list[list[tuple[int, int]]]):
        self.rounds, self._text = rounds, {}
        leaves = [_leaf(symbol) for symbol in range(LEAVES)]
        cost, rank = np.full((LEAVES, 4, 4), FAR, dtype=np.int64), np.zeros((LEAVES, 4, 4), dtype=np.int8)
        for symbol, found in enumerate(leaves):
            for (first, last), (price, audit) in found.items():
                cost[symbol, first, last] = price
                self._text[symbol, first, last] = audit
            for first in range(4):
                order = sorted(range(4), key=lambda last: (cost[symbol, first, last] >= FAR, found.get((first, last), (0, ""))[1]))  # noqa: B023
                rank[symbol, first, order] = range(4)
        via, self.parts = np.zeros((LEAVES, 4, 4), dtype=np.int8), [(0, 0)] * LEAVES
        for rules in rounds:  # bottom-up: a rule's parts are older
            if rules:
                a, b = (np.array(side) for side in zip(*rules, strict=True))
                made = product((cost[a], rank[a]), (cost[b], rank[b]))
                cost, rank, via = (np.concatenate(pair) for pair in zip((cost, rank, via), made, strict=True))
                self.parts += rules
        self.cost, self.rank, self.via = cost, rank, via

    def audit(self, symbol: int, first: int, last: int) -> str:
        """The edits of a symbol between two states, put together from its parts' at the first time."""
        key = symbol, first, last
        if key not in self._text:
            (a, b), middle = self.parts[symbol], int(self.via[key])
            self._text[key] = self.audit(a, first, middle) + self.audit(b, middle, last)
        return self._text[key]

    def compressed(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of several rows with all rules applied, round by round."""
        made = LEAVES
        for rules in self.rounds:
            table = np.full((made, made), -1, dtype=np.int32)
            for number, pair in enumerate(rules):
                table[pair] = made + number
            made += len(rules)
            if len(symbols) < 2:
                continue
            hit = np.append(table[symbols[:-1], symbols[1:]], -1)
            hit[:-1][rows[:-1] != rows[1:]] = -1
            # of overlapping pairs of one symbol, every other one from the left
            fresh = np.ones(len(symbols), dtype=bool)
            fresh[1:] = (symbols[1:] != symbols[:-1]) | (rows[1:] != rows[:-1])
            start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            twin = np.append((symbols[1:] == symbols[:-1]), False) & ((np.arange(len(symbols)) - start) % 2 == 1)
            hit[twin] = -1
            gone = np.append(False, hit[:-1] >= 0)
            symbols, rows = np.where(hit >= 0, hit, symbols)[~gone], rows[~gone]
        return symbols, rows

    def matrices(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(cost, rank) [n, 4, 4] of whole symbol texts (none empty): neighbours are multiplied until one is left."""
        symbols, rows = self.compressed(*flat(texts))
        cost, rank = self.cost[symbols], self.rank[symbols]
        while len(rows) > len(texts):
            counts = np.bincount(rows, minlength=len(texts))
            at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            left = np.flatnonzero((at % 2 == 0) & (at + 1 < counts[rows]))
            made = product((cost[left], rank[left]), (cost[left + 1], rank[left + 1]))
            cost[left], rank[left] = made[0], made[1]
            stays = at % 2 == 0
            cost, rank, rows = cost[stays], rank[stays], rows[stays]
        return cost, rank

    def edits(self, text: bytes, first: int, last: int) -> str:
        """The cheapest edits of a whole symbol text between two states, the least in order of those."""
        symbols, _ = self.compressed(*flat([text]))
        states = path([(self.cost[s], self.rank[s]) for s in symbols], first, last)
        return "".join(self.audit(int(s), a, b) for s, a, b in zip(symbols, states[:-1], states[1:], strict=True))


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several texts, and the text of each."""
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.int32), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def path(matrices: list[tuple[np.ndarray, np.ndarray]], first: int, last: int) -> list[int]:
    """The states between ``matrices`` on the cheapest way from ``first`` to ``last``."""
    cost, rank, back = [FAR] * 4, [0] * 4, []
    cost[first] = 0
    for price, order in matrices:
        price, order = price.tolist(), order.tolist()
        best = [min((cost[k] + price[k][j], rank[k], k) for k in range(4)) for j in range(4)]
        back.append([b[2] for b in best])
        cost = [min(FAR, b[0]) for b in best]
        where = sorted(range(4), key=lambda j: (cost[j] >= FAR, best[j][1], order[best[j][2]][j]))  # noqa: B023
        rank = [where.index(j) for j in range(4)]
    states = [last]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def shared_grammar(segments: DataFrame, rounds: int = 12, per_round: int = 64) -> Grammar:
    """Re-Pair rules over all ``segments`` (symbols): in each round the most frequent pairs become symbols.

    Equal segments are counted once, with their number. A round's pairs are taken by frequency, most frequent first,
    as long as none begins with a symbol in which another ends, so that they never overlap. The driver gets no more
    than ``per_round`` pairs a round; what no rule covers is multiplied out where it stands.
    """
    counted = cut(segments.groupBy("symbols").agg(F.count("*").alias("n")))
    made: list[list[tuple[int, int]]] = []
    for _ in range(rounds):
        grammar = Grammar(made)

        def pairs(batches: Iterator[pa.RecordBatch], grammar: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            size = len(grammar.parts)
            for batch in batches:
                symbols, rows = grammar.compressed(*flat(batch.column(0).to_pylist()))
                inside = np.flatnonzero(rows[1:] == rows[:-1])
                weight = batch.column(1).to_numpy()[rows[inside]]
                pair, place = np.unique(symbols[inside] * size + symbols[inside + 1], return_inverse=True)
                total = np.bincount(place, weights=weight, minlength=len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair // size, pa.int32()), pa.array(pair % size, pa.int32()), pa.array(total)], ["a", "b", "n"])

        found = counted.mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")
        begins, ends, twins, rules = set(), set(), set(), []
        for a, b, _ in found.orderBy(F.desc("n"), "a", "b").limit(per_round).collect():
            if a in ends | twins or b in begins | twins or (a == b and a in begins | ends):
                continue
            rules.append((a, b))
            if a == b:
                twins.add(a)
            else:
                begins.add(a)
                ends.add(b)
        if not rules:
            break
        made.append(rules)
    return Grammar(made)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with damage decided by crc32(`conv_id:turn`) % 20.

    0 drops a row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats the row, 4 gives it the role user. Null
    roles and texts are one space, and so is a null conv_id or turn where it is hashed.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _named(turns: DataFrame) -> DataFrame:
    """Turns with conv (conv_id as text, empty for null), digest (of role and text) and what shows of their faults."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("*", digest.alias("digest"), F.left("text", F.lit(32)).alias("head"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))


ORDER = ["conv", "turn", "role", "head", "digest"]


def segments(turns: DataFrame, size: int = 1024) -> DataFrame:
    """Every conversation's turns in order, in pieces of at most ``size``: symbols and counts of faults.

    Rows are ordered by turn, nulls first (ties: role, the text's first 32 characters, digest). Equal rows are counted
    before they are dealt, and a role and text's first turn comes from an aggregation, so that neither a conversation
    nor a repeated row gathers in one task; ranges of the order are. (conv, part, seq) orders the pieces.
    """
    rows = _named(turns)
    rows = rows.groupBy(*ORDER, "blank", "truncated").agg(F.count("*").alias("n"))
    first = rows.filter(~F.col("blank")).groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("first"))
    rows = rows.join(first, ["conv", "digest"], "left").withColumn("again", F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)))
    rows = rows.select(*ORDER, "blank", "again", "truncated", "n").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        now: dict = {}

        def close() -> None:
            nonlocal seq
            if now:
                out.append({**now, "symbols": bytes(now["symbols"]), "part": part, "seq": seq})
                seq += 1

        for batch in batches:
            for row in batch.to_pylist():
                turn, initial = row["turn"], row["role"][:1]
                symbol = INITIALS.get(initial, OTHER) + (TRUNCATED if row["truncated"] else 0)
                for copy in range(row["n"]):
                    if not now or now["conv"] != row["conv"] or len(now["symbols"]) >= size:
                        close()
                        now = {"conv": row["conv"], "symbols": bytearray(), "roles": [], "digests": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": initial, "from_turn": turn, "n_turns": 0, "min_turn": turn}
                        fresh = True
                    else:
                        fresh = False
                        now["illegal"] += (now["last_initial"] + initial) not in ("su", "ua", "au")
                    if turn is not None:
                        now["n_turns"] += fresh or now["to_turn"] != turn
                        now["min_turn"] = turn if now["min_turn"] is None else now["min_turn"]
                    now["last_initial"], now["to_turn"] = initial, turn
                    again = row["again"] or copy > 0
                    gone = row["blank"] or again
                    now["blank"] += row["blank"]
                    now["duplicate"] += again and not row["blank"]
                    now["truncated"] += row["truncated"] and not gone
                    now["symbols"].append(GONE if gone else symbol)
                    now["roles"].append(None if gone else row["role"])
                    now["digests"].append(None if gone else row["digest"])
                if len(out) >= 200:
                    yield pa.RecordBatch.from_pylist(out, made)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, made)

    number = pa.int64()
    made = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", number), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("blank", number), ("duplicate", number), ("truncated", number), ("illegal", number), ("initial", pa.string()), ("last_initial", pa.string()), ("from_turn", number), ("to_turn", number), ("n_turns", number), ("min_turn", number)])
    pieces = rows.mapInArrow(piece, "conv string, part int, seq long, symbols binary, roles array<string>, digests array<binary>, blank long, duplicate long, truncated long, illegal long, initial string, last_initial string, from_turn long, to_turn long, n_turns long, min_turn long")
    order = Window.partitionBy("conv").orderBy("part", "seq")
    pieces = pieces.withColumn("at", F.row_number().over(order).cast("long") - 1).withColumn("before", F.lag(F.struct("last_initial", "to_turn")).over(order))
    joined = F.concat(F.col("before.last_initial"), F.col("initial")).isin("su", "ua", "au")
    illegal = F.col("illegal") + F.when(F.col("before").isNull() | joined, 0).otherwise(1)
    shared = F.col("before").isNotNull() & (F.col("before.to_turn") == F.col("from_turn"))
    return cut(pieces.withColumn("illegal", illegal).withColumn("n_turns", F.col("n_turns") - F.coalesce(shared, F.lit(False)).cast("long")).drop("before", "part", "seq", "initial", "last_initial", "from_turn"))


NODE = "conv string, at long, cost array<long>, rank array<tinyint>"


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * 16), pa.array(values.reshape(-1), kind))


def _solved(pieces: DataFrame, grammar: Grammar, fan: int) -> tuple[DataFrame, DataFrame]:
    """(ends, roots): first and last state of every piece, and the cost, last state and closing turns of every conversation.

    Matrices of neighbouring pieces are multiplied, ``fan`` at a time, until a conversation has one; its cheapest end
    is chosen there and the states between the pieces are found on the way back down.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, place = np.unique(np.array(batch.column(2).to_pylist(), dtype=object), return_inverse=True)
            if batch.num_rows:
                cost, rank = grammar.matrices(list(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _array(cost[place], pa.int64()), _array(rank[place], pa.int8())], ["conv", "at", "cost", "rank"])

    def matrices(children: list) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.array(c["cost"]).reshape(4, 4), np.array(c["rank"], dtype=np.int8).reshape(4, 4)) for c in children]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, rank = [], []
            for children in batch.column(2).to_pylist():
                whole, *others = matrices(children)
                for other in others:
                    made = product((whole[0][None], whole[1][None]), (other[0][None], other[1][None]))
                    whole = made[0][0], made[1][0]
                cost.append(whole[0])
                rank.append(whole[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _array(np.array(cost), pa.int64()), _array(np.array(rank), pa.int8())], ["conv", "at", "cost", "rank"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for cost, rank in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                best.append(min((cost[j] + INSERT_COST * len(CLOSING[j]), rank[j], j) for j in range(4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int32())], ["conv", "cost", "last"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, first, last, children in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                states = path(matrices(children), first, last)
                out += [(conv, child["at"], a, b) for child, a, b in zip(children, states[:-1], states[1:], strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["conv", "at", "first", "last"])

    nodes = cut(pieces.select("conv", "at", "symbols").mapInArrow(leaves, NODE))
    most, levels = nodes.agg(F.max("at")).first()[0] or 0, []
    while most:
        families = nodes.groupBy("conv", (F.col("at") - F.col("at") % fan).alias("from")).agg(F.array_sort(F.collect_list(F.struct("at", "cost", "rank"))).alias("children"))
        families = cut(families.select("conv", (F.col("from") / fan).cast("long").alias("at"), "children"))
        levels.append(families)
        nodes, most = families.mapInArrow(multiplied, NODE), most // fan
    roots = cut(nodes.mapInArrow(rooted, "conv string, cost long, last int"))
    ends = roots.select("conv", F.lit(0).cast("long").alias("at"), F.lit(START).alias("first"), "last")
    for families in reversed(levels):
        ends = families.join(ends, ["conv", "at"]).select("conv", "first", "last", "children").mapInArrow(opened, "conv string, at long, first int, last int")
    return ends, roots


def repair(turns: DataFrame, size: int = 1024, fan: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, audits, repaired) of ``turns`` (conv_id, turn, role, text): what is wrong, the edits, the result.

    conversations: conv, gaps, blank, duplicate, truncated, illegal, cost. audits: conv, at, audit, the pieces of a
    conversation's audit in order. repaired: conv, at, place, role, text, the turns after the edits in order.

    A turn's first fault counts: blank (nothing but space), duplicate (role and text seen earlier in the conversation),
    truncated (does not end in one of `.!?`). Keeping a turn costs 0, giving it the role user or assistant 1, deleting
    it 2 (the only edit for blank and duplicate ones), inserting an empty user or assistant turn 5; a truncated turn
    that stays costs 5 more. The edits are the cheapest ones after which the roles' initials are `(s?(ua)+)?`, the
    least in ASCII order of those; an empty role is like any other that the grammar does not know.

    Turns become symbols, pieces of conversations texts over nine symbols, and one Re-Pair grammar covers the pieces
    of all conversations. Each rule has a 4 by 4 matrix of costs between the grammar's states and a rope of its edits;
    both are made once, from the rule's two parts, and serve every conversation.

    Null roles and texts count as one space, null turns come first, rows of a null conv_id form one conversation, and
    other columns are ignored. Rows are never gathered by conversation: pieces hold at most ``size`` turns, and at most
    ``fan`` pieces meet at a time.
    """
    pieces = segments(turns, size)
    grammar = shared_grammar(pieces)
    ends, roots = _solved(pieces, grammar, fan)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for batch in batches:
            out = []
            for conv, at, symbols, roles, digests, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = symbols, first, last
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = grammar.edits(*key)
                said, state, turn = [], first, 0
                for edit in known[key]:
                    if edit == "I":
                        state = ONWARD[state]
                        said.append((len(said), ROLE[state], None))
                        continue
                    if edit == "R":
                        state = ONWARD[state]
                        said.append((len(said), ROLE[state], digests[turn]))
                    elif edit == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[turn][0]]
                        said.append((len(said), roles[turn], digests[turn]))
                    turn += 1
                out.append({"conv": conv, "at": at, "audit": known[key], "said": [{"place": p, "role": r, "digest": d} for p, r, d in said]})
            yield pa.RecordBatch.from_pylist(out, made)

    said = pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string()), ("digest", pa.binary())]))
    made = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("audit", pa.string()), ("said", said)])
    met = pieces.select("conv", "at", "symbols", "roles", "digests").join(ends, ["conv", "at"])
    told = cut(met.mapInArrow(edited, "conv string, at long, audit string, said array<struct<place:int,role:string,digest:binary>>"))

    last = F.lit((1 << 62)).alias("at")
    closing = F.create_map(*[x for state, turns in CLOSING.items() for x in (F.lit(state), F.array(*[F.lit(ROLE[t]) for t in turns]).cast("array<string>"))])
    closed = roots.select("conv", closing[F.col("last")].alias("roles")).filter(F.size("roles") > 0)
    audits = told.select("conv", "at", "audit").union(closed.select("conv", last, F.repeat(F.lit("I"), F.size("roles"))))
    items = told.select("conv", "at", F.inline("said"))
    texts = _named(turns).groupBy("conv", "digest").agg(F.first("text").alias("text"))
    kept = items.filter(F.col("digest").isNotNull()).join(texts, ["conv", "digest"]).select("conv", "at", "place", "role", "text")
    empty = items.filter(F.col("digest").isNull()).select("conv", "at", "place", "role", F.lit("").alias("text"))
    ending = closed.select("conv", last, F.posexplode("roles").alias("place", "role")).withColumn("text", F.lit(""))
    counts = pieces.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")], F.min("min_turn").alias("low"), F.max("to_turn").alias("high"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
    return counts.join(roots, "conv").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost"), audits, kept.union(empty).union(ending)


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): digest of each conversation's `role:text` lines, read in order as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield made(out)
        if state is not None:
            yield made([(key, state.hexdigest())])

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], ["conv", "repaired_sha256"])

    rows = repaired.repartition("conv").sortWithinPartitions("conv", "at", "place")
    return rows.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def repair_digests(conversations: DataFrame, damaged: DataFrame, **options: int) -> DataFrame:
    """One row for every conv_id of ``conversations``: faults, cost, audit and digest of the repair of ``damaged``.

    A conversation without rows in ``damaged`` has zeros, an empty audit and the digest of the empty string.
    """
    counts, audits, repaired = repair(damaged, **options)
    audits = audits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"))  # as long as the result
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv")).distinct()
    parts = [ids, counts, audits, _digests(repaired)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    whole = whole.groupBy("conv").agg(*[F.coalesce(F.max(c), zero).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256"))
    return whole.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), *numbers, "audit", "repaired_sha256")
