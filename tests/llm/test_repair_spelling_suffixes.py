"""Conversation repair, spelling variants and suffix deduplication against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from symloom.llm import spelling, suffix_dedup, turn_repair

SPACE = " \t\n\x0b\x0c\r"
FACTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(ids, rows):
    """Turn by turn, the least (cost, audit) up to each state."""
    talks, out = defaultdict(list), set()
    onward, names = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    for row in rows:
        talks[row[0]].append(row)
    for conv in ids:
        talk = sorted(talks[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in talk:
            end = text.rstrip(SPACE)[-1:]
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in talk if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(talk, talk[1:], strict=False)]
        best = {0: (0, "", ())}

        def put(states, state, *way):
            states[state] = min(states.get(state, (1 << 60, "")), way)

        def insert():
            for state in (0, 1, 2, 3, 2, 3):
                if state in best:  # noqa: B023
                    cost, audit, said = best[state]  # noqa: B023
                    put(best, onward[state], cost + 5, audit + "I", said + (names[onward[state]] + ":",))  # noqa: B023

        for (_, _, role, text), fault in zip(talk, faults, strict=True):
            insert()
            new, extra = {}, 5 if fault == "t" else 0
            for state, (cost, audit, said) in best.items():
                put(new, state, cost + 2, audit + "D", said)
                if fault not in ("b", "d"):
                    put(new, onward[state], cost + 1 + extra, audit + "R", said + (f"{names[onward[state]]}:{text}",))
                    if (role[:1], state) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                        put(new, {"s": 1, "u": 2, "a": 3}[role[:1]], cost + extra, audit + "K", said + (f"{role}:{text}",))
            best = new
        insert()
        cost, audit, said = min(best[s] for s in (0, 3) if s in best)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.add((conv, gaps, *[faults.count(f) for f in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return out


@pytest.fixture(scope="module")
def talks():
    r, rows = random.Random(3), []
    for conv in [None, *range(40)]:
        for k in range(300 if conv == 7 else r.choice([1, 2, 3, 5, 8, 40])):
            role = r.choice(["user", "assistant", "system", "tool", None, "", "User", "u"])
            rows.append((conv, r.choice([None, k, k, k, r.randint(0, 50)]), role, r.choice([None, "", " \t", "ok.", "no", "why? ", "a%d." % k, "b%d" % k, "é!", "long " * 3000])))
    return rows + rows[:20] + rows[5:6] * 40


@pytest.mark.parametrize("options", [{}, {"size": 3, "fan": 2}])
def test_repair(spark, talks, options):
    df = spark.createDataFrame(talks, TURNS).repartition(3).selectExpr("*", "'x' AS conv", "1 AS at", "2 AS digest", "3 AS n", "4 AS h", "5 AS copy")
    got = {tuple(r[c] for c in FACTS) for r in turn_repair.repair_digests(df, turn_repair.damage(df), **options).collect()}
    assert got == plain_repair({r[0] for r in talks}, plain_damage(talks))


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_digests(empty, turn_repair.damage(empty)).count() == 0
    lost = spark.createDataFrame([(5, 0, "user", "a.")], TURNS)
    assert [tuple(r[c] for c in FACTS) for r in turn_repair.repair_digests(lost, empty).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_rules_equal_their_parts():
    """Matrices and ropes of rules are those of the turns they stand for."""
    grammar = turn_repair.Grammar([[(1, 2)], [(9, 9), (8, 0)], [(10, 11)]])
    whole = grammar.compressed(np.array([1, 2, 1, 2, 8, 0, 1]), np.zeros(7, dtype=int))[0]
    assert whole.tolist() == [12, 1]
    for first in range(4):
        for last in range(4):
            states = turn_repair.path([(grammar.cost[s], grammar.rank[s]) for s in (1, 2, 1, 2, 8, 0)], first, last)
            if grammar.cost[12, first, last] < turn_repair.FAR:
                assert grammar.audit(12, first, last) == "".join(grammar.audit(s, a, b) for s, a, b in zip((1, 2, 1, 2, 8, 0), states[:-1], states[1:], strict=True))


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_forms(words):
    out = set()
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    usual = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        usual[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while usual[root]:
            root = usual[root]
        out.add((w, usual[w], root, words[w], len(near[w]), words[usual[w]] if usual[w] else None))
    return out


@pytest.fixture(scope="module")
def word_docs():
    r = random.Random(4)
    base = ["".join(r.choice("aeioustnÉéß") for _ in range(r.randint(6, 12))) for _ in range(40)]
    words = []
    for k, w in enumerate(base):
        words += [w] * (3 ** (k % 6))
        for _ in range(4):
            i = r.randrange(len(w))
            words += [w[:i] + r.choice(["", "a", "Z", w[i] * 2]) + w[i + 1 :]] * r.choice([1, 2, 3])
    giant = "".join(r.choice("abc") for _ in range(3000))
    words += [giant, giant, giant[:1500] + "z" + giant[1500:], giant[:1500] + "z" + giant[1500:], giant[1:], giant[1:]]
    edge = giant[:64]
    words += [edge] * 30 + [edge + "q"] * 2 + [edge[:63]] * 2 + [edge[:10] + "y" + edge[11:]] * 2 + ["aaaaaaaa"] * 2 + ["aaaaaaa"] * 40
    words += ["oneword"] * 3000 + ["oneworde"] * 180 + ["onewordee"] * 12
    r.shuffle(words)
    rows = [(i, " ".join(words[i::50]) + "\n1x") for i in range(50)]
    return rows + [(None, None), (3, ""), (None, "no number here"), (7, None), rows[2], rows[2]]


def test_spelling(spark, word_docs):
    docs = spark.createDataFrame(word_docs, "doc_id long, text string").repartition(3).selectExpr("*", "'x' AS word", "1 AS n", "2 AS key", "'y' AS run", "3 AS h")
    counts = spelling.word_counts(docs)
    want = plain_counts(word_docs)
    assert {r.word: r.n for r in counts.collect()} == want
    forms = plain_forms(want)
    assert any(f[1] and f[2] != f[1] for f in forms)
    for symbols in (None, 2, 9):
        assert Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_forms(counts, symbols=symbols).collect()) == Counter(forms)
    assert spelling.spelling_forms(spelling.word_counts(docs.limit(0))).count() == 0


def plain_bytes(rows, depth):
    raw = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(b[i : i + depth] for _, b in raw for i in range(len(b) - depth + 1))
    out = Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if n[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def byte_docs(rows):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(90), text(45)[:199]
    out = [(d, t) for d, t, *_ in rows]
    out += [(1000 + i, text(r.randint(5, 60)) + passage + text(r.randint(0, 50))) for i in range(12)]
    out += [(1100 + i, text(20) + line + text(20)) for i in range(3)]
    out += [(1200, "a" * 1000), (1201, "b" * 200), (1202, "b" * 199), (1203, "ab" * 300 + text(50)), (1204, (text(8) + "\n") * 1 + (passage[:150] + "\n") * 6)]
    near = text(300)
    out += [(1300 + i, near[: 200 * i] + "X" + near[200 * i + 1 :]) for i in range(6)]
    return out


@pytest.mark.parametrize("bucket", [1 << 14, 150])
def test_suffix_dedup(spark, byte_docs, bucket):
    docs = spark.createDataFrame(byte_docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS row", "2 AS digit", "3 AS n", "4 AS first", "5 AS n_bytes")
    got = suffix_dedup.remove_repeated_bytes(docs, bucket=bucket)
    found = got.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == plain_bytes(byte_docs, 200)
    assert all(hashlib.sha256(zlib.decompress(r.kept)).hexdigest() == r.kept_sha256 for r in found if r.n_removed)
    assert all(r.kept is None for r in found if not r.n_removed)


def test_suffix_dedup_of_nothing(spark, docs):
    assert suffix_dedup.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_sorted_groups():
    r = random.Random(7)
    texts = ["".join(r.choice("ab") for _ in range(6)) for _ in range(60)]
    digits = [lambda p, d=d: np.array([ord(texts[i][d]) for i in p], dtype=np.uint64) for d in range(6)]
    place, group = suffix_dedup.sorted_groups(np.zeros(60, dtype=int), digits)
    count = Counter(texts)
    assert sorted(place) == [i for i in range(60) if count[texts[i]] > 1]
    assert [texts[i] for i in place] == sorted(texts[i] for i in place)
    assert len(set(group)) == sum(n > 1 for n in count.values())
