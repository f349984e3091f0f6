import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from speechlake.llm import conversation_repair
from speechlake.llm.conversation_repair import repair, trie_answers

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_edits(rows):
    """(cost, audit, repaired) over all edits; rows: (role, text, fault)."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = []
    for role, text, fault in rows:
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            own += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        choices.append(own)
    for edits in itertools.product(*choices):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for u in extra[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append(("user" if u == "u" else "assistant", ""))
                if i < len(rows):
                    cost, audit = cost + edits[i][0], audit + edits[i][1]
                    out += [edits[i][2]] if edits[i][2] else []
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def brute(table):
    convs = {c: [] for c, *_ in table}
    for c, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        for k in range(0 if n == 0 else 2 if n == 3 else 1):
            convs[c].append((turn, "user" if n == 4 else role, text, k))
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode(), r[3]))
        seen, faults = set(), []
        for _, role, text, _ in rows:
            said = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "none")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, kept = brute_edits([(r[1], r[2], f) for r, f in zip(rows, faults, strict=True)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def test_same_as_all_edits(spark):
    r, table = random.Random(3), []
    texts = ["Yes.", "No!", "open end", "", " \t", None, "é.", "Why? ", "a\nb."]
    for c in [None, *range(150)]:
        for turn in range(r.choice([1, 2, 3, 3, 4])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.5 else ["user", "assistant"][turn % 2]
            table.append((c, r.choice([turn, turn, turn * 2, None, 7]), role, r.choice(texts)))
    table = [x for c in [None, *range(150)] for x in [y for y in table if y[0] == c][:3]]  # three rows, so that all edits can be tried
    got = repair(spark.createDataFrame([(*x, 1) for x in table], SCHEMA + ", audit long"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(table)


def test_shared_prefixes_are_computed_once(monkeypatch):
    r, calls = random.Random(1), []
    signatures = sorted({"".join(r.choices("xsuaoSUAO", k=r.randint(0, 6))) for _ in range(3000)})
    real = conversation_repair.next_layer
    monkeypatch.setattr(conversation_repair, "next_layer", lambda layer, letter: calls.append(letter) or real(layer, letter))
    together = list(trie_answers(iter(signatures)))
    assert len(calls) == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
    assert together == [x for s in signatures for x in trie_answers(iter([s]))]


def test_short_signatures_same_as_all_edits():
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for n in range(3):
        for s in itertools.product("xsuaoSUAO", repeat=n):
            rows = [(role[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "none") for c in s]
            assert list(trie_answers(iter(["".join(s)]))) == [("".join(s), *brute_edits(rows)[:2])]


def test_edge_tables(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(x) for x in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_and_common_conversations(spark):
    """A conversation of many turns, one very long text, and many conversations with one signature."""
    rows = spark.range(0, 30_000).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    many = spark.range(0, 8000).select(F.expr("id div 4").alias("conv_id"), (F.col("id") % 4).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("Same.").alias("text"))
    huge = spark.range(1).select(F.lit(-2).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("long "), 1_000_000).alias("text"))
    got = {x.conv_id: x for x in repair(rows.union(many).union(huge)).collect()}
    long = got[-1]
    kept = [n for n in (zlib.crc32(f"-1:{i}".encode()) % 20 for i in range(30_000)) if n]
    assert len(long.audit.replace("I", "")) == len(kept) + kept.count(3) and long.gaps == 30_000 - len(kept) and len(got) == 2002
    assert got[-2].truncated + got[-2].blank + got[-2].gaps >= 0 and sum(got[i].duplicate for i in range(2000)) > 0
