"""Repair of damaged conversations by a dynamic program that is shared over a trie of their signatures.

1. Every row's first fault is found while the rows of a conversation pass by in order; the conversation's signature has one
   letter per row, for its role and what its fault asks of it.
2. Equal signatures are one.  They are dealt to ranges and sorted, so that each task walks a part of the trie of all signatures in
   depth-first order: only the path to the current signature is held.  A layer of the dynamic program belongs to a node of the
   trie and is computed once for all signatures that share this prefix; a signature's answer is emitted at its terminal node.
3. Answers are joined back to the conversations, and the edits are applied to their rows while these pass by again.

A layer holds, for each state of the grammar, the least cost, the edits of the last row and the state before, and how the audits
of its states are ordered.  Audits of one layer hold one row edit per row and end with one, so none is the beginning of another, and
their order needs no look at their text: a layer is of constant size, however long the conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import settle

#: Signature letters: a row that must go, then rows by role (system, user, assistant, another), whole and truncated.
MUST_GO = "x"
WHOLE, TRUNCATED = "suao", "SUAO"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing yet, after system, after user, after assistant.  What may come next, and the state after that.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that an inserted or rewritten row gets in a state, and the state after that.
FILL = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: A layer: per state None or (cost, order among the layer's audits, state before, edits of this row).
FIRST_LAYER = ((0, 0, START, ""), None, None, None)

ROWS = "conv_id long, turn long, role string, text string, n int, copy int"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def row_edits(state: int, letter: str) -> Iterator[tuple[int, int, str]]:
    """(cost, state after, edits) of the ways in which a row can be handled, rows inserted before it included."""
    cost, edits = 0, ""
    for _ in range(3):
        yield cost + DELETE, state, edits + "D"
        if letter != MUST_GO:
            more = CUT if letter.isupper() else 0
            after = NEXT[state].get(letter.lower())
            if after is not None:
                yield cost + more, after, edits + "K"
            yield cost + more + REROLE, FILL[state], edits + "R"
        cost, edits, state = cost + INSERT, edits + "I", FILL[state]


def next_layer(layer, letter: str):
    """The layer of a child node."""
    best: list = [None] * 4
    for before, cell in enumerate(layer):
        if cell is not None:
            for cost, after, edits in row_edits(before, letter):
                found = (cell[0] + cost, cell[1], edits, before)
                if best[after] is None or found < best[after]:
                    best[after] = found
    order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b is not None)
    place = {s: i for i, (_, _, s) in enumerate(order)}
    return tuple(None if b is None else (b[0], place[s], b[3], b[2]) for s, b in enumerate(best))


def answer(path: list) -> tuple[int, str]:
    """(cost, audit) at a terminal node, from the layers on the path to it."""
    ends = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
    last = path[-1]
    cost, _, edits, state = min((c[0] + ends[s][0], c[1], ends[s][1], s) for s, c in enumerate(last) if c is not None)
    out = [edits]
    for layer in reversed(path[1:]):
        _, _, before, edits = layer[state]
        out.append(edits)
        state = before
    return cost, "".join(reversed(out))


def trie_answers(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures; each shared prefix is computed once."""
    path, last = [FIRST_LAYER], ""
    for signature in signatures:
        shared = _common(last, signature)
        del path[shared + 1 :]
        for letter in signature[shared:]:
            path.append(next_layer(path[-1], letter))
        last = signature
        yield signature, *answer(path)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after damage by CRC-32 of ``conv_id:turn``; a null counts as one space there, and as role or text.

    ``n`` is 0 for a row that is gone (it is kept as a mark of its conversation), ``copy`` tells repeated rows apart.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("n", (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int"))
    text = F.when(F.col("n") <= 1, "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "n", copies)


class Conversation:
    """What is known of a conversation while its rows pass by: counters, its letters, and a digest of each row seen."""

    def __init__(self):
        self.letters, self.seen, self.before = [], set(), None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str):
        if turn is not None:  # turns come in order
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        said = text.rstrip(" \t\n\v\f\r")
        letter = WHOLE["sua".find(initial)] if initial else "o"
        if not said:
            self.blank += 1
            letter = MUST_GO
        elif digest in self.seen:
            self.duplicate += 1
            letter = MUST_GO
        elif said[-1] not in ".!?":
            self.truncated += 1
            letter = letter.upper()
        self.seen.add(digest)
        self.letters.append(letter)

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


_COUNT_NAMES = [x.split()[0] for x in COUNTS.split(", ")]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


_LONGS = [(n, pa.int64()) for n in _COUNT_NAMES]
SIGNED = pa.schema([("conv_id", pa.int64()), *_LONGS, ("signature", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), *_LONGS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _signed(batches):
    def rows():
        now, it = None, None
        for conv, turn, role, text, n in _tuples(batches, "conv_id", "turn", "role", "text", "n"):
            if it is None or conv != now:
                if it is not None:
                    yield now, *it.counts(), "".join(it.letters)
                now, it = conv, Conversation()
            if n:
                it.add(turn, role, text)
        if it is not None:
            yield now, *it.counts(), "".join(it.letters)

    return _batches(rows(), SIGNED)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, in the order of turns (null first); rows of one turn stand by role and text, copies side by side."""
    first = [F.asc_nulls_first(c) for c in ("conv_id", "turn")]
    return rows.repartition("conv_id").sortWithinPartitions(*first, "role", "text", "copy")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, counters, signature) of each conversation of ``damaged`` rows; all 0 and empty where no row is left."""
    return in_order(rows).mapInArrow(_signed, f"conv_id long, {COUNTS}, signature string")


def _walked(batches):
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    return _batches(trie_answers(s for (s,) in _tuples(batches, "signature")), schema)


def answers(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, from range-sorted walks of their trie."""
    distinct = settle(signed.select("signature").distinct(), "signatures")
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_walked, "signature string, cost long, audit string")


class _Repair:
    """Applies an audit to the rows of a conversation as they pass by; the repaired text is hashed, not held."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.some = audit, 0, START, hashlib.sha256(), False

    def put(self, role: str, text: str):
        self.digest.update(f"{chr(10) * self.some}{role}:{text}".encode())
        self.some = True

    def fill(self, text: str = ""):
        self.state = FILL[self.state]
        self.put(NAMES[self.state], text)

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.fill()

    def row(self, role: str, text: str):
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.fill(text)

    def done(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _repaired(batches):
    def rows():
        head, repair = None, None
        for *row, audit in _tuples(batches, "conv_id", "role", "text", *_COUNT_NAMES, "cost", "audit"):
            if audit is not None:
                if head is not None:
                    yield *head, repair.done()
                head, repair = (row[0], *row[3:], audit), _Repair(audit)
            else:
                repair.row(row[1], row[2])
        if head is not None:
            yield *head, repair.done()

    return _batches(rows(), REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of (conv_id, turn, role, text).

    The rows are damaged first (``damaged``) and repaired then.  A null conv_id is a conversation too.  Where no row is left after
    damage, all numbers are 0, the audit is empty and the hash that of an empty text.  Rows of one turn stand by role and text.  A role is told
    by its first letter; a role without one, or with another one than s, u and a, can only be rewritten or deleted.
    Rows pass by one at a time: of a conversation only a digest per row and the audit are held.
    """
    rows = damaged(conversations)
    signed = settle(signatures(rows), "signed")
    solved = settle(answers(signed), "answers")
    heads = signed.join(solved, "signature").select("conv_id", *_COUNT_NAMES, "cost", "audit")
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), F.lit(-1).alias("copy"), *_COUNT_NAMES, "cost", "audit")
    body = rows.where("n > 0").select("conv_id", "turn", "role", "text", "copy", *[none("long").alias(c) for c in (*_COUNT_NAMES, "cost")], none("string").alias("audit"))
    first = [F.asc_nulls_first(c) for c in ("conv_id", "turn")]
    both = heads.union(body).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_last("audit"), *first[1:], "role", "text", "copy")
    return both.mapInArrow(_repaired, f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``repair``: whole audits are carried per state, as eight digits of cost and the edits."""
    from speechlake.llm.resampling import sql_crc32

    more = lambda key, cost, edits: f"(lpad((substr({key}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({key}, 9) || '{edits}')"
    states = range(4)
    # what insertions can do before a row or at the end, from each state
    spread = {START: [(START, 0, ""), (USER, 5, "I"), (ASSISTANT, 10, "II")], SYSTEM: [(SYSTEM, 0, ""), (USER, 5, "I"), (ASSISTANT, 10, "II")], USER: [(USER, 0, ""), (ASSISTANT, 5, "I")], ASSISTANT: [(ASSISTANT, 0, ""), (USER, 5, "I")]}
    cells: dict[int, list[str]] = {s: [] for s in states}
    for a in states:
        for b, cost, edits in spread[a]:
            key = f"a.keys[{a + 1}]"
            cells[b].append(more(key, cost + 2, edits + "D"))
            cut = "(5 * (x.fault = 'truncated')::INT)"
            for initial, c in {"s": [(START, "s", SYSTEM)], "u": [(START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER)], "a": [(USER, "a", ASSISTANT)]}.items():
                for state, letter, after in c:
                    if state == b and letter == initial:
                        cells[after].append(f"CASE WHEN x.fault IN ('none', 'truncated') AND x.initial = '{initial}' THEN {more(key, f'{cost} + {cut}', edits + 'K')} END")
            after = ASSISTANT if b == USER else USER
            cells[after].append(f"CASE WHEN x.fault IN ('none', 'truncated') THEN {more(key, f'{cost} + 1 + {cut}', edits + 'R')} END")
    step = "[" + ", ".join(f"least({', '.join(cells[s])})" for s in states) + "]"
    final = f"least(r.keys[1], {more('r.keys[2]', 10, 'II')}, {more('r.keys[3]', 5, 'I')}, r.keys[4])"
    code = f"{sql_crc32('id')} % 20"
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
n AS (SELECT *, {code} AS n FROM c),
d AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN n = 3 THEN 2 ELSE 1 END)) AS copy FROM n WHERE n > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, role[1:1] AS initial FROM d),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN said[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
r AS (SELECT conv_id, 0::BIGINT AS i, ['00000000', NULL, NULL, NULL]::VARCHAR[] AS keys, count(f.i)::BIGINT AS many FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id
      UNION ALL SELECT a.conv_id, x.i, {step}, a.many FROM r a JOIN f x ON x.conv_id = a.conv_id AND x.i = a.i + 1),
best AS (SELECT conv_id, substr(k, 1, 8)::BIGINT AS cost, substr(k, 9) AS audit FROM (SELECT conv_id, {final} AS k FROM r WHERE i = many)),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
placed AS (SELECT conv_id, p, audit[p:p] AS edit, count(*) FILTER (audit[p:p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (audit[p:p] <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place FROM edits),
kept AS (SELECT e.conv_id, p, edit, place, CASE WHEN edit = 'K' THEN f.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, f.initial FROM placed e LEFT JOIN f ON f.conv_id = e.conv_id AND f.i = e.i WHERE edit <> 'D'),
system AS (SELECT conv_id, (max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END)) AS shift FROM kept GROUP BY conv_id),
written AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS sha FROM kept JOIN system USING (conv_id) GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN written w ON w.conv_id = b.conv_id LEFT JOIN counts c ON c.conv_id = b.conv_id"""
