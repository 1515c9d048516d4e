"""Repair of damaged conversations by a grammar-compressed dynamic program (operator 12).

A conversation is a sequence of symbols, one for each row: role initial and fault. The cheapest edits of a row are a min-plus matrix over
the states of the accepted role order, (s?(ua)+)?. Sequences are compressed by Re-Pair over all conversations at once; the matrix of a
rule is the product of those of its two symbols, so what conversations share is evaluated once. Each entry carries its edits as a rope.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import materialize

#: Rows of a segment at most; longer conversations are several segments, whose matrices are multiplied.
SEGMENT = 256
#: Rules of the grammar at most, rules taken in one round, and uses from which on a pair becomes a rule. Sequences that rules don't cover stay longer.
RULES, ROUND, LEAST = 128, 24, 2
#: Costs of the edits.
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. The role that an inserted or renamed row takes in each, and the one that a kept row needs.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation well from each state.
CLOSING = (0, 2, 1, 0)
ACCEPTED = {("s", "u"), ("u", "a"), ("a", "u")}
_FIRST_RULE = 0xE000
_WORD = r"[^\x20\x09-\x0D]"


class Rope:
    """A string as a tree of parts, written out only where it is compared or read."""

    __slots__ = ("flat", "left", "right")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, flat: str | None = None):
        self.left, self.right, self.flat = left, right, flat

    def __str__(self) -> str:
        if self.flat is None:
            parts, stack = [], [self]
            while stack:
                node = stack.pop()
                if node.flat is None:
                    stack += [node.right, node.left]
                else:
                    parts.append(node.flat)
            self.flat = "".join(parts)
        return self.flat


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


Matrix = list[list[tuple[int, Rope] | None]]


def _better(found: tuple[int, Rope] | None, cost: int, audit: Rope) -> tuple[int, Rope]:
    if found is None or cost < found[0] or cost == found[0] and str(audit) < str(found[1]):
        return cost, audit
    return found


def row_matrix(symbol: str) -> Matrix:
    """The cheapest edits of one row, inserts before it included, from each state to each state."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    role, more = symbol.lower(), CUT_OFF if symbol in "SUAO" else 0
    for start in range(4):
        state = start
        for inserts in range(3):
            before, spent = "I" * inserts, INSERT * inserts
            ends = [(state, DELETE, "D")]
            if symbol not in "BX":
                ends.append((NEXT[state], RENAME + more, "R"))
                if state in KEEPS[role]:
                    ends.append((KEEPS[role][state], more, "K"))
            for end, cost, edit in ends:
                out[start][end] = _better(out[start][end], spent + cost, Rope(flat=before + edit))
            state = NEXT[state]
    return out


def product(first: Matrix, second: Matrix) -> Matrix:
    """Audits of equal cost never begin one another, as both hold an edit for each row and end with a row's, so the least of joined audits is made of least parts."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for k in range(4):
            if (left := first[p][k]) is None:
                continue
            for q in range(4):
                if (right := second[k][q]) is not None:
                    out[p][q] = _better(out[p][q], left[0] + right[0], Rope(left[1], right[1]))
    return out


def evaluate(rules: list[tuple[str, str, str]]) -> dict[str, Matrix]:
    """The matrix of every symbol, rules from the bottom up."""
    known = {s: row_matrix(s) for s in "suaoSUAOBX"}
    for symbol, first, second in rules:
        known[symbol] = product(known[first], known[second])
    return known


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after seeded damage by crc32 of "conv_id:turn" modulo 20; copies is 0 for a dropped row and 2 for a repeated one. Nulls count
    as one space, in the checksum as in role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """One row for each text of a turn: conv_id, turn, role, digest, copies, symbol, fresh (no earlier row has its role and text)."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(~F.col("text").rlike(_WORD), "B").when(F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"), F.upper(known)).otherwise(known)
    rows = rows.where("copies > 0").select("conv_id", "turn", "role", "digest", "copies", symbol.alias("symbol"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.any_value("symbol").alias("symbol"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    return joined.select("conv_id", "turn", "role", "digest", "copies", "symbol", (place == F.col("_first")).alias("fresh"))


def segments(symbols: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of its first row), at (order among those), seq for every run of at most SEGMENT rows of a conversation.

    Rows are dealt by ranges of (conversation, order of rows), so a conversation of very many rows is in many tasks; a segment never crosses tasks.
    """
    n = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = symbols.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, "copies", "symbol", "fresh")
    kinds = [symbols.schema[c].dataType for c in order]
    schema = pa.schema([*[(c, to_arrow_type(k)) for c, k in zip(order, kinds, strict=True)], ("at", pa.int64()), ("seq", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, at, out = None, [], 0, 0, []
        for batch in batches:
            for conv, turn, role, digest, copies, symbol, fresh in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = symbol + (copies - 1) * ("B" if symbol == "B" else "X") if fresh or symbol == "B" else "X" * copies
                while run:
                    if held and (size == SEGMENT or key[0] != conv):
                        out.append((*key, at, "".join(held)))
                        held, size, at = [], 0, at + 1
                    if not held:
                        key = (conv, turn, role, digest)
                    take = run[: SEGMENT - size]
                    held.append(take)
                    size, run = size + len(take), run[len(take) :]
            if len(out) > 4096:
                yield _batch(out, schema)
                out = []
        if held:
            out.append((*key, at, "".join(held)))
        if out:
            yield _batch(out, schema)

    named = ", ".join(f"{c} {k.simpleString()}" for c, k in zip(order, kinds, strict=True))
    return dealt.mapInArrow(cut, f"{named}, at long, seq string")


def compress(sequences: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Re-Pair over the table of distinct sequences (seq, n): (seq, packed) and the rules (symbol, first, second), lower ones first.

    A round counts all neighbouring symbols and takes the most frequent pairs that share no symbol, so none of them changes the count of another. Only these pairs reach
    the driver.
    """
    packed, rules = sequences.withColumn("packed", F.col("seq")), []
    while len(rules) < RULES:
        places = F.sequence(F.lit(1), F.length("packed") - 1)
        pairs = packed.where(F.length("packed") > 1).select("n", F.explode(F.transform(places, lambda i: F.substring("packed", i, F.lit(2)))).alias("pair"))
        top = pairs.groupBy("pair").agg(F.sum("n").alias("uses")).where(F.col("uses") >= LEAST).orderBy(F.desc("uses"), "pair").limit(4 * ROUND).collect()
        taken: set[str] = set()
        before, column = len(rules), F.col("packed")
        for pair in (r["pair"] for r in top):
            if len(rules) < min(RULES, before + ROUND) and not taken & set(pair):
                rules.append((chr(_FIRST_RULE + len(rules)), pair[0], pair[1]))
                taken |= set(pair)
                column = F.replace(column, F.lit(pair), F.lit(rules[-1][0]))
        if len(rules) == before:
            break
        packed = materialize(packed.select("seq", "n", column.alias("packed")), "packed")
    return packed.select("seq", "packed"), rules


def solve(packed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """seq, costs, audits: the matrix of every sequence, row by row; the grammar of at most RULES rules goes to all tasks."""
    known = {s: [[e and (e[0], str(e[1])) for e in row] for row in m] for s, m in evaluate(rules).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = {s: [[e and (e[0], Rope(flat=e[1])) for e in row] for row in m] for s, m in known.items()}
        for batch in batches:
            costs, audits = [], []
            for text in batch.column(1).to_pylist():
                whole = matrices[text[0]]
                for symbol in text[1:]:
                    whole = product(whole, matrices[symbol])
                entries = [e for row in whole for e in row]
                costs.append([e and e[0] for e in entries])
                audits.append([e and str(e[1]) for e in entries])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))], names=["seq", "costs", "audits"])

    return packed.mapInArrow(run, "seq string, costs array<int>, audits array<string>")


def _chain(parts: list[tuple[list, list]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the (costs, audits) of its segments: from the last one back, then along the choices. Where two ways cost the same, their audits
    differ within the segment."""
    best = [INSERT * n for n in CLOSING]
    picks: list[list] = []
    for costs, audits in reversed(parts):
        chosen, totals = [], []
        for p in range(4):
            ways = [(costs[4 * p + q] + best[q], audits[4 * p + q], q) for q in range(4) if costs[4 * p + q] is not None]
            total, audit, q = min(ways)
            totals.append(total)
            chosen.append((audit, q))
        best = totals
        picks.append(chosen)
    state, audit = START, []
    for chosen in reversed(picks):
        audit.append(chosen[state][0])
        state = chosen[state][1]
    return best[START], "".join(audit) + "I" * CLOSING[state]


class _Talk:
    """One conversation while its rows pass by in order: segments first, then rows."""

    def __init__(self, conv_id, write: Callable[[str, str], None]):
        self.conv_id, self.write = conv_id, write
        self.parts: list = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.audit, self.cost, self.at, self.state = "", 0, -1, START
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def segment(self, seq: str, costs: list, audits: list) -> None:
        self.parts.append((costs, audits))
        self.counts["blank"] += seq.count("B")
        self.counts["duplicate"] += seq.count("X")
        self.counts["truncated"] += sum(map(seq.count, "SUAO"))

    def _start(self) -> None:
        if self.at < 0:
            if self.parts:
                self.cost, self.audit = _chain(self.parts)
            self.parts, self.at = [], 0

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.write(ROLES[self.state], "")
            self.at += 1

    def row(self, turn, role: str, text: str, copies: int) -> None:
        self._start()
        initial = role[:1]
        for _ in range(copies):
            if self.initial is not None and (self.initial, initial) not in ACCEPTED:
                self.illegal += 1
            self.initial = initial
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = KEEPS[initial][self.state]
                self.write(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                self.write(ROLES[self.state], text)
        if copies and turn is not None:
            self.turns += turn != self.turn
            self.turn = turn
            self.low, self.high = turn if self.low is None else self.low, turn

    def end(self) -> tuple:
        self._start()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, self.audit)


def _ordered(rows: DataFrame) -> DataFrame:
    """Solved segments and rows of each conversation in one stream: its segments in order, then its rows in order."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    cut = materialize(segments(_symbols(rows)), "segments")
    sequences = materialize(cut.groupBy("seq").agg(F.count("*").alias("n")), "sequences")
    solved = materialize(solve(*compress(sequences)), "solved")
    cut = cut.join(solved, "seq").select("conv_id", F.lit(0).alias("kind"), "turn", "role", "digest", "at", "seq", "costs", "audits", F.lit(0).alias("copies"), F.lit(None).cast("string").alias("text"))
    texts = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("array<int>").alias("costs"),
        F.lit(None).cast("array<string>").alias("audits"), "copies", F.when(F.col("copies") > 0, F.col("text")).alias("text"),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.unionByName(texts).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest", "at")


def _talks(batches: Iterator[pa.RecordBatch], write: Callable[[object, str, str], None], ended: Callable[[tuple], None]) -> Iterator[None]:
    """Passes each kept or new row of every conversation to write and its figures to ended; yields after each batch."""
    talk = None
    for batch in batches:
        for conv, kind, turn, role, _, _, seq, costs, audits, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if talk is None or talk.conv_id != conv:
                if talk:
                    ended(talk.end())
                talk = _Talk(conv, lambda r, t, conv=conv: write(conv, r, t))
            if kind:
                talk.row(turn, role, text, copies)
            else:
                talk.segment(seq, costs, audits)
        yield
    if talk:
        ended(talk.end())
    yield


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of rows (conv_id, turn, role, text, copies).

    Rows of a conversation are taken by turn, null turns first; equal turns by role, then by a digest of the text. A row stands for copies equal rows; one of 0 copies only names its conversation, which then
    may have no rows: zeros, an empty audit and the hash of the empty string. Null roles and texts are one space; rows with a null conv_id are one conversation. An empty table
    gives an empty result; extra columns are left out.

    Rows are cut into segments by ranges, sequences are compressed and solved once each. The last step reads the rows of a conversation in one task, in a stream of which it holds one row, since
    SHA-256 takes bytes in order, and the audit, which is one value of the result.
    """
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = {"hash": hashlib.sha256(), "first": True}

        def write(_, role: str, text: str) -> None:
            state["hash"].update(f"{'' if state['first'] else chr(10)}{role}:{text}".encode())
            state["first"] = False

        def ended(figures: tuple) -> None:
            out.append((*figures, state["hash"].hexdigest()))
            state.update(hash=hashlib.sha256(), first=True)

        for _ in _talks(batches, write, ended):
            if out:
                yield _batch(out, schema)
                out.clear()

    figures = ", ".join(f"{c} long" for c in FIGURES)
    return _ordered(rows).mapInArrow(fold, f"conv_id {kind.simpleString()}, {figures}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of every row of the repaired conversations, with the treatment of repair_conversations."""
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = {"place": 0}

        def write(conv, role: str, text: str) -> None:
            out.append((conv, state["place"], role, text))
            state["place"] += 1

        for _ in _talks(batches, write, lambda _: state.update(place=0)):
            if out:
                yield _batch(out, schema)
                out.clear()

    return _ordered(rows).mapInArrow(fold, f"conv_id {kind.simpleString()}, place long, role string, text string")

