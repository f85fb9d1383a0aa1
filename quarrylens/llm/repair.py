"""Conversation repair: a generalised LR parser over roles that may keep, rerole, delete and insert turns at a cost.

The grammar of roles becomes an SLR automaton. Its stacks share what lies below their tops; every edit of a row moves a stack
on, and where two ways lead to one stack only the smaller (cost, audit) stays. Equal costs never meet where one audit begins
the other, as inserted turns cost something, so what is dropped could never win later.

Rows are ordered by conversation, turn (null first), role and digest of the text by a range sort, which splits a conversation of
any size over tasks, and cut into pieces of at most ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes. Most conversations are one
piece and are repaired where they lie. Those that reach beyond a piece are repaired piecewise from every stack that the grammar
allows, in parallel; what earlier pieces said is told by digests; one pass over the pieces in order then joins their ways and
goes on with one SHA-256 chain for each stack, holding one piece at a time. The audit of a conversation is one string and its
digest one chain, so that last pass reads a conversation's pieces in one task.

Nulls count as one space, as roles and as texts; a null conversation is one conversation. Empty texts are blank. A role that
starts with no letter of the grammar, or is empty, cannot be kept. Rows of one turn are ordered by role, then by the SHA-256 of
the text; repeated rows are duplicates. Very long texts are compared and hashed whole. A conversation whose rows are all ``gone``
has zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarrylens.llm.common import cut

#: Symbols with a rule are not roles; the first one is the whole conversation. Left recursion keeps stacks short.
GRAMMAR = {"C": ("", "P", "sP"), "P": ("ua", "Pua")}
#: The roles that an edit may give.
GIVEN = {"u": "user", "a": "assistant"}
#: What the edits cost, and an undeleted truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
MOST_STACKS = 64
BLANKS = " \t\n\x0b\x0c\r"

Stack = tuple
Way = tuple  # cost, audit, roles said


class Parser:
    """SLR tables of a grammar, and the moves of its stacks; a stack is (state, stack below)."""

    def __init__(self, grammar: dict[str, tuple[str, ...]] = GRAMMAR):
        self.grammar = grammar
        self.start = next(iter(grammar))
        self.follow = self._follow()
        self.states: list[frozenset] = []
        self.empty: Stack = (self._state(frozenset({("", self.start, 0)})), None)
        self.step = lru_cache(None)(self._step)

    def _first(self, word: str, known: dict[str, set]) -> set:
        found: set = set()
        for symbol in word:
            one = known.get(symbol, {symbol})
            found |= one - {""}
            if "" not in one:
                return found
        return found | {""}

    def _follow(self) -> dict[str, set]:
        first: dict[str, set] = {name: set() for name in self.grammar}
        follow: dict[str, set] = {name: set() for name in self.grammar}
        follow[self.start].add("$")
        settled = False
        while not settled:
            before = sum(map(len, [*first.values(), *follow.values()]))
            for name, words in self.grammar.items():
                for word in words:
                    first[name] |= self._first(word, first)
                    for at, symbol in enumerate(word):
                        if symbol in self.grammar:
                            after = self._first(word[at + 1:], first)
                            follow[symbol] |= (after - {""}) | (follow[name] if "" in after else set())
            settled = before == sum(map(len, [*first.values(), *follow.values()]))
        return follow

    def _state(self, kernel: frozenset) -> int:
        """The number of the state of these items (symbol, word, position) and of all that may begin there."""
        items, new = set(kernel), list(kernel)
        while new:
            _, word, at = new.pop()
            for made in self.grammar.get(word[at:at + 1], ()):
                item = (word[at], made, 0)
                if item not in items:
                    items.add(item)
                    new.append(item)
        state = frozenset(items)
        if state not in self.states:
            self.states.append(state)
        return self.states.index(state)

    def _goto(self, stack: Stack, symbol: str) -> Stack | None:
        moved = frozenset((n, w, at + 1) for n, w, at in self.states[stack[0]] if w[at:at + 1] == symbol)
        return (self._state(moved), stack) if moved else None

    def _reduced(self, stack: Stack, ahead: str) -> set[Stack]:
        """The stack and all that come of it by reductions before the symbol ``ahead``."""
        found, new = {stack}, [stack]
        while new:
            at = new.pop()
            for name, word, place in sorted(self.states[at[0]]):
                if name and place == len(word) and ahead in self.follow[name]:
                    below = at
                    for _ in word:
                        below = below[1]
                    moved = self._goto(below, name)
                    if moved and moved not in found:
                        found.add(moved)
                        new.append(moved)
        return found

    def _step(self, stack: Stack, role: str) -> tuple[Stack, ...]:
        """Where a role leads; nothing where it does not fit. What must be reduced next is reduced at once."""
        moved = [self._goto(s, role) for s in sorted(self._reduced(stack, role), key=repr)]  # states are numbered alike in every task
        return tuple(sorted({self._settled(s) for s in moved if s}, key=repr))

    def _settled(self, stack: Stack) -> Stack:
        while len(self.states[stack[0]]) == 1:
            (name, word, place), = self.states[stack[0]]
            if not name or place < len(word):
                break
            for _ in word:
                stack = stack[1]
            stack = self._goto(stack, name)
        return stack

    def accepts(self, stack: Stack) -> bool:
        return any(s[1] == self.empty and ("", self.start, 1) in self.states[s[0]] for s in self._reduced(stack, "$"))

    def stacks(self, roles: str = "sua") -> list[Stack]:
        """Every stack that roles can lead to, in a fixed order: the entries of a piece."""
        found, new = [self.empty], [self.empty]
        while new:
            at = new.pop()
            for role in roles:
                for moved in self.step(at, role):
                    if moved not in found:
                        found.append(moved)
                        new.append(moved)
                        if len(found) > MOST_STACKS:
                            raise ValueError("the grammar lets its stacks grow; write it left recursive")
        return sorted(found, key=repr)

    def inserted(self, front: dict[Stack, Way]) -> dict[Stack, Way]:
        """The front with turns put in: the cheapest way to each stack."""
        front = dict(front)
        new = dict(front)
        while new:
            better: dict[Stack, Way] = {}
            for stack, (cost, audit, said) in new.items():
                for role in GIVEN:
                    for moved in self.step(stack, role):
                        way = (cost + INSERT, audit + "I", said + role)
                        if moved not in front or way < front[moved]:
                            front[moved] = better[moved] = way
            new = better
        return front

    def consumed(self, front: dict[Stack, Way], initial: str, stays: bool, extra: int) -> dict[Stack, Way]:
        """The front after one more row, whose fate is one edit; a row that must not stay is deleted."""
        after: dict[Stack, Way] = {}

        def offer(stack: Stack, way: Way) -> None:
            if stack not in after or way < after[stack]:
                after[stack] = way

        for stack, (cost, audit, said) in self.inserted(front).items():
            offer(stack, (cost + DELETE, audit + "D", said))
            if stays:
                for moved in self.step(stack, initial) if initial else ():
                    offer(moved, (cost + KEEP + extra, audit + "K", said + initial))
                for role in GIVEN:
                    for moved in self.step(stack, role):
                        offer(moved, (cost + REROLE + extra, audit + "R", said + role))
        return after


def faults(rows: list[tuple[str, str]], seen: set, known: set = frozenset()) -> list[str]:
    """The first fault of each row (role, text): blank, duplicate, truncated or none; ``seen`` grows, ``known`` was seen before."""
    out = []
    for role, text in rows:
        bare = text.strip(BLANKS)
        own = digest(role, text)
        out.append("blank" if not bare else "duplicate" if own in seen or own in known else "truncated" if bare[-1] not in ".!?" else "")
        seen.add(own)
    return out


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def parsed(parser: Parser, front: dict[Stack, Way], rows: list[tuple[str, str]], found: list[str]) -> dict[Stack, Way]:
    for (role, _), fault in zip(rows, found):
        front = parser.consumed(front, role[:1], fault not in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)
    return front


def lines(rows: list[tuple[str, str]], audit: str, said: str) -> list[str]:
    """The repaired rows as ``role:text``."""
    out, row, roles = [], iter(rows), iter(said)
    for edit in audit:
        if edit == "I":
            out.append(f"{GIVEN[next(roles)]}:")
            continue
        role, text = next(row)
        if edit != "D":
            given = next(roles)
            out.append(f"{role if edit == 'K' else GIVEN[given]}:{text}")
    return out


def illegal(initials: list[str]) -> int:
    """Neighbours whose initials do not follow each other."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _pieces(rows: DataFrame) -> DataFrame:
    """``(conv, part, seq, edge, ...)``: rows in order, cut into pieces; ``edge`` tells that a conversation may go on elsewhere."""
    kind = rows.schema["conv"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[dict] = []
        first: list = []  # the first conversation of the partition may have begun before it
        state = {"key": None, "bytes": 0, "open": False, "shape": None, "turn": None}

        def done(edge: bool) -> pa.RecordBatch:
            nonlocal seq, held
            turns = [r["turn"] for r in held if r["turn"] is not None and not r["gone"]]
            kept = [{"role": r["role"], "text": r["text"]} for r in held if not r["gone"]]
            piece = {"conv": [state["key"]], "part": [part], "seq": [seq], "edge": [edge], "low": [min(turns, default=None)],
                     "high": [max(turns, default=None)], "turns": [len(set(turns))], "rows": [kept]}
            seq, held = seq + 1, []
            state["bytes"] = 0
            types = [state["shape"], pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(piece.values(), types)], list(piece))

        for batch in batches:
            state["shape"] = batch.column(0).type
            for row in batch.to_pylist():
                if not first:
                    first.append(row["conv"])
                    state["key"] = row["conv"]
                size = len(row["text"])
                if held and row["conv"] != state["key"]:
                    yield done(state["open"] or state["key"] == first[0])
                    state["open"] = False
                elif held and (len(held) >= PIECE_ROWS or state["bytes"] + size > PIECE_BYTES):
                    yield done(True)
                    state["open"] = True
                state["key"] = row["conv"]
                state["bytes"] += size
                held.append(row)
        if held:
            yield done(True)

    keyed = rows.select("conv", "turn", "role", "text", "gone", F.sha2("text", 256).alias("own"), F.monotonically_increasing_id().alias("deal"))
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "own", "deal")
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone")
    return ranged.mapInArrow(gather, f"conv {kind}, part int, seq long, edge boolean, low long, high long, turns long, "
                                     "rows array<struct<role: string, text: string>>")


def _result(kind) -> StructType:
    longs = [StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return StructType([StructField("conv", kind), *longs, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])


def _whole(pieces: DataFrame, grammar: dict) -> DataFrame:
    """Conversations of one piece, repaired."""
    schema = _result(pieces.schema["conv"].dataType)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(grammar)
        for batch in batches:
            out = []
            for piece in batch.select(["low", "high", "turns", "rows"]).to_pylist():
                rows = [(r["role"], r["text"]) for r in piece["rows"]]
                found = faults(rows, set())
                cost, audit, said = _end(parser, parsed(parser, {parser.empty: (0, "", "")}, rows, found))
                text = "\n".join(lines(rows, audit, said))
                gaps = 0 if piece["low"] is None else piece["high"] - piece["low"] + 1 - piece["turns"]
                out.append((gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal([r[:1] for r, _ in rows]),
                            cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 8
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, t) for c, t in zip(columns, types))], schema.names)

    return pieces.mapInArrow(mend, schema)


def _end(parser: Parser, front: dict[Stack, Way]) -> Way:
    """The cheapest way to a whole conversation."""
    return min(way for stack, way in parser.inserted(front).items() if parser.accepts(stack))


def _known_before(pieces: DataFrame) -> DataFrame:
    """``(conv, part, seq, known)``: the digests of a piece's rows that an earlier piece of the conversation holds."""
    kind = pieces.schema["conv"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in enumerate(batch.column("rows").to_pylist()):
                own = sorted({digest(r["role"], r["text"]) for r in rows})
                at = pa.array([k] * len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("conv", "part", "seq")), pa.array(own, pa.binary())],
                                                 ["conv", "part", "seq", "own"])

    said = pieces.select("conv", "part", "seq", "rows").mapInArrow(spread, f"conv {kind}, part int, seq long, own binary")
    said = cut(said, "digests")
    first = said.groupBy("conv", "own").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = said.join(first.withColumnRenamed("conv", "c").withColumnRenamed("own", "o"),
                      F.col("conv").eqNullSafe(F.col("c")) & (F.col("own") == F.col("o")))
    return (again.where(F.struct("part", "seq") > F.col("first")).groupBy(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"))
            .agg(F.collect_list("own").alias("known")))


def _spread_out(pieces: DataFrame, grammar: dict) -> DataFrame:
    """Conversations that may reach over several pieces, repaired from their pieces."""
    kind = pieces.schema["conv"].dataType
    schema = _result(kind)
    ways_sql = "ways array<struct<entry: int, leave: int, cost: long, audit: string, said: string>>"

    def try_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(grammar)
        stacks = parser.stacks()
        number = {s: k for k, s in enumerate(stacks)}
        for batch in batches:
            ways, counts = [], []
            for piece in batch.select(["rows", "known"]).to_pylist():
                rows = [(r["role"], r["text"]) for r in piece["rows"]]
                found = faults(rows, set(), set(piece["known"] or ()))
                ways.append([{"entry": k, "leave": number[leave], "cost": way[0], "audit": way[1], "said": way[2]} for k, stack in enumerate(stacks)
                             for leave, way in parsed(parser, {stack: (0, "", "")}, rows, found).items()])
                initials = [r[:1] for r, _ in rows]
                counts.append({"blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
                               "illegal": illegal(initials), "first": initials[0] if initials else None, "last": initials[-1] if initials else None})
            shape = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("said", pa.string())]))
            held = pa.struct([*((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string())])
            names = ["conv", "part", "seq", "low", "high", "turns", "rows"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ways, shape), pa.array(counts, held)], [*names, "ways", "counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation after the other, piece by piece in order: the front of stacks, each with its chain of SHA-256."""
        parser = Parser(grammar)
        stacks = parser.stacks()
        at: dict = {}
        shape = None

        def begin(conv) -> None:
            at.update(conv=conv, front={parser.empty: (0, "", "", hashlib.sha256(), False)}, sums=[0] * 4, last=None, low=None, high=None, turns=0)

        def hashed(chain, any_line: bool, more: list[str]):
            if more:
                chain = chain.copy()
                chain.update((("\n" if any_line else "") + "\n".join(more)).encode())
            return chain, any_line or bool(more)

        def done() -> tuple:
            ends = {s: way[:3] for s, way in at["front"].items()}
            cost, audit, said = _end(parser, ends)
            rows_only = audit.rstrip("I")  # what was put in last belongs to no row
            source = next(s for s, way in at["front"].items() if way[1] == rows_only and said.startswith(way[2]))
            before = at["front"][source]
            tail = [f"{GIVEN[r]}:" for r in said[len(before[2]):]]
            gaps = 0 if at["low"] is None else at["high"] - at["low"] + 1 - at["turns"]
            return (at["conv"], gaps, *at["sums"], cost, audit, hashed(before[3], before[4], tail)[0].hexdigest())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [shape] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

        for batch in batches:
            shape = batch.column("conv").type
            for k in range(batch.num_rows):
                piece = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if not at or at["conv"] != piece["conv"]:
                    if at:
                        yield out([done()])
                    begin(piece["conv"])
                rows = [(r["role"], r["text"]) for r in piece["rows"]]
                front: dict = {}
                for way in piece["ways"]:
                    before = at["front"].get(stacks[way["entry"]])
                    if before:
                        moved = (before[0] + way["cost"], before[1] + way["audit"], before[2] + way["said"])
                        leave = stacks[way["leave"]]
                        if leave not in front or moved < front[leave][:3]:
                            front[leave] = (*moved, before, way)
                at["front"] = {s: (c, a, d, *hashed(before[3], before[4], lines(rows, way["audit"], way["said"])))
                               for s, (c, a, d, before, way) in front.items()}
                counts = piece["counts"]
                at["sums"] = [a + counts[c] for a, c in zip(at["sums"], ("blank", "duplicate", "truncated", "illegal"))]
                if counts["first"] is not None:
                    at["sums"][3] += at["last"] is not None and illegal([at["last"], counts["first"]])
                    at["last"] = counts["last"]
                if piece["low"] is not None:
                    at["turns"] += piece["turns"] - (at["high"] == piece["low"])
                    at["low"], at["high"] = piece["low"] if at["low"] is None else at["low"], piece["high"]
        if at:
            yield out([done()])

    known = _known_before(pieces)
    told = pieces.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left")
    told = told.select("conv", "part", "seq", "low", "high", "turns", "rows", "known")
    names = "part int, seq long, low long, high long, turns long, rows array<struct<role: string, text: string>>"
    tried = told.mapInArrow(try_all, f"conv {kind.simpleString()}, {names}, {ways_sql}, "
                                     "counts struct<blank: long, duplicate: long, truncated: long, illegal: long, first: string, last: string>")
    tried = cut(tried, "tried")
    return tried.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(join, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None,
           grammar: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The cheapest repair of every conversation: counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.

    Rows whose boolean column ``gone`` is true only tell that a conversation exists.
    """
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    pieces = cut(_pieces(plain), "pieces")
    fixed = grammar or GRAMMAR
    found = _whole(pieces.where("not edge"), fixed).union(_spread_out(pieces.where("edge"), fixed))
    return found.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults put in by a hash of conversation and turn; dropped rows are ``gone``."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    changed = (F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
                       changed.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
