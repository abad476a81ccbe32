"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn and user-assistant pairs.

Two passes; texts take part in the second only. First every conversation becomes a signature, one letter a row for its
role and fault. Signatures are sorted and walked as a prefix trie in which a layer of the edit DP is computed once for each
shared prefix. Then the edits of a conversation are sorted before its rows and applied while these stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from os.path import commonprefix

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

#: Fixed values of the contract: what edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ENDINGS = ".!?"
WRITTEN = {"u": "user", "a": "assistant"}
#: States of the accepted initials (s?(ua)+)?: nothing yet, after s, after u, after a; where an initial leads from each.
START, SYSTEM, USER, DONE = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: The initial that a rerole or an insertion may write in each state.
OFFERS = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}
#: A letter of a signature stands for one of four initials (other ones alike) and one of four faults.
INITIALS = "sua?"
SOUND, BLANK, DUPLICATE, CUT = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"
#: Characters of a text that order rows of one turn and role, before their digest does.
HEAD = 64
LARGEST = (1 << 63) - 1
FLUSH = 2000
SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def known(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of rows: nulls of role and text as one space, one copy of each."""
    space = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("long").alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """known() with the contract's damage by crc32 of conv_id:turn (a null there is one space too); dropped rows have n = 0, repeated ones 2."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    return known(rows).withColumns({
        "text": F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text")),
        "role": F.when(kind == 4, "user").otherwise(F.col("role")),
        "n": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long"),
    })


def ordered(rows: DataFrame) -> DataFrame:
    """rows dealt by conversation, with the columns head and digest that put equal turns and roles in order."""
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))})


#: Ascending order puts nulls first.
ORDER = ("conv_id", "turn", "role", "head", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps of known() or damaged() rows.

    One shuffle, without texts. Rows of equal turn are ordered by role, then by the first 64 characters of the text, then by
    its digest. The rows of a conversation stream through one task, sorted with spilling, and hold one byte each there.
    """
    last = F.right(F.expr(r"rtrim(' \u0009\u000A\u000B\u000C\u000D', text)"), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.instr(F.lit(ENDINGS), last) > 0, SOUND).otherwise(CUT)
    role = F.instr(F.lit(INITIALS[:3]), F.left("role", F.lit(1)))
    initial = F.when((role > 0) & (F.col("role") != ""), role - 1).otherwise(3)
    facts = ordered(rows).select("conv_id", "turn", "role", "head", "digest", "n", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"))
    dealt = facts.repartition("conv_id")
    again = Window.partitionBy("conv_id", "role", "digest", F.col("n") > 0).orderBy("turn")
    placed = dealt.withColumn("nth", F.row_number().over(again)).sortWithinPartitions(*ORDER, "nth").select("conv_id", "turn", "initial", "fault", "n", (F.col("nth") > 1).alias("again"))
    conv = rows.schema["conv_id"]
    return placed.mapInArrow(signed, StructType([conv, *StructType.fromDDL("signature string, gaps bigint").fields]))


def signed(batches: Iterator) -> Iterator:
    """Sorted rows -> one row a conversation."""
    import pyarrow as pa

    out, conv, begun, kind = [], None, False, None

    def batch():
        ids, texts, gaps = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(gaps, pa.int64())], ["conv_id", "signature", "gaps"])

    def gap() -> int:
        return min(high - low + 1 - turns, LARGEST) if turns else 0

    for part in batches:
        kind = part.column("conv_id").type
        for this, turn, initial, fault, n, again in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n", "again")), strict=True):
            if not begun or this != conv:
                if begun:
                    out.append((conv, letters.decode(), gap()))
                if len(out) >= FLUSH:
                    yield batch()
                    out.clear()
                begun, conv, letters, low, high, turns = True, this, bytearray(), None, None, 0
            for copy in range(n):
                letters += LETTERS[4 * initial + (DUPLICATE if fault != BLANK and (again or copy) else fault)].encode()
            if n and turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
    if begun:
        out.append((conv, letters.decode(), gap()))
        yield batch()


@lru_cache(maxsize=None)
def step(layer: tuple, letter: str) -> tuple[tuple, int, tuple]:
    """The DP layer after one more row, its least cost (taken out of the layer), and each state's way back.

    A layer holds (cost, rank) of the best edits for each state, None where there are none; edits end with the row's own
    letter, insertions come with the row after. Ranks order the edits as strings: of two that have covered the same rows
    neither begins the other, so what is put after them never changes their order. A way back is (state before, letters).
    Costs lie within a few edits of each other and ranks are a permutation, so there are few layers.
    """
    initial, fault = INITIALS[LETTERS.index(letter) // 4], LETTERS.index(letter) % 4
    best: dict[int, tuple] = {}

    def offer(state: int, cost: int, rank: int, edits: str, before: int) -> None:
        if state not in best or (cost, rank, edits) < best[state][:3]:
            best[state] = cost, rank, edits, before

    for before, state, cost, rank, edits in reached(layer):
        offer(state, cost + DELETE, rank, edits + "D", before)
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if (state, initial) in NEXT:
                offer(NEXT[state, initial], cost + extra, rank, edits + "K", before)
            offer(NEXT[state, OFFERS[state]], cost + REROLE + extra, rank, edits + "R", before)
    least = min(b[0] for b in best.values())
    ranks = sorted(best, key=lambda s: best[s][1:3])
    after = tuple((best[s][0] - least, ranks.index(s)) if s in best else None for s in range(4))
    return after, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def reached(layer: tuple) -> Iterator[tuple[int, int, int, int, str]]:
    """(state of the layer, state after insertions, cost, rank, insertions); three insertions only return to a state."""
    for before, found in enumerate(layer):
        if found:
            state = before
            for inserted in range(3):
                yield before, state, found[0] + INSERT * inserted, found[1], "I" * inserted
                state = NEXT[state, OFFERS[state]]


class Trie:
    """The prefix trie of sorted signatures; of its nodes only those on the way to the last signature are kept.

    Sorted signatures never come back to a branch that they have left, so memory is bounded by the longest signature.
    """

    FIRST = ((0, 0), None, None, None)

    def __init__(self):
        self.letters, self.layers, self.costs, self.answer = "", [self.FIRST], [0], None

    def insert(self, signature: str) -> tuple[int, str]:
        """Least cost and edits of a signature; layers are computed for the nodes that it adds."""
        if self.answer and signature == self.letters:
            return self.answer
        shared = len(commonprefix([self.letters, signature]))
        del self.layers[shared + 1 :], self.costs[shared + 1 :]
        layer, cost = self.layers[-1], self.costs[-1]
        for letter in signature[shared:]:
            layer, more, _ = step(layer, letter)
            cost += more
            self.layers.append(layer)
            self.costs.append(cost)
        self.letters, self.answer = signature, None
        self.answer = self.terminal()
        return self.answer

    def terminal(self) -> tuple[int, str]:
        ends = [(cost, rank, edits, before) for before, state, cost, rank, edits in reached(self.layers[-1]) if state in (START, DONE)]
        cost, _, edits, state = min(ends)
        back = [edits]
        for i in range(len(self.letters) - 1, -1, -1):
            state, edits = step(self.layers[i], self.letters[i])[2][state]
            back.append(edits)
        return self.costs[-1] + cost, "".join(reversed(back))


def counted(signature: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal of a signature."""
    faults = [sum(signature.count(LETTERS[4 * i + fault]) for i in range(4)) for fault in (BLANK, DUPLICATE, CUT)]
    initials = signature.translate({ord(letter): INITIALS[i // 4] for i, letter in enumerate(LETTERS)})
    legal = sum(map(initials.count, ("su", "ua", "au")))
    return *faults, max(len(signature) - 1, 0) - legal


def solved(batches: Iterator) -> Iterator:
    """Sorted signatures -> the summary of each conversation."""
    import pyarrow as pa

    trie, last, answer = Trie(), None, None
    for part in batches:
        rows = []
        for signature in part.column("signature").to_pylist():
            if signature != last or answer is None:
                cost, audit = trie.insert(signature)
                last, answer = signature, (*counted(signature), cost, audit)
            rows.append(answer)
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        types = [pa.int64()] * 5 + [pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("gaps"), *arrays], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def summaries(signs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of stored signatures.

    Signatures are dealt in ranges, so equal beginnings meet in a task; a signature of very many conversations is spread by
    their ids. Every task computes its shared layers once; nothing is joined.
    """
    spread = F.xxhash64("conv_id")
    dealt = signs.repartitionByRange("signature", spread).sortWithinPartitions("signature")
    return dealt.mapInArrow(solved, StructType([signs.schema["conv_id"], *StructType.fromDDL(SUMMARY).fields]))


def edited(rows: DataFrame, found: DataFrame, make, schema: StructType) -> DataFrame:
    """Streams every conversation's rows after its summary through make()."""
    empty = {"turn": rows.schema["turn"].dataType, "role": "string", "text": "string", "n": "bigint", "head": "string", "digest": "binary"}
    heads = found.withColumn("row", F.lit(0)).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    body = ordered(rows).withColumn("row", F.lit(1))
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "row", *ORDER[1:])
    return both.drop("head", "digest").mapInArrow(make, schema)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def streamed(batches: Iterator) -> Iterator[tuple]:
    """(summary row, None) where a conversation begins and (None, turn) for each turn that it has after its edits."""
    edits, used, odd, place = "", 0, False, 0
    first = True

    def written(turn, role: str, text: str, edit: str):
        nonlocal place
        place += 1
        return None, (place, turn, role, text, edit)

    def inserted() -> Iterator[tuple]:
        nonlocal used
        while used < len(edits) and edits[used] == "I":
            used += 1
            yield written(None, role_of(place), "", "I")

    def role_of(position: int) -> str:
        return WRITTEN["ua"[(position - odd) % 2]]

    for part in batches:
        names = ("conv_id", *NUMBERS, "audit", "row", "turn", "role", "text", "n")
        for conv, *numbers, audit, row, turn, role, text, n in zip(*(part.column(c).to_pylist() for c in names), strict=True):
            if row == 0:
                if not first:
                    yield from inserted()
                first = False
                edits, used, place = audit, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                yield (conv, *numbers, audit), None
                continue
            for _ in range(n):
                yield from inserted()
                edit = edits[used]
                used += 1
                if edit != "D":
                    yield written(turn, role if edit == "K" else role_of(place), text, edit)
    yield from inserted()


def hashed(batches: Iterator) -> Iterator:
    """One row a conversation: its summary and the SHA-256 of its repaired turns."""
    import pyarrow as pa

    kind, out, digest = None, [], None

    def noted(source):
        nonlocal kind
        for part in source:
            kind = part.column("conv_id").type
            yield part

    def batch():
        columns = list(zip(*out, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *NUMBERS, "audit", "repaired_sha256"])

    now = None
    for summary, turn in streamed(noted(batches)):
        if summary:
            if now:
                out.append((*now, digest.hexdigest()))
            if len(out) >= FLUSH:
                yield batch()
                out.clear()
            now, digest = summary, hashlib.sha256()
        else:
            place, _, role, text, _ = turn
            digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
    if now:
        out.append((*now, digest.hexdigest()))
        yield batch()


def spelled(batches: Iterator, ddl_names: tuple) -> Iterator:
    """One row a repaired turn."""
    import pyarrow as pa

    kinds, out, size, conv = None, [], 0, None

    def noted(source):
        nonlocal kinds
        for part in source:
            kinds = part.column("conv_id").type, part.column("turn").type
            yield part

    def batch():
        types = [kinds[0], pa.int64(), kinds[1], pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(ddl_names))

    for summary, turn in streamed(noted(batches)):
        if summary:
            conv = summary[0]
            continue
        out.append((conv, *turn))
        size += len(turn[3])
        if len(out) >= FLUSH or size > 1 << 22:
            yield batch()
            out.clear()
            size = 0
    if out:
        yield batch()


def audits(rows: DataFrame) -> DataFrame:
    """One row a conv_id of known() or damaged() rows: SUMMARY and repaired_sha256 (of `role:text`, newline-joined).

    A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated. A
    conversation without a row left (n = 0) has zeros, no edits and the hash of an empty text. Null conv_ids are one
    conversation; rows with a null turn come first and have no share in gaps, which end at the largest long. Rows of equal
    turn are ordered as signatures() says; repeated rows are duplicates of the first. Other roles than system, user and
    assistant count by their initial. Columns besides the four are not read; no rows give none.
    """
    found = summaries(stored(signatures(rows), "conversation-signatures"))
    return edited(rows, found, hashed, StructType([rows.schema["conv_id"], *StructType.fromDDL(SUMMARY + ", repaired_sha256 string").fields]))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn, role, text, edit (K, R or I): the turns after the cheapest edits, inserted ones without turn and text."""
    found = summaries(stored(signatures(rows), "conversation-signatures"))
    fields = StructType.fromDDL("place bigint, role string, text string, edit string").fields
    schema = StructType([rows.schema["conv_id"], fields[0], rows.schema["turn"], *fields[1:]])
    return edited(rows, found, partial(spelled, ddl_names=tuple(schema.names)), schema)
