"""Conversation structure repair: the cheapest edits after which the roles read ``(s?(ua)+)?``.

Every row is a symbol: its role's initial and whether it is truncated, or that it must go (blank, duplicate). Equal
consecutive symbols are a run. A symbol's transition is a 4 x 4 min-plus matrix over the states of the pattern, whose
entries also keep the edits' initials; a run of n symbols advances through the cached powers 1, 2, 4, ... of it, and
only ranks tell equally cheap prefixes apart, so no text is compared. The choices are then unrolled to the audit.

Rows are put in order by range partitions, which also cut a long conversation. Blocks of at most BLOCK rows are folded
to one matrix each; a conversation's matrices are chained (one small row per block), which gives the states between
blocks, and blocks are unrolled by themselves. A conversation's rows meet in one task only where the whole is hashed
(``repair_report``), as a stream of which that task holds one row and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: States of the pattern: nothing yet, after s, after u, after a. Edits cost so much; a truncated row that stays adds TRUNCATED.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols are 2 * place of the initial in INITIALS (else 3) + truncated; GONE must be deleted.
INITIALS, GONE = "sua", 8
#: What white space is here.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a block: 2 ** BLOCK_BITS.
BLOCK_BITS = 12
NEVER = 1 << 60
#: The state that a new or renamed row leads to, and its role.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: (cost, edits) of ending in each state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _times(a: tuple, b: tuple) -> tuple:
    """The min-plus product; of equally cheap edits the ASCII-least stay. All entries of a matrix hold equally many
    edits other than I and end with one, so none is the start of another and order survives concatenation."""
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in zip(row, col, strict=True) if x and y), default=None) for col in columns) for row in a)


def _before() -> tuple:
    """Inserted rows before a row."""
    m = [[None] * 4 for _ in range(4)]
    for i in range(4):
        state, cost, edits = i, 0, ""
        while m[i][state] is None:
            m[i][state] = (cost, edits)
            state, cost, edits = NEXT[state][0], cost + INSERT, edits + "I"
    return tuple(map(tuple, m))


@cache
def power(symbol: int, k: int) -> tuple:
    """The transition of 2 ** k rows with this symbol."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    m = [[None] * 4 for _ in range(4)]
    for i in range(4):
        m[i][i] = (DELETE, "D")
        if symbol != GONE:
            extra = TRUNCATED * (symbol & 1)
            to = NEXT[i][0]
            m[i][to] = (REROLE + extra, "R")
            kept = symbol >> 1
            if (kept == 0 and i == START) or (kept == 1 and i != USER) or (kept == 2 and i == USER):
                m[i][kept + 1] = (extra, "K")
    return _times(_before(), tuple(map(tuple, m)))


@lru_cache(1 << 12)
def run_of(symbol: int, n: int) -> tuple:
    """The transition of a run of ``n`` rows, from the powers in its binary form."""
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(out, power(symbol, k)) if out else power(symbol, k)
    return out


def _advance(costs: list, ranks: list, run: tuple) -> tuple[list, list, list]:
    """Costs, ranks of the edits so far, and the state each state is reached from, after a run."""
    new, came = [NEVER] * 4, [None] * 4
    for j in range(4):
        ways = [(costs[i] + run[i][j][0], ranks[i], i) for i in range(4) if costs[i] < NEVER and run[i][j]]
        if ways:
            new[j], _, came[j] = min(ways)
    order = sorted((ranks[came[j]], run[came[j]][j][1], j) for j in range(4) if came[j] is not None)
    rank = [0] * 4
    for r, (_, _, j) in enumerate(order):
        rank[j] = r
    return new, rank, came


@lru_cache(1 << 12)
def _folded(runs: tuple) -> tuple[list[int], list[int]]:
    """Cost and rank from every state to every state over ``runs`` ((symbol, n), ...), row by row of the matrix."""
    costs, ranks = [], []
    for start in range(4):
        c, r = [NEVER] * 4, [0] * 4
        c[start] = 0
        for symbol, n in runs:
            c, r, _ = _advance(c, r, run_of(symbol, n))
        costs, ranks = costs + c, ranks + r
    return costs, ranks


def unrolled(runs: tuple, start: int, stop: int) -> str:
    """The edits of ``runs`` between two states."""
    c, r, steps = [NEVER] * 4, [0] * 4, []
    c[start] = 0
    for symbol, n in runs:
        run = run_of(symbol, n)
        c, r, came = _advance(c, r, run)
        steps.append((run, came))
    out = []
    for run, came in reversed(steps):
        out.append(run[came[stop]][stop][1])
        stop = came[stop]
    return "".join(reversed(out))


def chained(blocks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The states before and after each of a conversation's blocks (costs, ranks)."""
    after = [[e[0] for e in ENDS]]
    for costs, _ in reversed(blocks):
        after.append([min(costs[4 * i + j] + after[-1][j] for j in range(4)) for i in range(4)])
    out, state = [], START
    for (costs, ranks), left in zip(blocks, after[-2::-1], strict=True):
        stop = min(range(4), key=lambda j: (costs[4 * state + j] + left[j], ranks[4 * state + j]))
        out.append((state, stop))
        state = stop
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and id, which numbers the rows in order; equal rows may trade places."""
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    keyed = rows.select("conv_id", "turn", spaced("role"), spaced("text"), F.monotonically_increasing_id().alias("_salt"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "_salt")]
    placed = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id")), "turns")


def _symbol() -> Column:
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    place = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(3)
    return F.when(last == "", GONE).otherwise(2 * initial + (~last.isin(".", "!", "?")).cast("int"))


def _rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(v) for v in row if isinstance(v, str)) // 1024
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_INTS = pa.list_(pa.int64())
_BLOCKS = pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("symbols", _INTS), ("sizes", _INTS), ("costs", _INTS), ("ranks", _INTS), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())])
BLOCKS = "conv_id long, id long, symbols array<long>, sizes array<long>, costs array<long>, ranks array<long>, blank long, duplicate long, truncated long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by (block, id, kind) as matrices; a row of kind 0 says that its id is not a duplicate."""

    def rows() -> Iterator[tuple]:
        first = None
        for block, number, kind, conv, symbol in _rows_of(batches, "block", "id", "kind", "conv_id", "symbol"):
            if kind == 0:
                first = number
            else:
                again = symbol != GONE and first != number
                yield block, conv, number, GONE if again else symbol, again

    def blocks() -> Iterator[tuple]:
        for (_, conv), own in groupby(rows(), key=lambda r: r[:2]):
            runs, first, n, duplicate = [], None, 0, 0
            truncated = 0
            for _, _, number, symbol, again in own:
                first = number if first is None else first
                n, duplicate = n + (symbol == GONE), duplicate + again
                truncated += symbol != GONE and symbol & 1
                if runs and runs[-1][0] == symbol:
                    runs[-1][1] += 1
                else:
                    runs.append([symbol, 1])
            costs, ranks = _folded(tuple(map(tuple, runs)))
            yield conv, first, [r[0] for r in runs], [r[1] for r in runs], costs, ranks, n - duplicate, duplicate, truncated

    return _in_batches(blocks(), _BLOCKS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block its states before and after; blocks are sorted by conversation and id."""

    def rows() -> Iterator[tuple]:
        for _, own in groupby(_rows_of(batches, "conv_id", "id", "costs", "ranks"), key=lambda r: r[0]):
            blocks = [r[1:] for r in own]  # one small row for each block
            states = chained([b[1:] for b in blocks])
            for k, (b, (start, stop)) in enumerate(zip(blocks, states, strict=True)):
                yield b[0], start, stop, k == len(blocks) - 1

    return _in_batches(rows(), pa.schema([("id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("last", pa.bool_())]))


#: What is told of a block beside its edits: the state before it, and its share of the conversation's numbers.
COUNTS = ("start", "cost", "blank", "duplicate", "truncated")


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, number, symbols, sizes, costs, start, stop, last, *counts in _rows_of(batches, "conv_id", "id", "symbols", "sizes", "costs", "start", "stop", "last", "blank", "duplicate", "truncated"):
            cost, edits = ENDS[stop] if last else (0, "")
            yield conv, number, unrolled(tuple(zip(symbols, sizes, strict=True)), start, stop) + edits, start, costs[4 * start + stop] + cost, *counts

    return _in_batches(rows(), pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("edits", pa.string()), *[(c, pa.int64()) for c in COUNTS]]))


def _edits(ordered: DataFrame) -> DataFrame:
    """conv_id, id (of the block's first row), edits, cost and fault counts of every block of ``_ordered`` rows."""
    n = partitions(ordered.sparkSession)
    narrow = ordered.select("conv_id", "id", _symbol().alias("symbol"), F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("_d"))
    firsts = narrow.where(F.col("symbol") != GONE).groupBy("conv_id", "_d").agg(F.min("id").alias("id"))
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    none = F.lit(None)
    marked = narrow.select(block, "id", F.lit(1).alias("kind"), "conv_id", "symbol").union(firsts.select(block, "id", F.lit(0), none.cast("long"), none.cast("int")))
    order = ("block", "id", "kind")
    blocks = stored(marked.repartition(n, "block").sortWithinPartitions(*order).mapInArrow(_fold, BLOCKS), "blocks")
    keyed = blocks.select("conv_id", "id", "costs", "ranks").repartition(n, "conv_id").sortWithinPartitions("conv_id", "id")
    states = keyed.mapInArrow(_chain, "id long, start long, stop long, last boolean")
    return blocks.join(states, "id").mapInArrow(_unroll, "conv_id long, id long, edits string, " + ", ".join(f"{c} long" for c in COUNTS))


def _with_edits(ordered: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Rows (kind 2) and their blocks' edits (kind 1) in one table."""
    none = lambda t: F.lit(None).cast(t)
    rows = ordered.select("conv_id", "id", F.lit(2).alias("kind"), "turn", "role", "text", none("string").alias("edits"), *[none("long").alias(c) for c in COUNTS])
    both = rows.union(_edits(ordered).select("conv_id", "id", F.lit(1), none("long"), none("string"), none("string"), "edits", *COUNTS))
    return both if more is None else both.union(more.select("conv_id", F.lit(-1).cast("long"), F.lit(0), none("long"), none("string"), none("string"), none("string"), *[none("long") for _ in COUNTS]))


class _Editor:
    """Applies edits to rows, one after the other."""

    def __init__(self) -> None:
        self.state, self.edits, self.at = START, "", 0

    def begin(self, edits: str, state: int | None = None) -> None:
        self.edits, self.at = edits, 0
        self.state = self.state if state is None else state

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state, role = NEXT[self.state]
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is inserted before a row, and of the row."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            self.state, role = NEXT[self.state]
        elif edit == "K":
            self.state = INITIALS.index(role[0]) + 1
        yield edit, role, text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        editor, conv, number, k = _Editor(), None, 0, 0
        for kind, own, i, turn, role, text, edits, start in _rows_of(batches, "kind", "conv_id", "id", "turn", "role", "text", "edits", "start"):
            if kind == 1:
                yield from ((conv, number, k + n, None, *e) for n, e in enumerate(editor.inserted()))  # at a conversation's end
                editor.begin(edits, start)
                conv = own
            else:
                number = i
                for k, e in enumerate(editor.row(role, text)):  # noqa: B007
                    yield conv, i, k, turn if e[0] != "I" else None, *e
                k += 1
        yield from ((conv, number, k + n, None, *e) for n, e in enumerate(editor.inserted()))

    return _in_batches(rows(), pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("k", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order; only the audit grows with a conversation."""

    def rows() -> Iterator[tuple]:
        columns = ("conv_id", "kind", "turn", "role", "text", "edits", *COUNTS[1:])
        for conv, own in groupby(_rows_of(batches, *columns), key=lambda r: r[0]):
            editor, digest, audit, between = _Editor(), hashlib.sha256(), [], ""
            counts, illegal, before = [0, 0, 0, 0], 0, None
            low = high = None
            turns = 0

            def write(edited: Iterator[tuple]) -> None:
                nonlocal between
                for edit, role, text in edited:
                    if edit != "D":
                        digest.update(f"{between}{role}:{text}".encode())  # noqa: B023
                        between = "\n"

            for _, kind, turn, role, text, edits, *numbers in own:
                if kind == 1:
                    write(editor.inserted())
                    editor.begin(edits)
                    audit.append(edits)
                    counts = [a + b for a, b in zip(counts, numbers, strict=True)]
                elif kind == 2:
                    write(editor.row(role, text))
                    illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                    before = role[:1]
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
            write(editor.inserted())
            cost, blank, duplicate, truncated = counts
            yield conv, high - low + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

    return _in_batches(rows(), _REPORT)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (conv_id, turn, role, text) after the cheapest repair, and those it deletes: conv_id, id
    and k (together the order inside a conversation), turn (null for inserted rows), edit (K keep, R rename, D delete,
    I insert), role and text.

    Rows are taken by turn (nulls first), then role and text. A row is blank (nothing but white space), else a
    duplicate (role and text stand earlier in the conversation), else truncated (the last character that is not white
    space is none of ``.!?``). Blank rows and duplicates are deleted; the role initials of what is left read
    ``(s?(ua)+)?``. Edits are the cheapest, of equally cheap ones the ASCII-least. Null roles and texts count as one
    space, so those texts are blank; rows without conv_id are one conversation. An empty table gives no rows.
    """
    # blocks are edited by themselves: the state before a block is told with its edits
    pieces = _with_edits(_ordered(rows)).withColumn("_block", F.shiftright("id", BLOCK_BITS))
    dealt = pieces.repartition(partitions(rows.sparkSession), "_block").sortWithinPartitions("_block", "id", "kind")
    return dealt.mapInArrow(_repaired, "conv_id long, id long, k long, turn long, edit string, role string, text string")


def repair_report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps (turns missing between the least and the largest; nulls left aside),
    blank, duplicate, truncated (rows whose first fault that is), illegal (neighbouring initials other than su, ua,
    au), cost, audit (initials of the edits) and repaired_sha256 (of the repaired ``role:text`` lines).

    See ``repair_conversations``. Every conv_id of ``every`` (of ``rows`` if None) gets a row, without rows one with
    zeros, an empty audit and the hash of nothing. The hash needs a conversation's rows in one task, which reads them
    as a stream.
    """
    ordered = _ordered(rows)
    known = (rows if every is None else every).select("conv_id").distinct()
    dealt = _with_edits(ordered, known).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "id", "kind")
    return dealt.mapInArrow(_report, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls as one space) damaged by crc32(``conv_id:turn``) % 20: 0 drops a
    row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("_kind")
    each = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
