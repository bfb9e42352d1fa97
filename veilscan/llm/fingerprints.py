"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches (DataFrame functions only).

A text falls into paragraphs (lines, long ones cut every PARAGRAPH code points) and each distinct paragraph has a
64-bit digest. In a sketch every digest is added to three cells, one in each third: the cell counts it and keeps the
exclusive or of its digests and of their check sums. Subtracting the sketches of two versions cell by cell cancels
what they share. A cell left with one digest passes its check sum; taking that digest out of its other cells frees
more such cells, until nothing is left (the differing digests are recovered) or no such cell remains. Then sketches
of the next size are made and subtracted, without a last size.

Sketches are tables of cells (set, cell, n, digest, check), not arrays in a row: a text's digests are exploded into
cells once and added up by aggregates, and peeling is an aggregate as well, so the work is in proportion to the
digests however long a text is. A round of peeling takes out what stands alone in one third of the cells, where every
digest has just one cell, so no digest is taken out twice and a round is one aggregate. What is left is dealt out anew
after every second aggregate: a stage then holds the hash maps of two aggregates, however many rounds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, offsets, partitions, stored, text_or_empty

#: Code points of a paragraph at most.
PARAGRAPH = 200
#: Cells in each third of the first sketch, which is shown as the fingerprint.
FIRST = 4
#: Thirds that the rounds of peeling look at, and cells per third of the sketches that are subtracted first: for each
#: digest of both versions, and besides. Cells are a table, so those that stay empty cost nothing.
ROUNDS, ROOM, SPARE = (0, 1, 2, 0, 1, 2), 4.0, 128
#: The cell that counts what has been recovered.
FOUND = -1
#: A digest becomes a cell in three thirds and four signed sides: they are dealt into so many times the session's partitions.
SPREAD = 4


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PARAGRAPH}}}"), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _cells_of(digest: Column, check: Column, third: Column) -> list[Column]:
    """The digest's cell in each third of a sketch with ``third`` cells per third, from bits that no other third uses."""
    bits = (digest.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(digest, 32), check.bitwiseAND(0xFFFFFFFF))
    return [(x % third + t * third).cast("int") for t, x in enumerate(bits)]


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    """Cells of one key added up; those that became empty are left out."""
    cells = rows.groupBy(*key, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
    return cells.where("n <> 0 OR digest <> 0 OR check <> 0")


def sketches(sets: DataFrame, *key: str) -> DataFrame:
    """The cells of the sketch of every set in ``sets`` (key, digests: distinct ones, third: cells per third): key,
    third, cell, n, digest, check. Empty cells are left out, so an empty set has none."""
    each = sets.select(*key, "third", F.explode("digests").alias("digest")).withColumn("check", _check(F.col("digest")))
    own = F.array(*_cells_of(F.col("digest"), F.col("check"), F.col("third")))
    return _summed(each.select(*key, "third", "digest", "check", F.lit(1).alias("n"), F.explode_outer(own).alias("cell")), *key, "third")


def _round(cells: DataFrame, t: int, *key: str) -> DataFrame:
    """One round of peeling: every digest that stands alone in a cell of third ``t`` leaves its cells and is counted."""

    def move(cell: Column, n: Column, digest: Column, check: Column) -> Column:
        return F.struct(cell.alias("cell"), n.alias("n"), digest.alias("digest"), check.alias("check"))

    cell, n, digest, check, third = (F.col(c) for c in ("cell", "n", "digest", "check", "third"))
    alone = (cell >= t * third) & (cell < (t + 1) * third) & n.isin(1, -1) & (_check(digest) == check)
    others = [move(c, -n, digest, check) for i, c in enumerate(_cells_of(digest, check, third)) if i != t]
    nothing = F.lit(0).cast("long")
    moves = F.when(alone, F.array(*others, move(F.lit(FOUND), F.lit(1), nothing, nothing))).otherwise(F.array(move(cell, n, digest, check)))
    # outer: else Spark would first filter by the array's size and build it twice
    return _summed(cells.select(*key, "third", F.inline_outer(moves)), *key, "third")


def peeled(cells: DataFrame, *key: str) -> DataFrame:
    """key, third, ok, found: how many digests were recovered from each difference of sketches, and whether they are
    all of it. Differences without cells (equal sets) have no row. ``cells`` comes from one aggregate."""
    for k, t in enumerate(ROUNDS):
        cells = _round(cells, t, *key)
        if k % 2 == 0:  # by the key in turned order, since Spark leaves out a shuffle that changes nothing
            cells = cells.repartition(SPREAD * partitions(cells.sparkSession), *(key if k % 4 == 0 else key[::-1]))
    left = F.col("cell") != FOUND
    return cells.groupBy(*key, "third").agg(F.coalesce(F.max(F.when(~left, F.col("n"))), F.lit(0)).alias("found"), (F.count_if(left) == 0).alias("ok"))


def shown(cells: Column) -> Column:
    """A sketch of the first size as text: the cells that are not empty (place, text) in order of their places, so
    that it can be subtracted from another one and peeled without the document."""
    return F.array_join(F.transform(F.array_sort(cells), lambda c: c["text"]), ".")


def _difference_cells(digests: DataFrame, third: Column) -> DataFrame:
    """_row, pair (1: a and b, 2: a and c), third, cell, n, digest, check: the sketch of a less that of the other
    version. ``third`` may use ``both``, the digests of both, and the columns of ``digests`` other than its sets.
    Sketches are sums, so their difference is the sum of signed cells."""
    sides = [(1, 1, "a", "b"), (1, -1, "b", "a"), (2, 1, "a", "c"), (2, -1, "c", "a")]
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(n).alias("n"), F.col(own).alias("digests"), (F.size(own) + F.size(other)).alias("both")) for p, n, own, other in sides])
    rest = [c for c in digests.columns if c not in ("_row", "a", "b", "c")]
    rows = digests.repartition(SPREAD * partitions(digests.sparkSession), "_row").select("_row", *rest, F.explode(each).alias("v")).select("_row", *rest, "v.*")
    if rest:
        rows = rows.where("pair = _again")
    rows = rows.select("_row", "pair", "n", third.cast("int").alias("third"), F.explode("digests").alias("digest")).withColumn("check", _check(F.col("digest")))
    cells = F.array(*_cells_of(F.col("digest"), F.col("check"), F.col("third")))
    return _summed(rows.select("_row", "pair", "third", "n", "digest", "check", F.explode_outer(cells).alias("cell")), "_row", "pair", "third")


def differences(digests: DataFrame) -> DataFrame:
    """_row, pair (1: with b, 2: with c), found: how many digests only one of the sets a and b (a and c) of a row has.
    Equal sets have no row. ``digests`` has _row, a, b, c. Sketches that cannot be peeled are made again, larger."""
    state = stored(peeled(_difference_cells(digests, F.ceil(ROOM * F.col("both")) + SPARE), "_row", "pair"), "peeled")
    found = None
    while True:
        ended = state.where("ok").select("_row", "pair", "found")
        found = ended if found is None else found.union(ended)
        failed = state.where("NOT ok").select("_row", F.col("pair").alias("_again"), (2 * F.col("third") + 1).alias("_larger"))
        if failed.isEmpty():
            return found
        state = stored(peeled(_difference_cells(digests.join(failed, "_row"), F.col("_larger")), "_row", "pair"), "peeled")


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, _hash (of the text), and of the document it is the next one of, in descending doc_id: _to_id, _to_hash
    and _need, half that document's code points. Only these small columns are ordered and joined."""
    small = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.length("text").alias("_n")).distinct()
    rows = in_order(small, "doc_id", "_n", "_hash")
    at = rows.join(F.broadcast(offsets(rows)), "_part").select("doc_id", "_hash", "_n", (F.col("_rows") + F.col("_pos")).alias("_i"), "_rows_all")
    to = at.select(F.col("doc_id").alias("_to_id"), F.col("_hash").alias("_to_hash"), F.floor(F.col("_n") / 2).cast("int").alias("_need"), F.col("_i").alias("_j"))
    return cut(at.join(to, F.pmod(F.col("_i") + 1, F.col("_rows_all")) == F.col("_j")).select("doc_id", "_hash", "_to_id", "_to_hash", "_need"))


def version_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, in which the last floor(n_chars / 2) code points are
    replaced by as many (or all) from the start of the next document in descending doc_id (after the last: the first).

    Returns doc_id, n_chars (long, code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness with the edited text and with the next document: 1 - differing digests / digests of both, 1
    without any). A fingerprint is a text's first sketch; what is subtracted are sketches of the same texts whose size
    follows the number of digests, and larger ones where a difference cannot be peeled. Null texts count as empty, null doc_ids
    come after all others, documents with one doc_id follow each other by length and hash. Rows that repeat doc_id
    and text count as one document and each get its result. The only document is its own next one.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    given = next_documents(rows)
    mine = (F.col("m.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("m._hash") == F.col("g._hash"))
    handed = keyed.alias("m").join(given.alias("g"), mine).select("_to_id", "_to_hash", F.substring(F.col("text"), F.lit(1), F.col("_need")).alias("_start"), paragraph_digests(F.col("text")).alias("_c"))
    if not rows.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty():
        handed = handed.dropDuplicates(["_to_id", "_to_hash"])
    theirs = (F.col("m.doc_id").eqNullSafe(F.col("h._to_id"))) & (F.col("m._hash") == F.col("h._to_hash"))
    both = keyed.alias("m").join(handed.alias("h"), theirs).select("doc_id", "text", "_start", "_c", F.length("text").alias("_n"))
    edited = both.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("_n") - F.floor(F.col("_n") / 2)).cast("int")), F.col("_start")))
    digests = stored(
        edited.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("_n").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
            paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("_edited")).alias("b"), F.col("_c").alias("c"),
        ),
        "digests",
    )
    sets = F.array(*[F.struct(F.lit(i).alias("version"), F.col(v).alias("digests")) for i, v in enumerate("ab")])
    whole = digests.select("_row", "a", "b").repartition(partitions(docs.sparkSession), "_row").select("_row", F.lit(FIRST).alias("third"), F.explode(sets).alias("s"))
    told = F.concat_ws(":", F.col("cell").cast("string"), F.col("n").cast("string"), F.lower(F.hex("digest")), F.lower(F.hex("check")))
    cell = F.struct("cell", told.alias("text"))
    first = sketches(whole.select("_row", "third", "s.version", "s.digests"), "_row", "version")
    cells = first.groupBy("_row").agg(*[F.collect_list(F.when(F.col("version") == i, cell)).alias(f"_{v}") for i, v in enumerate("ab")])  # at most 12 each
    found = differences(digests.select("_row", "a", "b", "c")).groupBy("_row").agg(*[F.max(F.when(F.col("pair") == i, F.col("found"))).alias(f"_to_{v}") for i, v in ((1, "b"), (2, "c"))])
    sizes = digests.select("_row", "doc_id", "n_chars", "edited_sha256", *[F.size(v).alias(f"_n_{v}") for v in "abc"])
    nothing = F.array().cast("array<struct<cell:int,text:string>>")

    def likeness(p: str) -> Column:
        both = F.col("_n_a") + F.col(f"_n_{p}")
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.coalesce(f"_to_{p}", F.lit(0)) / both)

    return sizes.join(cells, "_row", "left").join(found, "_row", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.coalesce("_a", nothing)).alias("fingerprint"),
        shown(F.coalesce("_b", nothing)).alias("edited_fingerprint"),
        likeness("b").alias("near_edited"),
        likeness("c").alias("near_next"),
    )
