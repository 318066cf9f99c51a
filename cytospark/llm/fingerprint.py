"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame and SQL functions only.

A text's units (its paragraphs, cut at line ends and after sentences) are digested, and each digest is XORed into three cells.
The low bits of a digest check the others, so that a cell with a single digest is known. Two versions' cells subtract (by
XOR), so that what they share cancels; cells that hold a single digest then give it away, it is taken out of its other cells,
and so on. If that gets stuck, the units are dealt to as many sketches as they need, and each of these that gets stuck is made
anew, larger and with other cells, as often as it takes.

Stored fingerprints can be compared without the texts, too, as far as their cells suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells in each of a fingerprint's three parts (powers of two, 16 at most), then in those of the sketches that units are dealt
#: to and that are made anew.
CELLS, ANEW = 8, (4, 8, 16)
#: Further tries, each with twice as many sketches of 48 cells as the one before. Tries fail independently.
TRIES = 12
#: Units of both versions for each sketch when they are dealt.
DEALT = 4
#: Bits of a digest that check the others.
CHECK = 20
#: Rounds of taking out; a round in which nothing is found ends it.
ROUNDS = 10
#: Ranges of ids for each shuffle partition, whose rows find their next document side by side.
RANGES = 4


def let(name: str, value: str, body: str) -> str:
    """SQL for body, in which name is value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bits(size: int) -> str:
    """A sketch's cells, as bits of a number."""
    return f"array({', '.join(f'{1 << i}L' for i in range(3 * size))})"


def placed(ids: str, size: int, seed: str) -> str:
    """Digests x with their cells, as the bits of k."""
    m = size - 1
    cell = lambda part: f"shiftleft(1L, int(shiftright(u.g, {16 * part}) & {m}) + {part * size})"
    return f"transform(transform({ids}, x -> named_struct('x', x, 'g', xxhash64(x, {seed}))), u -> named_struct('x', u.x, 'k', {cell(0)} | {cell(1)} | {cell(2)}))"


def cells(ids: str, size: int, seed: str) -> str:
    """The sketch of an array of digests."""
    return let("items", placed(ids, size, seed), f"transform({bits(size)}, bit -> aggregate(items, 0L, (s, e) -> if((e.k & bit) <> 0, s ^ e.x, s)))")


def less(one: str, two: str) -> str:
    """A sketch minus another."""
    return f"zip_with({one}, {two}, (p, q) -> p ^ q)"


def peeled(sketch: str, size: int, seed: str) -> str:
    """The digests that a difference of sketches holds; null if stuck. A cell of several digests may pass for one of a single digest;
    what is then taken out is put back later. So those count that were taken out an odd number of times."""
    low = (1 << CHECK) - 1
    pure = f"array_distinct(filter(st.cells, c -> c <> 0 and (xxhash64(c & {~low}L) & {low}) = (c & {low})))"
    taken = f"zip_with(st.cells, {bits(size)}, (c, bit) -> aggregate(items, c, (s, e) -> if((e.k & bit) <> 0, s ^ e.x, s)))"
    step = let("pure", pure, f"if(size(pure) = 0, st, {let('items', placed('pure', size, seed), f"named_struct('cells', {taken}, 'found', concat(st.found, pure))")})")
    odd = "if(size(array_distinct(st.found)) = size(st.found), st.found, filter(array_distinct(st.found), x -> size(filter(st.found, y -> y = x)) % 2 = 1))"
    start = f"named_struct('cells', {sketch}, 'found', cast(array() as array<bigint>))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {step}, st -> if(forall(st.cells, c -> c = 0), {odd}, null))"


def sound(found: str, one: str, two: str) -> str:
    """The digests found, if each of them is one of just one of the two versions' own; else null, as if stuck."""
    return let("got", found, f"if(forall(got, x -> array_contains({one}, x) <> array_contains({two}, x)), got, null)")


def recovered(one: str, two: str, first: str) -> str:
    """The digests in which two versions differ. one and two are their digests, first the difference of their fingerprints.
    Units are dealt in two steps, so that each is looked at for a few groups only. Null only if all tries fail, the last of them
    with 2 ** TRIES sketches for a few units."""

    def anew(size: int, seed: str, ids: str = "mine", others: str = "theirs") -> str:
        return sound(peeled(less(cells(ids, size, seed), cells(others, size, seed)), size, seed), ids, others)

    deal = lambda ids, seed, which, parts="parts": f"filter({ids}, x -> pmod(xxhash64(x, {seed}), {parts}) = {which})"
    again = let("ours", deal("mine", "t + 100", "s", "shiftleft(1, t)"), let("yours", deal("theirs", "t + 100", "s", "shiftleft(1, t)"), anew(16, "t + 200", "ours", "yours")))
    more = f"aggregate(sequence(1, {TRIES}), cast(null as array<bigint>), (got, t) -> coalesce(got, flatten(transform(sequence(0, shiftleft(1, t) - 1), s -> {again}))))"
    part = f"coalesce({', '.join(anew(size, str(11 + k)) for k, size in enumerate(ANEW))}, {more})"
    inner = let("mine", deal("some", 9, "q"), let("theirs", deal("others", 9, "q"), part))
    outer = let("some", deal("ones", 7, "p"), let("others", deal("twos", 7, "p"), f"flatten(transform(sequence(0, parts - 1), q -> {inner}))"))
    dealt = let("parts", f"greatest(1, cast(ceil(sqrt((size(ones) + size(twos)) / {DEALT})) as int))", f"flatten(transform(sequence(0, parts - 1), p -> {outer}))")
    return let("ones", one, let("twos", two, f"coalesce({sound(peeled(first, CELLS, '1'), 'ones', 'twos')}, {dealt})"))


def likeness(one: str, two: str, first: str) -> str:
    """1 minus the share of differing digests among all of two versions; 1 for two without any."""
    return f"if(size({one}) + size({two}) = 0, 1d, 1d - size({recovered(one, two, first)}) / (size({one}) + size({two})))"


def units(text: Column) -> Column:
    """The distinct digests of a text's units, which 44 bits tell apart: of 100,000 units two share a digest with a probability of
    0.0003."""
    parts = F.filter(F.split(text, r"\n|(?<=[.!?])[\x20\t]+"), lambda u: F.length(F.trim(u)) > 0)
    high = F.array_distinct(F.transform(parts, lambda u: F.shiftleft(F.shiftright(F.xxhash64(u), CHECK), CHECK)))
    return F.transform(high, lambda d: d.bitwiseOR(F.xxhash64(d).bitwiseAND((1 << CHECK) - 1)))


def written(sketch: str) -> Column:
    """A sketch as text: base 64 of its cells, 8 bytes each."""
    return F.translate(F.expr(f"base64(unhex(array_join(transform({sketch}, c -> lpad(hex(c), 16, '0')), '')))"), "\r\n", "")


def read_back(fingerprint: str) -> str:
    """SQL for the cells of a written sketch."""
    return let("h", f"hex(unbase64({fingerprint}))", "transform(sequence(0, length(h) div 16 - 1), i -> cast(conv(substring(h, 16 * i + 1, 16), 16, -10) as bigint))")


def compared(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """pairs with changes: the unit digests in which the documents of two stored fingerprints (as fingerprints() writes them) differ,
    from the fingerprints alone; null if they differ in more than the cells can tell, which takes the texts (differing())."""
    return pairs.withColumn("changes", F.expr(peeled(less(read_back(f"`{one}`"), read_back(f"`{two}`")), CELLS, "1")))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the row after it by doc_id and text, for the last row of the first.
    Rows are dealt to ranges of ids, each sorted by itself; the first rows of a range are also sent to the range before. The
    driver gets the ranges' bounds: RANGES for each shuffle partition."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    row = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()
    bounds = sorted({row["least"], *(row["cuts"] or [])} - {None}) or [0]
    last = len(bounds) - 1
    # found in two steps, so that a row isn't held against every bound
    step = max(1, round(len(bounds) ** 0.5))
    listed = lambda own: "array(" + ", ".join(f"bigint('{b}')" for b in own) + ")"
    below = lambda own: f"size(filter({own}, c -> c <= _key))"
    part = F.expr(let("coarse", f"{below(listed(bounds[::step]))} - 1", f"coarse * {step} + {below(f'slice({listed(bounds)}, coarse * {step} + 1, {step})')} - 1"))
    keyed = docs.withColumn("_key", key).withColumn("_part", part)
    # (range, whether it is only there as the next of that range's last row, or comes after all of it)
    home, guest = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"), F.lit(0).alias("late")), F.struct(F.when(F.col("_part") == 0, last).otherwise(F.col("_part") - 1).alias("part"), F.lit(True).alias("guest"), F.lit(1).alias("late"))
    dealt = keyed.withColumn("_to", F.explode(F.when(F.expr(f"_key = get({listed(bounds)}, _part)"), F.array(home, guest)).otherwise(F.array(home)))).select("doc_id", "text", "_key", "_to.*")
    order = Window.partitionBy("part").orderBy("late", "_key", F.col("text").asc_nulls_first())
    return dealt.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(order)).where("not guest").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row. Equal texts have equal fingerprints; a null text counts as empty. No shuffle."""
    own = docs.select(docs[doc_id].alias("doc_id"), units(F.coalesce(docs[text], F.lit(""))).alias("ids"))
    return own.select("doc_id", written(cells("ids", CELLS, "1")).alias("fingerprint"))


def differing(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """pairs with changes: the unit digests (x) that only the text of one (n = 1) or of two (n = -1) has."""
    own = pairs.select("*", units(F.coalesce(one, F.lit(""))).alias("_one"), units(F.coalesce(two, F.lit(""))).alias("_two"))
    found = F.expr(recovered("_one", "_two", less(cells("_one", CELLS, "1"), cells("_two", CELLS, "1"))))
    sign = F.transform(found, lambda x: F.struct(x.alias("x"), F.when(F.array_contains("_one", x), 1).otherwise(-1).alias("n")))
    return own.withColumn("changes", sign).drop("_one", "_two")


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The edited
    text has the next row's beginning in place of its last quarter. Null texts count as empty; a null id comes first; rows
    with equal ids follow one another by text; the only row is its own next; an empty table gives an empty one."""
    rows = with_next(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "next_text").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), units(F.col("text")).alias("ids"), units(F.col("edited")).alias("edited_ids"), units(F.col("next_text")).alias("next_ids"))
    sketch = lambda c: F.expr(cells(c, CELLS, "1"))
    rows = rows.select("*", sketch("ids").alias("cells"), sketch("edited_ids").alias("edited_cells"), sketch("next_ids").alias("next_cells"))
    near = lambda c: F.expr(likeness("ids", f"{c}_ids", less("cells", f"{c}_cells"))).alias(f"near_{c}")
    return rows.select("doc_id", "n_chars", "edited_sha256", written("cells").alias("fingerprint"), written("edited_cells").alias("edited_fingerprint"), near("edited"), near("next"))
