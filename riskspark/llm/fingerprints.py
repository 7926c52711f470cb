"""Document fingerprints: invertible Bloom lookup sketches of paragraph
digests, with DataFrame operations only.

A text is cut into paragraphs: lines, cut again at some sentence ends (chosen
by the letter before the full stop, so equal passages are cut alike), and
what is still longer than 96 code points every 96 from its start, whatever
the script.  White space before a paragraph does not count.  An edit leaves
every paragraph before it as it was, so a text of 192 code points or more
shares one at least with its edited text.
Each distinct digest goes into one cell of each of three tables; a cell keeps
a count and the exclusive or of its digests and of their checks.  Sketches of
one size subtract cell by cell; what remains is the difference of the two
texts, and peeling cells that hold one digest recovers it.  If that stops
early the sketches are made twice as large, and again.  The recovered
difference gives the likeness (shared digests over all digests).

Defined cases: null, empty and blank texts have an empty sketch; two such texts
are alike (1), such a one and another text are not (0); rows with a null id
have no next document (the next text reads as empty) and are nobody's next;
rows repeating an id are ordered by a hash of their text, equal rows count
once in that order; other columns are not read; a table of one document is
its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.staging import Stage
from riskspark.plans.strategy import join_small

# from a character that is no white space to a sentence end, the line's end or the 96th code point
PARAGRAPH = r"\S[^\n]{0,95}?(?:(?<=[aeiou][.!?])(?=\s)|(?=\n)|\z)|\S[^\n]{95}"
ROUNDS = 20
RETRIES = 3


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is ``value``, evaluated once.  Written
    as an aggregate over nothing: transform would copy the body's result."""
    return f"aggregate(CAST(array() AS array<int>), {value}, (held, none) -> held, {name} -> {body})"


def _cells(digests: str, sign: str, size: str) -> str:
    """The three cells of every digest of the array; ``size`` is a power of
    two, and the digest's own bits choose the cells."""
    one = ", ".join(f"named_struct('c', (shiftrightunsigned(v.k, {21 * j}) & ({size} - 1)) + {j} * {size}, 'n', {sign}, "
                    "'k', v.k, 'h', v.h)" for j in range(3))
    return f"flatten(transform(transform({digests}, k -> named_struct('k', k, 'h', xxhash64(k, 99))), v -> array({one})))"


def _merged(cells: str) -> str:
    """Cells added up by number; empty ones go.  ``s`` are the sorted numbers
    of the cells ``a`` with their places below them (sorting longs takes a
    fraction of the time that sorting structs does), ``f`` the places in
    ``s`` where a new number begins; a run is added up in one pass, so the
    work grows with the cells and not with their square."""
    keys = "sort_array(transform(a, (x, i) -> shiftleft(x.c, 32) + i))"
    begins = ("filter(transform(s, (q, i) -> if(shiftright(get(s, i - 1), 32) = shiftright(q, 32), NULL, i)), "
              "i -> i IS NOT NULL)")

    def cell(q: str) -> str:
        return f"get(a, CAST({q} & 4294967295 AS INT))"

    total = ("aggregate(slice(s, b + 1, coalesce(get(f, t + 1), size(s)) - b), "
             f"named_struct('c', {cell('get(s, b)')}.c, 'n', 0, 'k', 0L, 'h', 0L), "
             f"(acc, q) -> named_struct('c', acc.c, 'n', acc.n + {cell('q')}.n, 'k', acc.k ^ {cell('q')}.k, 'h', acc.h ^ {cell('q')}.h))")
    run = f"if(coalesce(get(f, t + 1), size(s)) = b + 1, {cell('get(s, b)')}, {total})"
    sums = let("a", cells, let("s", keys, let("f", begins, f"transform(f, (b, t) -> {run})")))
    return f"filter({sums}, x -> x.n <> 0 OR x.k <> 0 OR x.h <> 0)"


def sketch(d: str, size: str) -> str:
    """SQL of the sketch of digest array ``d`` with ``size`` cells in each table."""
    return _merged(_cells(d, "1", size))


def subtract(a: str, b: str) -> str:
    """SQL of sketch ``a`` minus sketch ``b``."""
    return _merged(f"flatten(array({a}, transform({b}, x -> named_struct('c', x.c, 'n', -x.n, 'k', x.k, 'h', x.h))))")


def peel(cells: str, size: str) -> str:
    """SQL: (left, plus, minus): cells not resolved, digests only in the first and only in the second."""
    # distinct longs are found by hashing, distinct structs by comparing each with each
    def pure(sign: str) -> str:
        return f"array_distinct(transform(filter(st.left, x -> x.n = {sign} AND x.h = xxhash64(x.k, 99)), x -> x.k))"

    left = _merged(f"flatten(array(st.left, {_cells('p.plus', '-1', size)}, {_cells('p.minus', '1', size)}))")
    after = f"named_struct('left', {left}, 'plus', st.plus + size(p.plus), 'minus', st.minus + size(p.minus))"
    found = f"named_struct('plus', {pure('1')}, 'minus', {pure('-1')})"
    step = f"if(size(st.left) = 0, st, {let('p', found, f'if(size(p.plus) + size(p.minus) = 0, st, {after})')})"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('left', {cells}, 'plus', 0, 'minus', 0), (st, i) -> {step})")


def sketched(d: str) -> str:
    """SQL: digest array ``d`` with its table size and its sketch."""
    size = f"CAST(pow(2, ceil(log2(1 + 0.9 * size({d})))) AS BIGINT)"
    return let("w", size, f"named_struct('d', {d}, 'size', w, 'cells', {sketch(d, 'w')})")


def likeness(a: str, b: str) -> str:
    """SQL: shared digests over all digests of two sketched arrays, by
    subtracting and peeling their sketches at the larger of the two sizes,
    at larger ones where that fails."""
    at = [f"if({x}.size = w * g, {x}.cells, {sketch(f'{x}.d', '(w * g)')})" for x in (a, b)]
    tried = let("o", peel(subtract(*at), "(w * g)"), "named_struct('done', size(o.left) = 0, 'plus', o.plus, 'minus', o.minus)")
    # beyond the last size, which a random failure passes about once in a billion, the digests themselves are compared
    ratio = (f"if(m.done, (size({a}.d) - m.plus) / (size({a}.d) + m.minus), (size({a}.d) - size(array_except({a}.d, {b}.d))) "
             f"/ (size({a}.d) + size(array_except({b}.d, {a}.d))))")
    sizes = ", ".join(f"{1 << retry}L" for retry in range(RETRIES))
    found = (f"aggregate(array({sizes}), named_struct('done', false, 'plus', 0, 'minus', 0), "
             f"(m, g) -> if(m.done, m, {tried}), m -> {ratio})")
    return f"if(size({a}.d) + size({b}.d) = 0, 1.0D, {let('w', f'greatest({a}.size, {b}.size)', found)})"


def as_text(x: str) -> str:
    """SQL: a sketched array as a string: number of digests, table size and MD5 of the cells."""
    cells = f"transform({x}.cells, v -> concat_ws(':', v.c, v.n, hex(v.k), hex(v.h)))"
    return f"concat_ws('/', size({x}.d), {x}.size, md5(concat_ws('|', {cells})))"


def successors(docs: DataFrame, stage: Stage) -> DataFrame:
    """(id, th, half, next_id, next_th): each document's key, the length of
    the part it replaces, and the key after it; the last is followed by the
    first.  Keys are dealt by range and numbered within each part; only the
    first key of each part is looked at across parts."""
    keys = docs.where("id IS NOT NULL").groupBy("id", "th").agg(F.max("half").alias("half"))
    keys = stage.write(keys.repartitionByRange("id", "th").withColumn("part", F.spark_partition_id()), "keys")
    in_part = Window.partitionBy("part").orderBy("id", "th")
    after = F.lead(F.struct("id", "th")).over(in_part)
    firsts = keys.groupBy("part").agg(F.min(F.struct("id", "th")).alias("first"))
    parts = Window.orderBy("part")          # one row per part
    follow = F.coalesce(F.lead("first").over(parts), F.first("first").over(parts))
    firsts = firsts.select("part", follow.alias("follow"))
    return (keys.withColumn("after", after).join(F.broadcast(firsts), "part")       # one row per part
            .withColumn("after", F.coalesce("after", "follow"))
            .select("id", "th", "half", F.col("after.id").alias("next_id"), F.col("after.th").alias("next_th")))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    stage = Stage(docs.sparkSession, "fingerprints")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("th"),
                       F.length(whole).alias("n_chars")).withColumn("half", F.expr("n_chars DIV 2"))
    succ = stage.write(successors(rows.select("id", "th", "half"), stage), "successors")
    # each document sends to the one before it the start of its text and its digests
    ask = succ.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"),
                      F.col("th").alias("to_th"), F.col("half").alias("take"))
    first_copy = rows.select("id", "th", "text").where("id IS NOT NULL")
    sent = (join_small(first_copy, ask, ["id", "th"])
            .select("to_id", "to_th", F.expr("left(text, CAST(take AS INT))").alias("start"), digests(F.col("text")).alias("next_d"))
            .groupBy("to_id", "to_th").agg(F.first("start").alias("start"), F.first("next_d").alias("next_d")))
    df = rows.join(sent, (F.col("id") == F.col("to_id")) & (F.col("th") == F.col("to_th")), "left")
    edited = F.concat(F.expr("left(text, CAST(n_chars - half AS INT))"), F.coalesce("start", F.lit("")))
    df = df.select("id", "n_chars", digests(F.col("text")).alias("d"), F.coalesce("next_d", F.expr("CAST(array() AS array<bigint>)")).alias("nd"),
                   edited.alias("edited"))
    df = df.select("id", "n_chars", "d", "nd", digests(F.col("edited")).alias("ed"), F.sha2("edited", 256).alias("edited_sha256"))
    df = df.select("id", "n_chars", "edited_sha256", *[F.expr(sketched(d)).alias(name) for d, name in (("d", "own"), ("ed", "changed"), ("nd", "after"))])
    return df.select(F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
                     F.expr(as_text("own")).alias("fingerprint"), F.expr(as_text("changed")).alias("edited_fingerprint"),
                     F.expr(likeness("own", "changed")).alias("near_edited"), F.expr(likeness("own", "after")).alias("near_next"))
