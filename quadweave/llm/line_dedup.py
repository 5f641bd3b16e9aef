"""Line deduplication as an exact set-similarity join, in DataFrame functions only.

A line's tokens are its words, the second and further occurrences of a word as tokens of their own. Two lines match if their token sets have a Jaccard
similarity of 0.8 or more. A line goes if any earlier line (by document id, then line) matches it.

1. Equal lines are found by hashes: of those only the first goes on, so copies of any number cost one line.
2. All words are counted. A slot of 2**SLOT_BITS holds the level (half steps of log2) of its most frequent word; the levels
   below that of the most frequent quarter of the slots count as 0. A token's number is its level, then its hash, so
   that sorted numbers stand in order of rarity. A slot has a bit for each value of the next SEVERAL_BITS bits of a
   hash as well: set if any word there occurs more than once. Where it is not, no other line has the word.
3. Lines are joined on the tokens of their prefixes (the rarest n - ceil(0.8 n) + 1; of the
   shorter one n - ceil(8/9 n) + 1 suffice) that occur elsewhere, with length, positional and parity filters in the
   join condition. Tokens are dealt by classes of the line's size, so that few lines whose sizes rule each other out are compared: a line is in its
   own class, and with those tokens that a longer match may share first, as a guest, also in the class above; two guests are not compared there.
   Of long lines k - 1 more tokens are taken, and a pair must share k. The parities of token counts in 128 hash buckets differ in at most as many places as the two
   sets have tokens that only one of them has: too many rule a pair out.
   This is done twice. First the lines of a token are compared with each other if they are no more than NEAR, else the earliest with all
   others, which settles most of a group of near-copied lines, however large. Tokens with more lines than that are open: for
   those, every line is then compared with the later ones that nothing has matched so far, as a line that goes needs no second reason.
   Whether it has been matched is looked up once for each line, not for each of its tokens.
   Very frequent tokens are dealt into salts in the first comparison and are always open.
4. Candidate pairs are verified on the full token sets; of a pair the later line goes.

What is broadcast is counted first: above MAX_SENT line numbers the same join is shuffled.

Defined results: blank lines are no lines: they are never removed or matched; null texts have no
lines; null ids come last; rows with one id and one text are one document; an empty table gives an empty result;
extra columns of any name pass through remove_lines().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadweave.llm.common import documents, free_name
from quadweave.session import Table

SLOT_BITS, CHUNK_BITS, SEVERAL_BITS = 18, 6, 6
PERCENT = 80
#: Lines of one token up to which all are compared with each other at once.
NEAR = 256
#: A line of n tokens must share 1 + n div PER_SHARED prefix tokens with another, MAX_SHARED at most.
PER_SHARED, MAX_SHARED = 50, 16
#: Classes of sizes in a doubling; at most three, so that a line and a longer match are one class apart at most.
CLASSES = 1
#: Rows of one token in a task, about; more are salted.
SALT_ROWS_BITS = 13
#: Words of a line up to which repeated words are numbered by looking back.
SHORT_LINE = 1000
#: Line numbers that may be broadcast (at most 40 bytes each).
MAX_SENT = 1_000_000

_LAST = 2**63 - 1
#: In size_at, the bit of a row that is a guest in its class; the place is below it.
_GUEST = 2**31
_LEVEL_AT = 57
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A line's document, and the hash of its text with the line's number in it.
_PLACE = ("doc", "at_line")


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _words(line: Column) -> Column:
    """Words of a text that has one."""
    return F.split(F.btrim(line, F.lit(_BLANKS)), "[\\x20\\x09-\\x0D]+")


def _slot(token: Column) -> Column:
    return token.bitwiseAND(F.lit(2**SLOT_BITS - 1)).cast("int")


# ---------------------------------------------------------------- documents and lines


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, v, text) of every document with a text, repeated rows once; v is the text's hash."""
    text = F.col(text_col).cast("string")
    all_ = docs.select(_doc(id_col).alias("doc"), F.hash(text).alias("v"), text.alias("text")).where("text is not null")
    repeated = Table(all_.groupBy("doc", "v").count().where("count > 1").select("doc", "v"))
    n = repeated.df.count()
    if not n:
        return all_
    known = F.broadcast(repeated.df) if n <= MAX_SENT else repeated.df
    return all_.join(known, ["doc", "v"], "left_anti").unionByName(all_.join(known, ["doc", "v"], "left_semi").dropDuplicates(["doc", "v"]))


def _with_numbers(own: DataFrame, places: DataFrame, doc: str, v: str, out: str, how: str) -> DataFrame:
    """own with out, the array of line numbers that places has for a document."""
    by = Table(places.groupBy("doc", F.shiftright("at_line", 32).cast("int").alias("v")).agg(F.collect_set(F.col("at_line").bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias("n"))).df
    small = (by.agg(F.sum(F.size("n"))).first()[0] or 0) <= MAX_SENT
    keys = [free_name(own, x) for x in ("doc_of", "v_of")]
    numbers = (F.broadcast(by) if small else by).toDF(*keys, out)
    return own.join(numbers, (F.col(doc) == F.col(keys[0])) & (F.col(v) == F.col(keys[1])), how).drop(*keys)


def lines(own: DataFrame, *where: Column) -> DataFrame:
    """(doc, at_line, line) of every line with a word, of (doc, v, text); where: conditions on line_no and own's columns."""
    number = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(F.col("line_no").cast("long"))
    # outer: else a filter on the array's size would be inferred, and the array made twice
    rows = own.select("*", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where(_has_word(F.col("line")))
    for w in where:
        rows = rows.where(w)
    return rows.select("doc", number.alias("at_line"), "line")


def copies(own: DataFrame) -> DataFrame:
    """(doc, at_line), written: lines that are equal to an earlier one."""
    keyed = lines(own).select(*_PLACE, F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))
    several = Table(keyed.groupBy("k1", "k2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first"))
    known = F.broadcast(several.df) if several.df.count() <= MAX_SENT // 4 else several.df
    out = Table(keyed.join(known, ["k1", "k2"]).where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE)).df
    several.drop()
    return out


# ---------------------------------------------------------------- tokens


def _several_bit(token: Column) -> Column:
    return F.shiftright(token, SLOT_BITS).bitwiseAND(F.lit(2**SEVERAL_BITS - 1)).cast("int")


def levels(own: DataFrame) -> tuple[Column, Column]:
    """Two arrays with an item for each slot: a level, 0 for rare words, else twice log2 of how often the slot's most frequent word occurs;
    and bits that tell which of its words may occur more than once.

    A table of one row holds them, which subqueries read: as literals they would stand in every plan.
    """
    words = own.where(_has_word(F.col("text"))).select(F.explode_outer(_words(F.col("text"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").alias("t")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(63), F.floor(2 * F.log2(F.max("n")))).cast("int")
    several = F.bit_or(F.when(F.col("n") > 1, F.call_function("shiftleft", F.lit(1).cast("long"), _several_bit(F.col("t")))).otherwise(F.lit(0).cast("long")))
    slots = counts.groupBy(_slot(F.col("t")).alias("slot")).agg(level.alias("level"), several.alias("several"))
    written = Table(slots.groupBy(F.shiftright("slot", CHUNK_BITS).alias("chunk")).agg(F.collect_list(F.struct("slot", "level", "several")).alias("x")))
    chunks = written.df
    share = dict(chunks.select(F.explode("x.level").alias("level")).groupBy("level").count().collect())
    least = next(v for v in range(1, 65) if sum(n for k, n in share.items() if k >= v) <= 2**SLOT_BITS // 4)
    # every chunk has all its slots, so that the chunks in order are the array
    first = F.col("chunk") * 2**CHUNK_BITS
    item = lambda name: F.map_from_entries(F.transform(F.coalesce("x", F.array().cast("array<struct<slot:int,level:int,several:bigint>>")), lambda y: F.struct(y["slot"], y[name])))
    each = lambda m, kind: F.transform(F.sequence(first, first + 2**CHUNK_BITS - 1), lambda k: F.coalesce(F.element_at(m, k), F.lit(0)).cast(kind))
    spark = own.sparkSession
    every = spark.range(0, 2 ** (SLOT_BITS - CHUNK_BITS)).select(F.col("id").cast("int").alias("chunk"))
    whole = every.join(chunks, "chunk", "left").select("chunk", item("level").alias("m"), item("several").alias("b")).select("chunk", each("m", "int").alias("a"), each("b", "long").alias("b"))
    whole = whole.select("chunk", F.transform("a", lambda v: F.when(v >= least, v).otherwise(0).cast("byte")).alias("a"), "b")
    ordered = whole.agg(F.array_sort(F.collect_list(F.struct("chunk", "a", "b"))).alias("x"))
    out = Table(ordered.select(*[F.flatten(f"x.{c}").alias(c) for c in "ab"])).df
    written.drop()
    return out.select("a").scalar(), out.select("b").scalar()


def _numbered(s: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(hash, how many equal ones stand before it) of sorted hashes."""
    same = lambda x, i, k: F.get(s, i - k).eqNullSafe(x)

    def short(x: Column, i: Column) -> Column:
        out = F.when(~same(x, i, 1), use(x, F.lit(0)))
        for k in range(2, 5):
            out = out.when(~same(x, i, k), use(x, F.lit(k - 1)))
        return out.otherwise(use(x, i + 1 - F.array_position(s, x).cast("int")))

    def long(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i)))
        runs = lambda p: F.transform(p, lambda b, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(p, k + 1), F.size(s)) - b - 1), lambda n: use(F.get(s, b), n)))
        return F.flatten(_once(begins, runs))

    return F.when(F.size(s) <= SHORT_LINE, F.transform(s, short)).otherwise(long(s))


def token_sets(rows: DataFrame, ranks: Column) -> DataFrame:
    """(doc, at_line, t) of lines. The subquery is a column of its own, as functions can't hold one; the optimizer merges both steps."""
    return rows.select(*_PLACE, "line", ranks.alias("ranks")).select(*_PLACE, ordered_tokens(F.col("line"), F.col("ranks")).alias("t"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_tokens(line: Column, ranks: Column) -> Column:
    """Tokens of a line as numbers in order of rarity."""
    slot = F.lit(2 ** (SLOT_BITS + SEVERAL_BITS) - 1).cast("long")
    # a further occurrence keeps its word's slot and bit there
    token = lambda x, n: F.xxhash64(x, n).bitwiseAND(F.bitwise_not(slot)).bitwiseOR(x.bitwiseAND(slot))

    def numbered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.get(s, i - 1).eqNullSafe(x))  # all occurrences but the first
        return F.concat(F.array_distinct(s), _once(again, lambda a: F.when(F.size(a) == 0, a).otherwise(_numbered(a, token))))

    tokens = _once(F.sort_array(F.transform(_words(line), lambda w: F.xxhash64(w))), numbered)
    level = lambda r: F.transform(tokens, lambda t: t.bitwiseAND(F.lit(2**_LEVEL_AT - 1)).bitwiseOR(F.shiftleft(F.get(r, _slot(t)).cast("long"), _LEVEL_AT)))
    return F.sort_array(_once(ranks, level))


def _shared(n: str) -> str:
    """How many tokens of their prefixes two lines of n tokens or more must share: prefixes are longer by all of them but one."""
    return f"(1 + least({n} div {PER_SHARED}, {MAX_SHARED} - 1))"


def _class(n: str) -> str:
    """Class of sizes."""
    return f"int(floor({CLASSES} * log2({n})))"


def _up(n: str, at: str) -> str:
    """The largest size of a match, n at least, that may share the token at this place among the first of all they share."""
    p, q = PERCENT, 100 + PERCENT
    return f"greatest({n}, least(100 * {n} div {p}, ({n} - {at} + {_shared(n)} - 1) * {q} div {p} - {n}))"


def spread(firsts: DataFrame, ranks: Column, several: Column | None = None) -> DataFrame:
    """(token, salt, doc, at_line, size_at, p1, p2): a row for each token of each line's prefix, two if it is a guest in the class above.

    Words that occur only once make no rows if several is given, as nothing can share them.

    token is the hash of token and class, with the token's level; size_at has the size of the set, whether the row is a guest, and the token's place.
    """
    sets = token_sets(firsts, ranks)
    n = F.size("t")
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(t)))
    odd = lambda t: t.bitwiseAND(F.lit(64)) != 0
    parities = [parity(F.filter("t", odd)).alias("p1"), parity(F.filter("t", lambda t: ~odd(t))).alias("p2")]
    prefix = F.slice("t", F.lit(1), n - F.expr(f"int(({PERCENT} * size(t) + 99) div 100 - {_shared('size(t)')})"))
    # what is made of a whole line is made before its rows are
    whole = sets.select(*_PLACE, F.shiftleft(n.cast("long"), 32).alias("n"), *parities, prefix.alias("prefix"))
    rows = whole.select(*_PLACE, "n", "p1", "p2", F.posexplode_outer("prefix").alias("at", "token"))
    if several is not None:
        bits = F.get(several, _slot(F.col("token")))
        rows = rows.where(F.call_function("shiftright", bits, _several_bit(F.col("token"))).bitwiseAND(F.lit(1).cast("long")) == 1)
    size = "shiftright(n, 32)"
    guests = F.expr(f"if({_class(_up(size, 'at'))} > {_class(size)}, array(0, 1), array(0))")
    rows = rows.select("*", F.explode_outer(guests).alias("guest"))
    token = F.expr(f"xxhash64(token, {_class(size)} + guest) & {2**_LEVEL_AT - 1} | token & {-(2**_LEVEL_AT)}")
    rows = rows.select(token.alias("token"), *_PLACE, F.expr(f"n | if(guest = 1, {_GUEST}, 0) | at").alias("size_at"), "p1", "p2")
    out = rows.select("token", _salt(), *_PLACE, "size_at", "p1", "p2")
    # never null, and told so: else the join would infer filters for one side alone, and each side would have a shuffle of its own
    return out.select(*[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in out.dtypes])


def _salt_bits() -> Column:
    return F.greatest(F.lit(0), F.expr(f"int(shiftrightunsigned(token, {_LEVEL_AT}) div 2)") - SALT_ROWS_BITS)


def _salt() -> Column:
    return F.pmod(F.hash(*_PLACE).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), _salt_bits())).cast("int").alias("salt")


# ---------------------------------------------------------------- pairs


_DIFFER = "(bit_count(p1_a ^ p1_b) + bit_count(p2_a ^ p2_b))"
#: How far apart a pair's parities are for its size.
_APART = f"{_DIFFER} * 1000 div (shiftright(size_at_a, 32) + shiftright(size_at_b, 32))"


def _need() -> Column:
    """How many prefix tokens a pair must share."""
    return F.expr(_shared("shiftright(least(size_at_a, size_at_b), 32)")).alias("need")


def _able() -> str:
    """Whether the filters let a pair (columns ending in _a, _b) through; integers all through."""
    p, q = PERCENT, 100 + PERCENT
    n, at = (lambda s: f"shiftright(size_at_{s}, 32)"), (lambda s: f"(size_at_{s} & {_GUEST - 1})")
    # of the tokens that a pair must share, the first ones: what it shares lies behind them, but for those
    k = _shared(f"least({n('a')}, {n('b')})")
    behind = lambda s: f"({n(s)} - {at(s)} + {k} - 1) * {q} >= {p} * ({n('a')} + {n('b')})"
    return f"""100 * least({n("a")}, {n("b")}) >= {p} * greatest({n("a")}, {n("b")})
        and (size_at_a & size_at_b & {_GUEST}) = 0
        and {_DIFFER} * {q} <= {100 - p} * ({n("a")} + {n("b")})
        and (doc_a < doc_b or doc_a = doc_b and at_line_a < at_line_b)
        and {behind("a")} and {behind("b")}
        and (least({at("a")}, {at("b")}) + least({n("a")} - {at("a")}, {n("b")} - {at("b")})) * {q} >= {p} * ({n("a")} + {n("b")})"""


_ROW = (*_PLACE, "size_at", "p1", "p2")


def _sides(a: DataFrame, b: DataFrame, on: list[str], more_a: tuple[str, ...] = (), more_b: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a and b joined; more_a, more_b: further columns of theirs."""
    left, right = (x.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in (*_ROW, *more)]) for x, s, more in ((a, "a", more_a), (b, "b", more_b)))
    return left.join(right, on)


_PAIR = [f"{c}_{s}" for s in "ab" for c in _PLACE]


def _of(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(*[F.col(f"{c}_{side}").alias(c) for c in _PLACE])


def _links(pairs: DataFrame, own: DataFrame, ranks: Column, only: str = "true") -> DataFrame:
    """Verified pairs of (pairs with apart and need, a row for each token shared): at least one for each later line that has any.

    Pairs with fewer rows than need, or for which the aggregate only is false, are left out. The likeliest earlier line of each goes
    first; the others are for lines that this leaves.
    """
    counted = pairs.groupBy(*_PAIR).agg(F.min("apart").alias("apart"), F.count("*").alias("n"), F.min("need").alias("need"), F.expr(only).alias("only"))
    once = Table(counted.where("n >= need and only").drop("n", "need", "only"))
    first = F.min_by(F.struct("doc_a", "at_line_a"), F.struct("apart", "doc_a", "at_line_a")).alias("x")
    best = Table(once.df.groupBy("doc_b", "at_line_b").agg(first).select("x.*", "doc_b", "at_line_b").select(*_PAIR))
    links = verified(best.df, own, ranks)
    rest = Table(once.df.join(links.select("doc_b", "at_line_b"), ["doc_b", "at_line_b"], "left_anti").join(best.df, _PAIR, "left_anti").select(*_PAIR))
    out = links.unionByName(verified(rest.df, own, ranks))
    for table in (once, best, rest):
        table.drop()
    return out


def verified(pairs: DataFrame, own: DataFrame, ranks: Column) -> DataFrame:
    """Of pairs (written) those whose full token sets are alike enough."""
    met = _with_numbers(own, _of(pairs, "a").unionByName(_of(pairs, "b")), "doc", "v", "met", "inner")
    sets = Table(token_sets(lines(met, F.array_contains("met", F.col("line_no"))), ranks))
    both = F.size(F.array_intersect("t_a", "t_b"))
    sides = [sets.df.toDF(*[f"{c}_{s}" for c in (*_PLACE, "t")]) for s in "ab"]
    links = Table(
        pairs.join(sides[0], ["doc_a", "at_line_a"])
        .join(sides[1], ["doc_b", "at_line_b"])
        .where(both * 100 >= (F.size("t_a") + F.size("t_b") - both) * PERCENT)
        .select(*_PAIR)
    )
    sets.drop()
    return links.df


def open_lines(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, at_line, p1, p2, tokens, unmet): a row for each line of rows of open tokens; tokens: (token, size_at); unmet is 1 for lines that nothing has matched, else 0.

    A line's tokens are gathered first, as it is lines that have been matched. Both steps are dealt by line: one shuffle.
    """
    doc, at_line = (F.col(f"{c}_b").alias(c) for c in _PLACE)
    own = rows.groupBy(doc, at_line).agg(F.first("p1_b").alias("p1"), F.first("p2_b").alias("p2"), F.collect_list(F.struct("token", F.col("size_at_b").alias("size_at"))).alias("tokens"))
    met = _of(links, "b").distinct().withColumn("met", F.lit(1))
    return own.join(met, list(_PLACE), "left").select(*_PLACE, "p1", "p2", "tokens", (1 - F.coalesce("met", F.lit(0))).alias("unmet"))


def _compared(own: DataFrame) -> DataFrame:
    """Pairs of lines (of open_lines) that share a token, the later one unmet, and pass the filters; a row for each token shared."""
    rows = own.select(*_PLACE, "p1", "p2", "unmet", F.explode_outer("tokens").alias("x")).select(F.col("x.token").alias("token"), F.col("x.size_at").alias("size_at"), *_PLACE, "p1", "p2", "unmet")
    rows = rows.select(*[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in rows.dtypes])
    # of both sides, so that they read one shuffle
    return _sides(rows, rows, ["token"], ("unmet",), ("unmet",)).where(f"2 * unmet_b + unmet_a >= 2 and {_able()}")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, at_line) of every line that goes, and verified links between lines, one or more for each line that goes for likeness."""
    own = texts(docs, id_col, text_col)
    ranks, several = levels(own)
    equal = copies(own)
    firsts = lines(_with_numbers(own, equal, "doc", "v", "equal", "left"), ~F.coalesce(F.array_contains("equal", F.col("line_no")), F.lit(False)))

    group = Window.partitionBy("token", "salt")
    rows = spread(firsts, ranks, several)
    # both sides of the join read one shuffle; of a token with more than NEAR lines the first one alone is compared
    ranked = rows.withColumn("rank", F.row_number().over(group.orderBy(*_PLACE)))
    firsts_ = ranked.withColumn("rows", F.count("*").over(group)).where(f"rows <= {NEAR} or rank = 1")
    sides = _sides(firsts_, ranked, ["token", "salt"], ("rank", "rows"), ("rank",))
    pair = F.expr(f"rank_a < rank_b and {_able()}")
    # a token's first row brings all rows of an open token once
    open_ = (F.col("rank_a") == 1) & ((F.col("rows_a") > NEAR) | (_salt_bits() > 0))
    found = Table(sides.select("token", *_PAIR, "size_at_b", "p1_b", "p2_b", pair.alias("pair"), open_.alias("open"), F.expr(_APART).alias("apart"), _need()).where("pair or open"))
    links = _links(found.df.where("pair").select(*_PAIR, "apart", "need"), own, ranks)
    opened = found.df.where("open")
    if not opened.isEmpty():
        rest = Table(open_lines(opened, links))
        later = _compared(rest.df)
        more = later.select(*_PAIR, F.expr(_APART).alias("apart"), _need(), F.lit(True).alias("open"))
        # what such pairs share of other tokens was found before
        before = found.df.where("pair").join(_of(links, "b").distinct().toDF("doc_b", "at_line_b"), ["doc_b", "at_line_b"], "left_anti").select(*_PAIR, "apart", "need", F.lit(False).alias("open"))
        links = links.unionByName(_links(more.unionByName(before), own, ranks, "max(open)"))
        rest.drop()
    found.drop()
    return equal.unionByName(_of(links, "b").distinct()), links


# ---------------------------------------------------------------- results


def _with_removed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with an array of the numbers of the lines that go, null for none, and that column's name."""
    doc, v, gone = (free_name(docs, x) for x in ("doc", "v", "gone"))
    own = docs.withColumns({doc: _doc("doc_id"), v: F.hash(F.col("text").cast("string"))})
    return _with_numbers(own, removed_lines(docs)[0], doc, v, gone, "left").drop(doc, v), gone


def _kept_text(gone: str) -> Column:
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs with later matches cut out of text; a text may become empty, its row stays."""
    own, gone = _with_removed(docs)
    return own.select(*[_kept_text(gone).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: lines, removed lines and what is kept of every document."""
    text = F.coalesce("text", F.lit(""))
    own, gone = _with_removed(documents(spark, sf_dir))
    return own.select(
        "doc_id",
        F.size(F.filter(F.split(text, "\n"), _has_word)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_kept_text(gone), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


#: The same rows in DuckDB SQL: lines that share one of their rarest words, verified on whole sets.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
u AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id, i, w) AS k
      FROM (SELECT doc_id, i, unnest(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS w FROM r0)),
l AS MATERIALIZED (SELECT doc_id, i, x, coalesce(ws, []) AS ws FROM r0 LEFT JOIN (SELECT doc_id, i, list_sort(list(w || ' ' || k)) AS ws FROM u GROUP BY ALL) USING (doc_id, i)),
c AS MATERIALIZED (SELECT ws, len(ws) AS n, min((doc_id, i)) AS f FROM l WHERE len(ws) > 0 GROUP BY ws),
e AS (SELECT f, n, unnest(ws) AS w FROM c),
r AS (SELECT f, n, w, row_number() OVER (PARTITION BY f ORDER BY df, w) AS k FROM e JOIN (SELECT w, count(*) AS df FROM e GROUP BY w) USING (w)),
x AS MATERIALIZED (SELECT f, n, w FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.f AS fa, b.f AS fb FROM x a JOIN x b ON a.w = b.w AND a.f < b.f AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
m AS (SELECT fb, len(list_intersect(a.ws, b.ws)) AS k, a.n AS na, b.n AS nb FROM p JOIN c a ON a.f = fa JOIN c b ON b.f = fb),
later AS (SELECT DISTINCT fb AS f FROM m WHERE 100 * k >= 80 * (na + nb - k)),
gone AS (SELECT doc_id, i FROM l JOIN c ON l.ws = c.ws WHERE (doc_id, i) <> c.f OR c.f IN (SELECT f FROM later)),
k AS (SELECT l.doc_id, count(*) FILTER (WHERE len(ws) > 0) AS n_lines, count(gone.i) AS n_removed, string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
