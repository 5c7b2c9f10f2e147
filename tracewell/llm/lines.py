"""Near-duplicate lines, by an exact set-similarity join in DataFrame operations alone.

A line is the set of its words. Words are ordered by rarity: their corpus counts, kept in a fixed number of hash
buckets by powers of the root of two, and their hash among equals. Two sets of Jaccard similarity t share one of the
rarest ``n - ceil(t n) + 1`` words of the larger and ``m - ceil(2 t m / (1 + t)) + 1`` of the smaller; only those of a
fitting class of sizes meet. Pairs that meet must pass the length filter and a signature of 64 bits, 128 for lines
of many words (a word that only one line has flips one bit at most), and share so many indexed words that those
behind the indexed ones can make up for the rest; what passes is verified on the whole sets.

A line goes if an earlier line is similar, so one such line is all that has to be found. Lines that repeat a set
go at once. For the others each word first offers its earliest line, and only lines that find no similar one that
way are paired with all earlier ones, the nearest first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import discarded, stored, whole_text

SIMILARITY = 75  # per cent
LEAST_WORDS = 5  # lines of fewer different words stay
LONG = 40  # different words from which a line has the longer signature
BUCKETS = 1 << 18  # hash buckets of the word counts
LOTS = 4  # lots of words that are joined one after another, a power of two
NEAREST = 4  # pairs of a line that are verified ahead of its others
BROADCAST_ROWS = 1_000_000  # small tables of ids up to this many rows are broadcast; larger ones are joined

_KEY = ["doc", "version", "pos"]  # a line: the document's id, its text's hash where ids repeat, the line's number


def _blanks(text: Column) -> Column:
    for blank in "\t\r\n":  # translate looks up every character
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def _rarity(texts: DataFrame) -> Column:
    """One array of fixed size: for each bucket the power of two of its words' count in the corpus."""
    words = texts.select(F.explode(_blanks(F.col("text"))).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.floor(2 * F.log2(F.count("*"))).cast("int").alias("rank"))
    ranks = [0] * BUCKETS
    for row in counts.collect():  # BUCKETS rows at most
        ranks[row["bucket"]] = row["rank"]
    # A lambda can't hold a subquery, so the array is a constant of the plan.
    return F.expr(f"CAST(split('{','.join(map(str, ranks))}', ',') AS array<int>)")


def _hashes(line: Column) -> Column:
    """The distinct word hashes of a line, without the empty word that repeated blanks leave."""
    return F.array_remove(F.array_distinct(F.transform(_blanks(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _prefix(n: Column, similarity: int) -> Column:
    return (n - F.ceil(n * similarity / 100.0) + 1).cast("int")


def _overlap(n: str, m: str, similarity: int) -> Column:
    """The words that two sets of these sizes must share."""
    return F.ceil((F.col(n) + F.col(m)) * similarity / (100.0 + similarity) - 1e-9)


def _indexed(n: Column, similarity: int) -> Column:
    """The length of a prefix that no larger similar set's prefix can miss."""
    return (n - F.ceil(n * (2.0 * similarity) / (100.0 + similarity) - 1e-9) + 1).cast("int")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def line_sets(texts: DataFrame, similarity: int) -> DataFrame:
    """``doc, version, pos`` with the set's name (128 bits), size, rarest words (32 bits of their hashes) and signature.

    ``bits`` is of all words; ``more`` of half of them, in lines of many words only.
    """
    ranks = _rarity(texts)

    def code(h: Column) -> Column:
        rank = F.get(ranks, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long")
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    sets = _lines(texts).select(*_KEY, _hashes(F.col("line")).alias("hashes"))
    sets = sets.select(*_KEY, F.sort_array(F.transform("hashes", code)).alias("codes"))

    def parity(codes: Column) -> Column:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))))

    more = F.when(F.size("codes") >= LONG, parity(F.filter("codes", lambda c: c.bitwiseAND(64) == 0)))
    size = F.size("codes")
    rarest = F.transform(F.slice("codes", 1, _prefix(size, similarity)), lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int"))
    return sets.select(
        *_KEY, F.xxhash64("codes").alias("name"), F.xxhash64(F.lit(1), "codes").alias("name2"), size.alias("n"), rarest.alias("rarest"), parity(F.col("codes")).alias("bits"), more.alias("more")
    )


def _class(n: Column, similarity: int) -> Column:
    """Classes of sizes, each as wide as the sizes of similar sets may lie apart."""
    return F.floor(F.log(n.cast("double")) / math.log(max(100.0 / similarity, 1.1))).cast("int")


def _entries(firsts: DataFrame, side: str, words: Column, classes: Column, lot: int | None = None) -> DataFrame:
    """A row for each of the words and classes of a line; the key is the class ahead of the word's 32 bits."""
    columns = [f"{side}_{c}" for c in ("mark", "n", "bits", "more")]
    rows = firsts.select(*[F.col(c[2:]).alias(c) for c in columns], classes.alias("classes"), F.explode(words).alias("word"))
    if lot is not None:
        rows = rows.where(F.col("word").bitwiseAND(LOTS - 1) == lot)
    key = F.shiftleft(F.col("class").cast("long"), 32).bitwiseOR(F.col("word").cast("long").bitwiseAND(0xFFFFFFFF))
    return rows.select(*columns, "word", F.explode("classes").alias("class")).select(key.alias("key"), *columns)


def _offers(firsts: DataFrame, similarity: int) -> DataFrame:
    """``later, earlier``: each word offers its earliest line; of the offers that fit, a line takes the nearest ones."""
    words, one = F.slice("rarest", 1, _indexed(F.col("n"), similarity)), F.array(F.lit(0))
    rows = firsts.withColumn("mark", F.col("id"))
    low = F.min(F.struct("y_mark", "y_n", "y_bits", "y_more")).alias("low")
    offered = _entries(rows, "y", words, one).groupBy("key").agg(low, F.count("*").alias("held")).where("held > 1").select("key", "low.*")
    met = _entries(rows, "x", words, one).join(offered, "key").where((F.col("y_mark") < F.col("x_mark")) & _near(similarity))
    offers = met.groupBy(F.col("x_mark").alias("later"), F.col("y_mark").alias("earlier")).agg(F.min(_spare(similarity)).alias("spare"))
    place = F.row_number().over(Window.partitionBy("later").orderBy("spare", "earlier"))
    return offers.withColumn("place", place).where(F.col("place") <= NEAREST).select("later", "earlier")


def _pairs(firsts: DataFrame, closed: DataFrame, similarity: int) -> DataFrame:
    """``later, earlier, spare`` of all pairs that may be similar and whose later line is not among ``closed``.

    The larger set of a pair looks up the words of its prefix, the smaller one is found by those of its shorter one, in
    the class of the larger one's size. The words go in lots, so that the entries of one lot are on disk at a time.
    """
    closed = closed.select("id", F.lit(0).alias("open"))
    # The lowest bit tells whether the line is open, the others which comes first.
    marked = firsts.join(_small(closed), "id", "left").withColumn("mark", F.col("id") * 2 + F.coalesce("open", F.lit(1)))
    n = F.col("n")
    order = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_mark") < F.col("x_mark")))
    useful = F.greatest("x_mark", "y_mark").bitwiseAND(1) == 1
    shorter = F.slice("rarest", 1, _indexed(n, similarity))
    classes = F.sequence(_class(n, similarity), _class(F.floor(n * 100 / similarity), similarity))
    columns = ["x_mark", "y_mark", "x_n", "y_n"]
    lots = []
    for lot in range(LOTS):
        x = _entries(marked, "x", F.col("rarest"), F.array(_class(n, similarity)), lot)
        met = x.join(_entries(marked, "y", shorter, classes, lot), "key").where(order & useful & _near(similarity))
        lots.append(stored(met.groupBy(*columns).agg(F.count("*").alias("words"), F.min(_spare(similarity)).alias("spare")), "lot"))
    met = reduce(DataFrame.unionAll, lots).groupBy(*columns).agg(F.sum("words").alias("words"), F.min("spare").alias("spare"))
    behind = F.greatest(F.col("x_n") - _prefix(F.col("x_n"), similarity), F.col("y_n") - _indexed(F.col("y_n"), similarity))
    fit = met.where(F.col("words") + behind >= _overlap("x_n", "y_n", similarity))
    later, earlier = [F.shiftright(end("x_mark", "y_mark"), 1) for end in (F.greatest, F.least)]
    return fit.select(later.alias("later"), earlier.alias("earlier"), "spare")


def similar_earlier(texts: DataFrame, firsts: DataFrame, similarity: int) -> DataFrame:
    """``doc, version, pos`` of the lines that have a similar earlier one. ``firsts`` are the first of each class, with
    an ``id`` in their order."""
    likely = stored(_offers(firsts, similarity), "likely")
    found = stored(_verified(texts, firsts, likely, similarity), "similar")
    # Lines without a similar line so far meet all earlier ones.
    pairs = stored(_pairs(firsts, found, similarity).join(likely, ["later", "earlier"], "left_anti"), "pairs")
    # The nearest ones come first, so that most lines of a large group need no more than these.
    place = F.row_number().over(Window.partitionBy("later").orderBy("spare", "earlier"))
    nearest = stored(pairs.withColumn("place", place).where(F.col("place") <= NEAREST).select("later", "earlier"), "nearest")
    near = stored(_verified(texts, firsts, nearest, similarity), "near")
    rest = pairs.select("later", "earlier").join(near.select(F.col("id").alias("later")), "later", "left_anti")
    rest = stored(rest.join(nearest, ["later", "earlier"], "left_anti"), "rest")
    found = found.unionAll(near)
    if not rest.isEmpty():
        found = found.unionAll(_verified(texts, firsts, rest, similarity))
    return firsts.join(_small(stored(found, "found")), "id", "left_semi").select(*_KEY)


def _apart() -> Column:
    """The least difference of two sets that their signatures allow."""
    flipped = F.col("x_bits").bitwiseXOR(F.col("y_bits"))
    half = F.col("x_more").bitwiseXOR(F.col("y_more"))
    return F.coalesce(F.bit_count(half) + F.bit_count(half.bitwiseXOR(flipped)), F.bit_count(flipped))


def _near(similarity: int) -> Column:
    """Whether sizes and signatures allow a pair to be similar."""
    x, y = F.col("x_n"), F.col("y_n")
    return (100 * F.least(x, y) >= similarity * F.greatest(x, y)) & (_spare(similarity) <= 0)


def _spare(similarity: int) -> Column:
    """The difference that signatures show, less the one that is allowed."""
    return _apart() - F.col("x_n") - F.col("y_n") + 2 * _overlap("x_n", "y_n", similarity)


def _verified(texts: DataFrame, firsts: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """``id`` of the later lines of the pairs whose whole sets are similar; the sets come from the lines themselves."""
    numbered = pairs.withColumn("pair", F.monotonically_increasing_id())
    sides = [numbered.select(F.col(name).alias("id"), "pair", F.lit(side).alias("side")) for side, name in (("x", "later"), ("y", "earlier"))]
    wanted = stored(firsts.select("id", *_KEY).join(sides[0].unionAll(sides[1]), "id"), "wanted")
    lines = _lines(texts.join(_small(wanted.select("doc").distinct()), texts["doc"].eqNullSafe(wanted["doc"]), "left_semi"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"w.{k}")) for k in _KEY]
    found = lines.alias("l").join(_small(wanted).alias("w"), same[0] & same[1] & same[2]).select("pair", "side", _hashes(F.col("line")).alias("words"))
    sets = found.groupBy("pair").agg(*[F.max(F.when(F.col("side") == side, F.col("words"))).alias(side) for side in "xy"])
    shared = F.size(F.array_intersect("x", "y"))
    similar = sets.where(100 * shared >= similarity * (F.size("x") + F.size("y") - shared)).select("pair")
    return wanted.where("side = 'x'").join(similar, "pair").select("id").distinct()


def removed_lines(texts: DataFrame, similarity: int = SIMILARITY, least_words: int = LEAST_WORDS, repeated: bool = True) -> DataFrame:
    """``doc, version, gone``: for each document (``doc, version, text``) the numbers of the lines that go, if any."""
    every = stored(line_sets(texts, similarity), "lines")
    sets = every.where(F.col("n") >= least_words)
    classes = stored(sets.groupBy("name", "name2").agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("held")).where("held > 1").drop("held"), "classes")
    # Lines that repeat a set go in any case; a common line is a hot key, which the join splits.
    repeats = sets.select(*_KEY, "name", "name2").join(_small(classes), ["name", "name2"]).select(*_KEY, "first").where(F.struct(*_KEY) > F.col("first"))
    repeats = stored(repeats, "repeats")
    firsts = sets.join(_small(repeats.select(*_KEY)), _KEY, "left_anti").select(*_KEY, "n", "bits", "more", "rarest")
    if repeated:
        firsts = firsts.dropDuplicates(_KEY)  # rows equal in id and text
    firsts = stored(firsts.orderBy(*_KEY).withColumn("id", F.monotonically_increasing_id()), "firsts")
    discarded(every)
    similar = similar_earlier(texts, firsts, similarity)
    # Whether or not the first line of a class goes, the lines that repeat it do.
    gone = similar.unionAll(repeats.select(*_KEY))
    return gone.groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, similarity: int = SIMILARITY, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that resemble an earlier line.

    Lines end at line feeds; words lie between blanks, tabs and carriage returns. Two lines are similar if their
    sets of words have a Jaccard similarity of ``similarity`` per cent; order is by id (null first), then by the
    text's hash, then by line. Lines of fewer than ``least_words`` different words stay, empty ones included. A null
    text stays null. Rows equal in id and text are one document and fare alike. ``count_col`` names a column for
    the number of lines removed; other columns are kept as they are.
    """
    text = docs[text_col].cast("string")
    repeated = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    # Only where ids repeat does it take the text's hash to tell documents apart.
    version = F.xxhash64(F.coalesce(text, F.lit(""))) if repeated else F.lit(0).cast("long")
    texts = docs.select(docs[id_col].alias("doc"), version.alias("version"), whole_text(text_col).alias("text"))
    gone = stored(removed_lines(texts, similarity, least_words, repeated), "gone").select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    same = docs[id_col].eqNullSafe(F.col("__doc")) & (version == F.col("__version"))
    joined = docs.join(_small(gone), same, "left")
    kept = F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains("__gone", k))
    shorter = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = joined.select(*[shorter.alias(c) if c == text_col else docs[c] for c in docs.columns if c != count_col], F.coalesce(F.size("__gone"), F.lit(0)).alias("__count"))
    return out.withColumnRenamed("__count", count_col) if count_col else out.drop("__count")
