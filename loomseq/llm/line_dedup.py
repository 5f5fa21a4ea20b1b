"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Every non-blank line is the set of its runs of 10 characters.  The shingles of a line are hashed once, a hash threshold
keeps those that can be the least of one of 32 bins, and the bins' least hashes are its signature; equal lines have
equal signatures.  Bands of four bins give buckets.  Every pair of lines in a bucket is verified by exact Jaccard
similarity, unless bitmaps of the two sets differ in more places than a link allows or other links put both in one
component already.  Links are united by distributed star rounds, and the first line of each component in (doc_id, line
number) order stays.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import connected_components, cut, drop_cut

SHINGLE, BANDS, ROWS = 10, 8, 4
BINS = BANDS * ROWS
#: Mean number of hashes per bin that pass the threshold; a bin that gets none takes the next full one's value.
PER_BIN = 2
BIN_BITS = BINS.bit_length() - 1
#: Words of 64 bits in the bitmap of a line, and in that of a line of a crowded bucket.
WORDS, CROWDED_WORDS = 32, 16
TRIMMED = r"trim(BOTH ' \t\r' FROM line)"


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rh, ln, norm, h1) of non-blank lines; ``norm`` is the line without outer blanks, tabs and returns.

    ``rh`` tells apart rows of one id whose texts differ; rows equal in both are one.
    """
    # the row's hash and lines are made below the explode, once a row
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rh"), F.split("text", "\n").alias("all")
    ).select("doc_id", "rh", F.posexplode("all").alias("ln", "line"))
    return rows.select("doc_id", "rh", "ln", F.expr(TRIMMED).alias("norm")).where("norm <> ''").withColumn("h1", F.xxhash64("norm"))


def characters(text: str) -> Column:
    """The text as four bytes a character, in which a run of characters is found without a scan from the start."""
    return F.encode(text, "UTF-32")


def shingle_count(chars: str) -> Column:
    """Runs of ``SHINGLE`` characters; a shorter line is one shingle."""
    return F.greatest(F.shiftright(F.octet_length(chars), 2) - (SHINGLE - 1), F.lit(1))


def shingle(chars: str, at: Column) -> Column:
    return F.xxhash64(F.substring(chars, at * 4 + 1, F.lit(4 * SHINGLE)))


def shingles(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(``columns``, n, g): a row for each run of characters of ``norm``, n of them a line, with its hash."""
    m = lines.select(*columns, characters("norm").alias("u"))
    m = m.select(*columns, "u", shingle_count("u").alias("n"))
    m = m.select(*columns, "u", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return m.select(*columns, "n", shingle("u", F.col("i")).alias("g"))


def shingle_hashes(text: str) -> Column:
    """The hashes of the text's shingles as an array.

    The characters are bound by an outer ``transform``: read from the row, they would be copied for every shingle.
    """
    every = lambda u: F.transform(F.sequence(F.lit(0), shingle_count(u) - 1), lambda i: shingle(u, i))
    return F.get(F.transform(F.array(characters(text)), every), 0)


def band_keys(lines: DataFrame) -> DataFrame:
    """(h1, key): the bands' keys of each different line of ``lines`` (h1, norm).

    The upper bits of a shingle's hash choose its band and its bin; in its bin only a hash below a threshold that falls
    with the line's length goes on, which leaves ``PER_BIN`` a bin in the mean.  A bin that gets none takes the next full
    one's value in its band, and a band of a short line that gets none has no key.  Equal lines meet here, as minima of one key.
    """
    m = shingles(lines, ["h1"])
    low = F.shiftrightunsigned(F.shiftleft("g", BIN_BITS), 33)
    m = m.select("h1", "n", low.alias("low"), F.shiftrightunsigned("g", 64 - BIN_BITS).cast("int").alias("bin"))
    m = m.where(F.col("low") * F.col("n") < F.lit(BINS * PER_BIN << 31))
    m = m.select("h1", (F.col("bin") % BANDS).alias("band"), F.floor(F.col("bin") / BANDS).alias("row"), F.col("low").cast("int").alias("low"))
    m = m.groupBy("h1", "band").agg(*[F.min(F.when(F.col("row") == i, F.col("low"))).alias(f"m{i}") for i in range(ROWS)])
    filled = [F.coalesce(*[f"m{(i + x) % ROWS}" for x in range(ROWS)]) for i in range(ROWS)]
    return m.select("h1", F.xxhash64("band", *filled).alias("key"))


def word_and_bit(words: int) -> tuple[Column, Column]:
    """The word of a bitmap that the hash ``g`` belongs to, and its bit there as a long."""
    return F.col("g").bitwiseAND(F.lit(words - 1)).cast("int"), F.expr("shiftleft(1L, cast(shiftrightunsigned(g, 8) & 63 as int))")


def bitmaps(texts: DataFrame, together: int = 4) -> DataFrame:
    """(h1, n, w0, ...): for each line the number of its runs and a bitmap with the bit of each of its shingles.

    ``together`` words are a row first, then all: a row of an aggregate costs as much as it has columns.
    """
    word, bit = word_and_bit(WORDS)
    m = shingles(texts, ["h1"]).select("h1", "n", word.alias("word"), bit.alias("bit"))
    m = m.select("h1", "n", F.shiftright("word", together.bit_length() - 1).alias("part"), (F.col("word") % together).alias("word"), "bit")
    m = m.groupBy("h1", "n", "part").agg(*[F.bit_or(F.when(F.col("word") == k, F.col("bit"))).alias(f"p{k}") for k in range(together)])
    whole = [F.max(F.when(F.col("part") == k // together, F.col(f"p{k % together}"))) for k in range(WORDS)]
    return m.groupBy("h1", "n").agg(*[F.coalesce(w, F.lit(0)).alias(f"w{k}") for k, w in enumerate(whole)])


def other_side(maps: DataFrame, **names: str) -> DataFrame:
    """``maps`` with the columns ``names`` renamed, n as n2, own as own2 and each word w as v."""
    names = {"n": "n2", "own": "own2", **names}
    return maps.select(*[F.col(c).alias(names.get(c, f"v{c[1:]}" if c[0] == "w" else c)) for c in maps.columns])


def apart(words: int) -> Column:
    """Places where two lines' bitmaps differ: for each there is a shingle that one of them lacks."""
    return reduce(add, [F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(words)])


def may_link(differ: Column, least: float) -> Column:
    """Whether sets of at most n and n2 shingles can link, of which ``differ`` or more are in one only."""
    return differ * (1 + least) <= (1 - least) * (F.col("n") + F.col("n2")) + 1e-6


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact Jaccard similarity is ``least`` or more; pairs are dealt out evenly first."""
    side = lambda c: texts.select(F.col("h1").alias(c), F.col("norm").alias(f"t{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").repartition("a", "b")
    sets = both.select("a", "b", shingle_hashes("ta").alias("x"), shingle_hashes("tb").alias("y"))
    j = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    # a filter on what is not yet written would make the sets once more
    return cut(sets.select("a", "b", j.alias("j")), "known").where(F.col("j") >= least).select("a", "b")


def labelled_buckets(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """``buckets`` with the component ``c`` of each line, without the buckets that lie in one component."""
    seen = buckets.join(parts.select(F.col("node").alias("h1"), "component"), "h1", "left").select("key", "lead", "h1", F.coalesce("component", "h1").alias("c"))
    several = seen.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return seen.hint("merge").join(several, "key", "left_semi")


def split_crowded(labelled: DataFrame, crowded: int) -> tuple[DataFrame, DataFrame]:
    """``labelled`` by whether a bucket's pairs of different components are at most ``crowded`` times its lines."""
    sizes = labelled.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("s"))
    full = cut(sizes.where((F.col("n") * F.col("n") - F.col("s")) / 2 > crowded * F.col("n")).select("key"), "crowded")
    return labelled.join(full, "key", "left_anti"), labelled.join(full, "key", "left_semi")


def rare_pairs(lines: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of ``lines`` (h1, c) in different components that can link, by their rarest shingles.

    Shingles are ordered by how many of the lines have them.  Of two sets that link, each has one of the other's among
    the first n - ceil(least * n) + 1 of its own n, so only those are met: near copies that are too far apart have their own
    changes there.  A pair meets at its first common shingle only.  Shingles of the very same lines, as the runs over one changed word are, meet once, at the first of them.
    What pairs share by chance is told by the shingles that each has alone and by bitmaps of the others.
    """
    m = shingles(lines.join(texts, "h1"), ["h1", "c"])
    sets = cut(m.groupBy("h1", "g").agg(F.first("c").alias("c")), "sets")
    of = sets.groupBy("g").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("h1")).alias("same")).where("df > 1")
    ranked = cut(sets.join(of.hint("shuffle_hash"), "g"), "ranked")
    n = sets.groupBy("h1").agg(F.count("*").alias("n"))
    # a bit of these bitmaps says whether the number of its shingles is odd: fewer words do than where it says whether there are any
    word, bit = word_and_bit(CROWDED_WORDS)
    words = [f"w{k}" for k in range(CROWDED_WORDS)]
    shared = ranked.groupBy("h1").agg(F.count("*").alias("k"), *[F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0)).alias(w) for k, w in enumerate(words)])
    # shingles of one line only come first and meet nothing: they use up their share of the prefix
    alone = n.join(shared, "h1").select("h1", "n", (F.col("n") - F.col("k")).alias("own"), (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).alias("prefix"), *words)
    order = Window.partitionBy("h1").orderBy("df", "same", "g")
    placed = ranked.select("h1", "c", "g", F.row_number().over(order).alias("r"), F.coalesce(F.lag("same").over(order) != F.col("same"), F.lit(True)).alias("new"))
    first = placed.where("new").join(alone.where("own < prefix"), "h1").withColumn("r", F.col("r") + F.col("own"))
    first = cut(first.where("r <= prefix").select("h1", "c", "g", "n", "own", "r", *words), "first")
    prefixes = first.groupBy("h1").agg(F.sort_array(F.collect_list(F.struct("r", "g"))).getField("g").alias("all"))
    first = first.join(prefixes, "h1")
    # the smaller set of a pair is found by a shorter prefix: its overlap is at least that of two sets of its own size
    shorter = F.col("n") - F.ceil(2 * least / (1 + least) * F.col("n") - 1e-6) + 1
    other = other_side(first.where(F.col("r") <= shorter), h1="h2", c="c2", r="r2", all="all2")
    # at the first shingle that two sets share, what is left of both must be enough for the overlap that a link takes
    enough = F.least(F.col("n") - F.col("r"), F.col("n2") - F.col("r2")) + 1 >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-6
    larger = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("h1") > F.col("h2")))
    near = may_link(F.col("own") + F.col("own2") + apart(CROWDED_WORDS), least)
    # null-safe: else the intersection is made for every pair, to see that it is not null
    earliest = F.get(F.array_intersect("all", "all2"), 0).eqNullSafe(F.col("g"))
    met = first.hint("merge").join(other, "g").where(larger & (F.col("c") != F.col("c2")) & enough & near & earliest)
    return met.select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b"))


def open_pairs(labelled: DataFrame, maps: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of the lines in different components of one bucket that can still link by their bitmaps."""
    x = labelled.select("key", "h1", "c").join(maps, "h1")
    y = other_side(x, h1="h2", c="c2")
    return x.hint("merge").join(y, "key").where((F.col("h1") < F.col("h2")) & (F.col("c") != F.col("c2")) & may_link(apart(WORDS), least)).select(F.col("h1").alias("a"), F.col("h2").alias("b")).distinct()


def bucket_links(buckets: DataFrame, texts: DataFrame, least: float, crowded: int = 8) -> DataFrame:
    """(node, component) of the lines that link: every pair in a bucket is verified, excluded or in one component.

    First each line meets its bucket's lead.  The pairs that are then still in different components are verified one
    by one, but in buckets where these are more than ``crowded`` times the lines, only those that share a rare shingle.
    """
    maps = cut(bitmaps(texts), "maps")
    ends = buckets.where("h1 <> lead").select(F.col("lead").alias("a"), F.col("h1").alias("b")).distinct()
    near = ends.hint("merge").join(maps.withColumnRenamed("h1", "a"), "a").hint("merge").join(other_side(maps, h1="b"), "b")
    links = linked(near.where(may_link(apart(WORDS), least)).select("a", "b"), texts, least)
    parts = cut(connected_components(links, "a", "b"), "parts")
    labelled = cut(labelled_buckets(buckets, parts), "open")
    few, many = split_crowded(labelled, crowded)
    left = open_pairs(few, maps, least).unionByName(rare_pairs(many.select("h1", "c").distinct(), texts, least)).distinct()
    more = linked(left, texts, least)
    drop_cut(maps)
    return connected_components(links.unionByName(more), "a", "b")


def removed_lines(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, rh, ln) of the lines to remove: exact and fuzzy repeats of a line that comes earlier.

    Null texts and ids have no lines; blank lines are never removed.  Rows equal in doc_id and text count as one row,
    and a line of theirs is named as often as they are.
    Two different lines with one 64-bit hash, should they ever occur, are both left alone.
    """
    place = ["doc_id", "rh", "ln"]
    lines = cut(numbered_lines(docs).select(*place, "h1", F.xxhash64(F.lit(17), "norm").alias("h2")), "lines")
    # the bands are made where the documents lie: no text is exchanged for them
    banded = cut(band_keys(numbered_lines(docs).select("h1", "norm")), "bands")
    several = banded.alias("x").hint("merge").join(banded.alias("y"), F.expr("x.key = y.key and x.h1 <> y.h1"), "left_semi")
    several = cut(several, "several")
    drop_cut(banded)
    buckets = cut(several.join(several.groupBy("key").agg(F.min("h1").alias("lead")).hint("shuffle_hash"), "key").select("key", "lead", "h1"), "buckets")
    drop_cut(several)

    wanted = buckets.select("h1").distinct()
    texts = cut(numbered_lines(docs).select("h1", "norm").join(wanted.hint("shuffle_hash"), "h1", "left_semi").distinct(), "texts")
    parts = cut(bucket_links(buckets, texts, least), "parts")
    drop_cut(buckets)
    drop_cut(texts)

    kinds = lines.groupBy("h1").agg(F.count("*").alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo = hi").select("h1", "n")
    grouped = kinds.join(parts.withColumnRenamed("node", "h1").hint("shuffle_hash"), "h1", "left").where("n > 1 or component is not null")
    grouped = grouped.select("h1", F.coalesce("component", "h1").alias("c"))
    members = cut(lines.join(grouped.hint("shuffle_hash"), "h1").select("c", *place), "members")
    keep = members.groupBy("c").agg(F.min(F.struct(*place)).alias("keep"))
    gone = cut(members.join(keep.hint("shuffle_hash"), "c").where(F.struct(*place) != F.col("keep")).select(*place), "gone")
    for t in (lines, parts, members):
        drop_cut(t)
    return gone


def dedup_rows(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(row, text, lines_removed): every row of ``docs`` as a struct, its text without the repeats, and their number."""
    gone = removed_lines(docs.select("doc_id", "text"), least).groupBy("doc_id", "rh").agg(F.collect_set("ln").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("id"), "rh", "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("rh"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    was = F.col("row.text")
    all_ = F.split(was, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "gone"), lambda i: F.get("all", i))
    out = rows.join(gone.hint("shuffle_hash"), ["id", "rh"], "left").withColumn("all", F.when(F.col("gone").isNotNull(), all_))
    text = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(was)
    return out.select("row", text.alias("text"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("lines_removed"))


def with_text(rows: DataFrame, columns: list[str], changed: Column) -> list[Column]:
    """The user's columns out of ``row``, with ``text`` (and ``n_chars``, where ``changed``) as they are now."""
    now = {"text": F.col("text")}
    if "n_chars" in columns:
        now["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return [now.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns]


def dedup_lines(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """All columns of ``docs`` with the repeats gone from ``text``, plus ``lines_removed`` (long; replaces one of that name).

    Line order and the other lines' bytes stay as they are; a document whose lines all go has an empty text.  Rows
    with a null id or text pass as they are; rows equal in id and text get the same result.  ``n_chars``, if there,
    is set anew where lines went; other columns, whatever their names, are left alone.  No rows give no rows.
    """
    cols = [c for c in docs.columns if c.lower() != "lines_removed"]
    rows = dedup_rows(docs, least)
    return rows.select(*with_text(rows, cols, F.col("lines_removed") > 0), "lines_removed")


def lines_digest(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for every document; null text counts as no lines and empty bytes."""
    rows = dedup_rows(docs.select("doc_id", "text"), least)
    was = F.col("row.text")
    breaks = F.octet_length(was) - F.octet_length(F.replace(was, F.lit("\n")))
    n_lines = F.when(was.isNull(), F.lit(0)).otherwise(breaks + 1).cast("long")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select("row.doc_id", n_lines.alias("n_lines"), F.col("lines_removed").alias("n_removed"), sha.alias("kept_sha256"))
