"""Document fingerprints: a Merkle tree over paragraphs and sections, in built-in functions alone.

A paragraph is a line with its line end, its digest the SHA-256 of its text. A
section ends with a paragraph whose digest begins with one of two hex digits, so
cuts follow the content, and an edit changes the branches it touches and no others.
A section's digest is that of its paragraphs' digests, the root that of the
sections'. Below a paragraph are its pieces, which end at punctuation or after PIECE
characters without any (the words, if the line has at most SHORT characters): they
tell how much of a changed paragraph is left.

A fingerprint is a string: 32 hex digits of the root, "x" and the length of the text
in code points, a colon, and the pieces in order. A piece is a number, 20 bits of its
hash times 128 plus its length in code points; "," ends a piece, "." a paragraph, "/"
a section. Equal roots are equal texts. Two fingerprints are alike by the code points
of the pieces they share, twice those over all of both (1 for equal roots);
differing() descends from sections to pieces and gives the stretches of a text that
the other lacks.

Null text counts as empty: a root without leaves. Any length of text is one row's
expression, in memory of a few times the text. In with_next() a row with a null id
has no next document; of rows that repeat an id the one with the smallest hash of
its text stands for the id as somebody's next. Extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.llm.common import Scratch

PIECE, SHORT = 48, 96
#: Sections end at paragraphs whose digest begins with one of these.
SECTION = ("0", "8")
#: Their matches are all of a line: words; at most PIECE characters, with at most 8 of punctuation and 24 of white space behind them.
WORD_PATTERN = r"[^\t-\r ]{1,24}[\t-\r ]{0,24}|[\t-\r ]{1,24}"
PIECE_PATTERN = rf"[^\n.,;:!?]{{1,{PIECE}}}(?:[\n.,;:!?]{{1,8}}[\t-\r ]{{0,24}})?|[\n.,;:!?]{{1,8}}[\t-\r ]{{0,24}}"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of column ``text`` (no nulls) as column ``name``."""
    paragraphs = f"__{name}_paragraphs"
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]

    def piece(x: Column) -> Column:
        return F.concat((F.xxhash64(x).bitwiseAND((1 << 20) - 1) * 128 + F.char_length(x)).cast("string"), F.lit(","))

    def paragraph(line: Column) -> Column:
        found = F.when(F.char_length(line) <= SHORT, F.regexp_extract_all(line, F.lit(WORD_PATTERN), 0)).otherwise(F.regexp_extract_all(line, F.lit(PIECE_PATTERN), 0))
        return F.struct(F.sha2(line, 256).alias("own"), F.array_join(F.transform(found, piece), "").alias("pieces"))

    df = df.withColumn(paragraphs, F.transform(F.split(F.col(f"`{text}`"), r"(?<=\n)"), paragraph))
    end = lambda p: F.when(F.substring(p["own"], 1, 1).isin(*SECTION), "/").otherwise(".")
    line = lambda part: F.array_join(F.transform(paragraphs, lambda p: F.concat(p[part], end(p))), "")
    top = F.sha2(F.array_join(F.transform(F.split(line("own"), "/"), lambda s: F.sha2(s, 256)), ""), 256)
    return df.select(*kept, F.concat(F.substring(top, 1, 32), F.lit("x"), F.char_length(F.col(f"`{text}`")).cast("string"), F.lit(":"), line("pieces")).alias(name))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 32)


def length(fingerprint: Column) -> Column:
    return F.substring(F.substring_index(fingerprint, ":", 1), 34, 20).cast("bigint")


def _pieces(fingerprint: Column) -> Column:
    """Pieces of a fingerprint that has some, as numbers."""
    return F.split(F.rtrim(F.substring_index(fingerprint, ":", -1), F.lit(",./")), "[,./]+").cast("array<bigint>")


def _shared(x: Column, y: Column) -> Column:
    """Code points in pieces of both lists."""
    zero = F.lit(0).cast("bigint")
    # equal pieces meet in the sorted list, x's before y's
    both = F.sort_array(F.concat(F.transform(x, lambda v: v * 2), F.transform(y, lambda v: v * 2 + 1)))
    start = F.struct(zero.alias("piece"), zero.alias("free"), zero.alias("shared"))

    def step(acc: Column, v: Column) -> Column:
        piece = F.shiftright(v, 1)
        free = F.when(acc["piece"] == piece, acc["free"]).otherwise(zero)
        mine = v.bitwiseAND(1) == 0
        meets = ~mine & (free > 0)
        return F.struct(piece.alias("piece"), F.when(mine, free + 1).when(meets, free - 1).otherwise(free).alias("free"), F.when(meets, acc["shared"] + piece.bitwiseAND(127)).otherwise(acc["shared"]).alias("shared"))

    once = F.aggregate(F.array_intersect(x, y), zero, lambda acc, v: acc + v.bitwiseAND(127))
    plain = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) == F.size(x) + F.size(y)
    return F.when(~F.arrays_overlap(x, y), zero).when(plain, once).otherwise(F.aggregate(both, start, step)["shared"])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints: the share of both texts that lies in pieces of both, repeated pieces as often as both have them. Null on either side: 0."""
    lists = F.array(F.struct(_pieces(a).alias("x"), _pieces(b).alias("y")))
    shared = F.get(F.transform(lists, lambda p: _shared(p["x"], p["y"])), F.lit(0))
    some = F.least(length(a), length(b)) > 0
    return F.when(root(a) == root(b), F.lit(1.0)).when(a.isNotNull() & b.isNotNull() & some, 2.0 * shared / (length(a) + length(b))).otherwise(F.lit(0.0))


def differing(a: Column, b: Column) -> Column:
    """array<struct<start, length>>: the stretches of a's text, in code points, whose pieces b lacks. Sections and paragraphs that b has are not entered."""
    tree = lambda f: F.substring_index(f, ":", -1)
    sections, paragraphs, pieces = F.split(tree(b), "/"), F.split(tree(b), "[./]"), F.split(tree(b), "[,./]+")
    new = lambda x, known: ~F.array_contains(known, x)

    def paragraph(fresh: Column):
        def of(p: Column) -> Column:
            inner = fresh & new(p, paragraphs)
            return F.transform(F.filter(F.split(p, ","), lambda x: x != ""), lambda x: F.struct((x.cast("bigint") % 128).alias("n"), (inner & new(x, pieces)).alias("new")))

        return of

    marked = F.flatten(F.flatten(F.transform(F.split(tree(a), "/"), lambda s: F.transform(F.split(s, "[.]"), paragraph(new(s, sections))))))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.lit(False).alias("open"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["spans"], F.lit(-1))
        longer = F.concat(F.slice(acc["spans"], 1, F.size(acc["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), (last["length"] + x["n"]).alias("length"))))
        more = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), x["n"].alias("length"))))
        return F.struct((acc["at"] + x["n"]).alias("at"), x["new"].alias("open"), F.when(~x["new"], acc["spans"]).when(acc["open"], longer).otherwise(more).alias("spans"))

    return F.aggregate(marked, start, step)["spans"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return with_fingerprint(docs.select("doc_id", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars")), "text", "fingerprint").select("doc_id", "n_chars", "fingerprint")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, longest, hash) of each id: the next greater one (the least after the greatest), the longest of its texts, the smallest hash of one.

    Ids alone are sorted, by ranges; the first id of each range is one row of a small window.
    """
    scratch = Scratch(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.where("doc_id is not null").select("doc_id", F.char_length(text).cast("bigint").alias("n"), F.xxhash64(text).alias("hash")).groupBy("doc_id").agg(F.max("n").alias("longest"), F.min("hash").alias("hash"))
    ids = scratch.write(ids.repartitionByRange(parts, "doc_id").select("*", F.spark_partition_id().alias("part")))
    every = Window.orderBy("part")
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(every), F.min("first").over(Window.partitionBy())).alias("then"))
    after = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ids.withColumn("after", after).join(F.broadcast(firsts), "part").select("doc_id", F.coalesce("after", "then").alias("next_id"), "longest", "hash")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, head, next_fingerprint, fingerprint): head is as much of the next document's beginning as a quarter of any text of this id.

    Texts are shuffled by id once and read twice; heads follow to the id before.
    A hot id meets one row on either side, so that its partition can be split.
    """
    order = next_ids(docs)
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("longest") / 4).cast("int").alias("need"))
    asked = Scratch(docs.sparkSession).write(asked.join(order.select("doc_id", "hash"), "doc_id"))
    every = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = every.where("doc_id is not null")  # in both joins, so that they read one exchange: fingerprints are made behind it
    # not an equality, which would be a key: the exchange is by id alone
    one = F.col("hash").bitwiseXOR(F.xxhash64("text")) == 0
    heads = rows.join(asked.withColumnRenamed("doc_id", "id"), (F.col("doc_id") == F.col("id")) & one)
    heads = with_fingerprint(heads, "text", "next_fingerprint").select("before", F.substring("text", F.lit(1), F.col("need")).alias("head"), "next_fingerprint")
    # equal rows of one id bring the same head
    heads = heads.groupBy("before").agg(F.min("head").alias("head"), F.min("next_fingerprint").alias("next_fingerprint"))
    rows = rows.join(heads, F.col("doc_id") == F.col("before"), "left").select("doc_id", "text", "head", "next_fingerprint")
    none = F.lit(None).cast("string")
    return with_fingerprint(rows.union(every.where("doc_id is null").select("doc_id", "text", none, none)), "text", "fingerprint")


def edits(docs: DataFrame) -> DataFrame:
    """Each row's text with its last quarter replaced by the beginning of the next document, its fingerprint and how alike they are."""
    rows = with_next(docs)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def digest(edited: DataFrame) -> DataFrame:
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
