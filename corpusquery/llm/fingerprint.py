"""Canonical exact digests of texts, with DataFrame functions only.

The canonical form of a text is its NFKC normalisation with full case folding, normalised once more, runs of white space
made one space and those at the ends dropped (normalisation and folding by the ICU library that Spark ships, called as a
SQL function). The fingerprint is wide: two 64-bit xxhashes of the canonical form under different seeds, 32 hexadecimal
digits. Groups of equal fingerprints are checked byte by byte: where a bucket's least and greatest canonical forms differ,
its rows are grouped by the form itself.

Neighbours: documents stand in descending order of their ids, those of one id in the order of a hash of their texts, those
without an id behind all others; after the last comes the first. Only ids, hashes and lengths are ordered, by ranges that
follow the rows and not the values, so clustered, repeated and null ids are dealt as evenly as any; the texts are shuffled
once by their keys, and of each text once more what its neighbour takes from its front.

A null text counts as empty, and all texts without anything but white space are equal. Every row comes back, repeated ones
as often as they stand there: all but one of them have their own text as the next one. Groups of copies are summed up
before they are shuffled. ``group_id`` is the smallest id of a group, null where none of its rows has one. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, n_partitions, read

#: Seeds in front of the text in the two halves of the fingerprint.
SALTS = (0, 1)
#: Runs of ASCII white space other than one space. Of the other white space, four characters are left by the normalisation.
_SPACE, _WIDE_SPACES = r" [\s\x1C-\x1F]+|[\t-\r\x1C-\x1F][\s\x1C-\x1F]*", "\x85\u1680\u2028\u2029"
#: A row's key: its id and two hashes of its text. Rows that agree in all three are repeated rows.
_KEY = ["doc_id", "t0", "t1"]


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    # what is ASCII alone is its own normal form, and folds as lower case
    ascii_only = F.octet_length(text) == F.length(text)
    other = nfkc(folded)
    for space in _WIDE_SPACES:
        other = F.replace(other, F.lit(space), F.lit(" "))
    form = F.when(ascii_only, F.lower(text)).otherwise(other)
    return F.trim(F.regexp_replace(form, _SPACE, " "))


def fingerprint(form: Column) -> Column:
    """Of a canonical form."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), form))), 16, "0") for s in SALTS))


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, t0, t1 and text; a null text is empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", *(F.xxhash64(F.lit(s), "text").alias(f"t{s}") for s in SALTS), "text")


def buckets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(fingerprint, group_id, n_rows and collision of each fingerprint; where some bucket holds different bytes, also
    doc_id, t0, t1, fingerprint, group_id and n_rows of the rows in those, by their forms)."""
    rows = _keyed(docs, text, key).withColumn("form", canonical(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("form")))
    found = rows.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b"), F.min("doc_id").alias("group_id"), F.count("*").alias("n_rows"))
    found = materialise(found.select("fingerprint", "group_id", "n_rows", (F.col("a") != F.col("b")).alias("collision")), "buckets")
    if found.filter("collision").isEmpty():
        return found, None
    mixed = rows.join(found.filter("collision").select("fingerprint"), "fingerprint", "left_semi")
    each = mixed.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_rows"))
    return found, materialise(mixed.select(*_KEY, "fingerprint", "form").distinct().join(each, ["fingerprint", "form"]).select(*_KEY, "fingerprint", "group_id", "n_rows"), "mixed")


def _with_groups(rows: DataFrame, found: DataFrame, mixed: DataFrame | None, columns: list[str]) -> DataFrame:
    """rows(doc_id, t0, t1, fingerprint, ...) with group_id, n_rows of the group, and collision (the bucket holds different bytes)."""
    columns = [*columns, "group_id", "n_rows", "collision"]
    plain = rows.join(found.filter("NOT collision") if mixed is not None else found, "fingerprint").select(columns)
    if mixed is None:
        return plain
    same = [rows["fingerprint"] == mixed["fingerprint"], *(rows[c].eqNullSafe(mixed[c]) for c in _KEY)]
    apart = rows.join(mixed, same).select(*(rows[c] for c in columns[:-3]), "group_id", "n_rows", F.lit(True).alias("collision"))
    return plain.union(apart)


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, group_id (smallest id of the rows with the same canonical bytes), n_rows of the group, and collision (the bucket holds different bytes)."""
    rows = _keyed(docs, text, key)
    rows = rows.select(*_KEY, fingerprint(canonical(F.col("text"))).alias("fingerprint"))
    return _with_groups(rows, *buckets(docs, text, key), ["doc_id", "fingerprint"])


def _ordered(keys: DataFrame) -> DataFrame:
    """keys(doc_id, t0, t1, distinct, and n) -> also nx (a struct: the key after it, of the first one after the last) and
    bx (the key before it and its n). Neighbours within range partitions, then the partitions' ends."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("t0"), F.col("t1")]
    row = F.struct(*_KEY, "n")
    dealt = materialise(keys.repartitionByRange(n_partitions(keys.sparkSession), *order).select("*", F.spark_partition_id().alias("p")), "keys")
    within = W.partitionBy("p").orderBy(*order)
    inside = dealt.withColumns({"nx": F.lead(row).over(within), "bx": F.lag(row).over(within), "k": F.row_number().over(within), "more": F.lead("p").over(within).isNotNull()})
    # a partition's first and last row; the partitions are few, and their order closes to a ring
    ends = inside.filter("k = 1 OR NOT more").groupBy("p").agg(F.max(F.when(F.col("k") == 1, row)).alias("first"), F.max(F.when(~F.col("more"), row)).alias("last"))
    around = W.orderBy("p")
    ring = ends.select("p", F.coalesce(F.lead("first").over(around), F.min(F.struct("p", "first")).over(W.partitionBy())["first"]).alias("after"), F.coalesce(F.lag("last").over(around), F.max(F.struct("p", "last")).over(W.partitionBy())["last"]).alias("before"))
    return inside.join(ring, "p").select(*_KEY, "n", "copies", F.coalesce("nx", "after").alias("nx"), F.coalesce("bx", "before").alias("bx"))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, t0, t1, text, copies (rows of this key), next_key (a struct) and next_front: as many code points from the front of the next document's text as a third of the own ones."""
    rows = _keyed(docs, text, key)
    keys = rows.select(*_KEY, F.length("text").alias("n")).groupBy(*_KEY).agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    keys = materialise(_ordered(keys), "neighbours")
    by_key = rows.join(keys.select(*_KEY, "copies", "nx", "bx"), [rows[c].eqNullSafe(keys[c]) for c in _KEY]).select(*(rows[c] for c in [*_KEY, "text"]), "copies", "nx", "bx")
    mine = by_key.select(*_KEY, "text", "copies", F.col("nx").alias("next_key"))
    # one of a key's rows gives its front to the row before
    fronts = by_key.select(*(F.col(f"bx.{c}").alias(c) for c in _KEY), F.substr("text", F.lit(1), F.floor(F.col("bx.n") / 3).cast("int")).alias("next_front"), "copies")
    repeated = fronts.filter("copies > 1").drop("copies").distinct()
    once = fronts.drop("copies") if keys.filter("copies > 1").isEmpty() else fronts.filter("copies = 1").drop("copies").union(repeated)
    return mine.join(once, [mine[c].eqNullSafe(once[c]) for c in _KEY]).select(*(mine[c] for c in mine.columns), "next_front")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, mixed = buckets(docs)
    n, m = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    kept = F.substr("text", F.lit(1), n - m)
    # of repeated rows, all but one are followed by themselves
    rows = with_next(docs).withColumns({"edited": F.concat(kept, "next_front"), "itself": F.when(F.col("copies") > 1, F.concat(kept, F.substr("text", F.lit(1), m)))})
    # forms stand in columns of their own: an expression with a reflected call is evaluated wherever it is written
    rows = rows.withColumns({f"{c}_form": F.when(F.col(c).isNotNull(), canonical(F.col(c))) for c in ("text", "edited", "itself")})
    rows = rows.select(
        *_KEY, "copies", "next_key", F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n_chars"), fingerprint(F.col("text_form")).alias("fingerprint"),
        *(F.when(F.col(c).isNotNull(), F.struct(F.sha2(c, 256).alias("sha"), fingerprint(F.col(f"{c}_form")).alias("f"))).alias(c) for c in ("edited", "itself")),
    )
    rows = materialise(rows, "digests")
    lasts = rows.filter("copies > 1").groupBy(*_KEY).agg(F.max("row").alias("row")).select(F.col("row").alias("last_row"))
    single, many = rows.filter("copies = 1"), rows.filter("copies > 1").join(lasts, F.col("row") == F.col("last_row"), "left")
    own = lambda df, follows: df.select(*_KEY, "n_chars", "fingerprint", F.when(follows, F.col("edited")).otherwise(F.col("itself")).alias("e"), F.when(follows, F.col("next_key")).otherwise(F.struct(*_KEY, F.lit(0).alias("n"))).alias("next_key"))
    rows = own(single, F.lit(True)).union(own(many, F.col("last_row").isNotNull()))
    prints = rows.select(*(F.col(c).alias(f"next_{c}") for c in _KEY), F.col("fingerprint").alias("next_fingerprint")).distinct()
    rows = rows.join(prints, [F.col(f"next_key.{c}").eqNullSafe(prints[f"next_{c}"]) for c in _KEY])
    alike = lambda a, b: (a == F.col(b)).cast("double")
    rows = rows.select(
        *_KEY, "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.f").alias("edited_fingerprint"), alike(F.col("e.f"), "fingerprint").alias("near_edited"), alike(F.col("next_fingerprint"), "fingerprint").alias("near_next")
    )
    return _with_groups(rows, found, mixed, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
