"""Mapping free-entered values to the closest entry of a reference list.

Distinct values are normalised, cut into character n-grams and looked up in an
inverted index of the reference entries; the entry with the highest idf-weighted
cosine is accepted if it reaches a threshold and leads the next entry by a margin.
Between entries within the margin the one with fewer differing letters is meant. Only
the rarest n-grams that the threshold needs are looked up (prefix filtering).
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import fresh, materialize

#: Rows of the inverted index (about 60 bytes each) up to which it is broadcast; only the plan depends on it.
INDEX_BROADCAST_ROWS = 2_000_000
_CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[0]


def fold(c: Column) -> Column:
    """Repair UTF-8 read as Latin-1, drop accents, lower-case."""
    tail = [chr(b) for b in range(0x80, 0xC0)] + [chr(o) for o in _CP1252]
    means = [_base(chr(b + 0x40)) for b in range(0x80, 0xC0)] + [_base(chr(b + 0x40)) for b in _CP1252.values()]
    cls = "".join(f"\\u{ord(t):04x}" for t in tail)
    c = F.translate(F.regexp_replace(c, f"Ã(?=[{cls}])", ""), "".join(tail), "".join(means))
    c = F.regexp_replace(F.regexp_replace(c, "(?<=\\S)Ã (?=\\S)", "a"), "\\p{M}+", "")
    latin = [chr(o) for o in range(0xC0, 0x180) if _base(chr(o)) != chr(o)]
    c = F.translate(c, "".join(latin) + "øØłŁđĐ", "".join(map(_base, latin)) + "oOlLdD")
    c = F.regexp_replace(F.lower(c), "ß", "ss")
    return c


def tidy(c: Column, words: dict[str, str] | None = None, noise: tuple[str, ...] = (), signs: dict[str, str] | None = None) -> Column:
    """Words only, with single blanks.

    ``words`` are whole words to replace, ``signs`` characters to replace inside words
    that have letters, ``noise`` patterns to cut out at last.
    """
    extra = "".join(x for x in signs or {} if not x.isalnum())
    c = F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}" + "".join("\\" + x for x in extra) + "]+", " "))
    if words or signs:
        known = F.create_map(*[F.lit(x) for pair in (words or {"": ""}).items() for x in pair])

        def word(w: Column) -> Column:
            letters = F.when(w.rlike("\\p{L}"), F.translate(w, "".join(signs), "".join(signs.values()))).otherwise(w) if signs else w
            return F.coalesce(F.try_element_at(known, letters), letters)

        c = F.array_join(F.transform(F.split(c, " "), word), " ")
    return F.trim(F.regexp_replace(c, "|".join(noise), "")) if noise else c


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def _grams(c: Column) -> Column:
    """3-grams with doubly marked ends, the same with their letters sorted, which letters that changed places leave alike, and 2-grams."""
    s = F.concat(F.lit("^^"), c, F.lit("$$"))
    three = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    two = F.transform(F.sequence(F.lit(2), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(2)))
    return F.concat(three, F.transform(three, lambda g: F.concat(F.lit("~"), _letters(g))), two)


def _slips(x: Column, y: Column) -> Column:
    """Differing letters; two that changed places are one."""
    edits = F.levenshtein(x, y)
    return F.when((edits == 2) & (F.length(x) == F.length(y)) & (_letters(x) == _letters(y)), F.lit(1)).otherwise(edits)


def map_values(
    values: DataFrame, value: str, ref: DataFrame, ref_id: str, ref_name: str, ref_context: str | None = None, threshold: float = 0.4, margin: float = 0.06,
    words: dict[str, str] | None = None, noise: tuple[str, ...] = (), signs: dict[str, str] | None = None, most_slips: int | None = None,
) -> DataFrame:
    """``value`` and the id of the reference entry it means, one row per distinct value.

    ``values`` may hold repeated rows; they are deduplicated first, so a value typed
    a billion times costs as much as one typed once. Null values are left out.
    Blank values and values with no acceptable entry get id -1. With ``ref_context``
    (the country of a city) "name context" is an alias of the entry, and the context
    alone names nothing. The entry with the highest cosine is accepted if that
    reaches ``threshold`` and no other entry is within ``margin``; of entries within
    the margin the one with the fewest differing letters is accepted, and if several
    have as few, the value is ambiguous and gets -1. An exact match ignoring case,
    accents and spacing always wins. The result has the columns ``value``, ``ref_id``
    (type of the reference) and ``score``.

    Nothing is known of the values beforehand. A caller may give ``words`` (spellings
    and abbreviations to replace), ``signs`` (characters that stand for letters),
    ``noise`` (patterns to cut from values), and with ``most_slips`` an exact check of
    the accepted entry: at most 0, 1, 2 or ``most_slips`` letters may differ, for
    names under 5, 8 and 14 letters and longer ones.
    """
    spark = values.sparkSession
    # A fixed number of partitions by form: what follows fans out by the index and keeps this partitioning to the end.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    v = values.select(F.col(f"`{value}`").alias("v")).where(F.col("v").isNotNull()).distinct()
    f = F.col("f")
    plain = F.regexp_replace(f, "[\\[\\](){}\"']", " ")
    bare = F.regexp_replace(f, "\\[[^\\]]*\\]|\\([^)]*\\)", " ")
    turned = F.regexp_replace(bare, "^([^,]+),([^,]+)$", "$2 $1")
    pairs = v.withColumn("f", fold(F.col("v"))).select("v", F.explode(F.array_distinct(F.transform(F.array(plain, bare, turned), lambda x: tidy(x, words, noise, signs)))).alias("form")).where("form <> ''")
    pairs = pairs.withColumn("form", F.regexp_replace("form", " ", ""))

    # -1 stands for a context that is no entry.
    r = ref.select(F.col(f"`{ref_id}`").cast("long").alias("rid"), F.col(f"`{ref_name}`").alias("name"), (F.col(f"`{ref_context}`") if ref_context else F.lit(None).cast("string")).alias("ctx")).where("name is not null")
    name, ctx = (tidy(fold(F.col(c)), words, (), signs) for c in ("name", "ctx"))
    names = r.select("rid", name.alias("alias"))
    if ref_context:
        both = r.where("ctx is not null").select("rid", F.concat_ws(" ", name, ctx).alias("alias"))
        alone = r.where("ctx is not null").select(F.lit(-1).cast("long").alias("rid"), ctx.alias("alias")).distinct()
        names = names.unionByName(both).unionByName(alone)
    names = names.withColumn("alias", F.regexp_replace("alias", " ", "")).where("alias <> ''").distinct()
    names = materialize(names.withColumn("aid", F.monotonically_increasing_id()), "alias")

    def unit(grams: DataFrame, key: str) -> DataFrame:
        """Weights of the n-grams as a vector of length 1, and what of its square is left from each n-gram on, rarest first."""
        whole = Window.partitionBy(key)
        rarest = whole.orderBy(F.col("w").desc(), "g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        x = grams.withColumn("x", F.col("tf") * F.col("w")).withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(whole)))
        return x.withColumn("left", F.sum(F.col("x") * F.col("x")).over(rarest)).select(key, "g", "w", "x", "left")

    tf = names.select("aid", F.explode(_grams(F.col("alias"))).alias("g")).groupBy("aid", "g").agg(F.count(F.lit(1)).alias("tf"))
    n_alias = names.count()
    top = math.log(1.0 + n_alias)
    idf = tf.groupBy("g").agg(F.log(1 + F.lit(n_alias) / F.count(F.lit(1))).alias("w"))
    index = materialize(unit(tf.join(idf, "g"), "aid"), "index")
    # The broadcast is decided by the counted size of the index; a larger reference list is joined by shuffle, with the same result.
    held = F.broadcast if index.count() <= INDEX_BROADCAST_ROWS else (lambda x: x)

    forms = pairs.select("form").repartition(parts, "form").distinct()
    asked = forms.select("form", F.explode(_grams(F.col("form"))).alias("g")).groupBy("form", "g").agg(F.count(F.lit(1)).alias("tf"))
    vectors = unit(asked.join(held(index.select("g", "w").distinct()), "g", "left").withColumn("w", F.coalesce("w", F.lit(top))), "form")
    # From each side the rarest n-grams are looked up, up to those with half the threshold's square left. What two vectors share
    # beyond them is worth at most half the threshold, so what they share among them must be worth the other half.
    half = threshold / 2
    needed = F.col("left") >= half * half - 1e-9
    part = F.sum(F.col("x") * F.col("y"))
    met = vectors.where(needed).select("form", "g", "x").join(held(index.where(needed).select("g", "aid", F.col("x").alias("y"))), "g").groupBy("form", "aid").agg(part.alias("part")).where(F.col("part") >= half - 1e-9)
    dot = met.select("form", "aid").join(vectors.select("form", "g", "x"), "form").join(held(index.select("aid", "g", F.col("x").alias("y"))), ["aid", "g"]).groupBy("form", "aid").agg(part.alias("cos"))
    scored = dot.where(F.col("cos") >= threshold).join(held(names), "aid").withColumn("slips", _slips(F.col("form"), F.col("alias"))).withColumn("core", F.least(F.length("form"), F.length("alias")))

    best = pairs.join(scored, "form").groupBy("v", "rid").agg(F.max(F.struct("cos", (-F.col("slips")).alias("neg"), "core")).alias("m")).select("v", "rid", "m.cos", (-F.col("m.neg")).alias("slips"), "m.core")
    near = best.withColumn("top", F.max("cos").over(Window.partitionBy("v"))).where((F.col("top") - F.col("cos") < margin) | (F.col("top") == F.col("cos")))
    w = Window.partitionBy("v").orderBy("slips", F.col("cos").desc(), "rid")
    ranked = near.select("*", F.row_number().over(w).alias("k"), F.lead("slips").over(w).alias("slips2"))
    won = ranked.where((F.col("k") == 1) & (F.col("slips2").isNull() | (F.col("slips") < F.col("slips2"))))
    if most_slips is not None:
        won = won.where(F.col("slips") <= F.least(F.lit(most_slips), F.when(F.col("core") < 5, 0).when(F.col("core") < 8, 1).when(F.col("core") < 14, 2).otherwise(most_slips)))
    kind = ref.schema[ref_id].dataType
    return v.join(won.select("v", "rid", "cos"), "v", "left").select(F.col("v").alias(value), F.coalesce("rid", F.lit(-1).cast("long")).cast(kind).alias(ref_id), F.coalesce("cos", F.lit(0.0)).alias("score"))


def map_column(df: DataFrame, value: str, ref: DataFrame, ref_id: str, ref_name: str, ref_context: str | None = None, **options: object) -> DataFrame:
    """``df`` with the id of the entry that ``value`` means; rows with a null ``value`` get null.

    The distinct values are mapped once and joined back; a hot value is one row on
    the mapping side, and its rows on the other side are split by the adaptive skew
    join. ``options`` are those of ``map_values``. A column of ``df`` named like ``ref_id`` is kept, the new one is then
    lengthened by ``_``.
    """
    out = fresh(ref_id, df.columns)
    v, i = fresh("_v", df.columns), fresh("_id", df.columns)
    m = map_values(df, value, ref, ref_id, ref_name, ref_context, **options).select(F.col(f"`{value}`").alias(v), F.col(f"`{ref_id}`").alias(i))
    return df.join(m, F.col(f"`{value}`") == F.col(v), "left").drop(v).withColumnRenamed(i, out)
