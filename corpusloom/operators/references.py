"""References to records that do not exist.

A reference names a key of another table. It is an orphan if no record with
that key is alive at the reference's own time. The work is done in three steps:

1. The parent keys fill a Bloom filter whose bits are split over 64-bit words,
   one word for each key (a blocked filter). The words are built with
   ``bit_or`` under a shuffle on the word number; their number follows that of the
   parents, so that the filter is as sharp at any size. Up to ``MAX_WORDS`` they
   are broadcast; a larger filter meets the references by word number instead.
2. A reference whose bits are not all set is a definite orphan.
3. Only the references that the filter lets through meet the parents' life
   spans in an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.paths import norm_path

#: Words that are broadcast at most: 2**20 words of 8 bytes are about 32 MB as a hash table.
MAX_WORDS = 1 << 20
#: Parent keys for each word; 4 bits of 64 are set for each key.
KEYS_PER_WORD = 6


def _word_count(parents: int) -> int:
    words = 1
    while words * KEYS_PER_WORD < parents:
        words *= 2
    return words


def _word(key_hash: Column, words: int) -> Column:
    return F.pmod(key_hash, F.lit(words).cast("long"))


def _mask(key: Column) -> Column:
    """Four bits of a word, from a second hash of the key."""
    second = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(4):
        position = F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return mask


def bloom_words(parents: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits) of the blocked Bloom filter of ``parents[key]``."""
    k = F.col(key)
    return (
        parents.select(_word(F.xxhash64(k), words).alias("word"), _mask(k).alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )


def life_spans(parents: DataFrame) -> DataFrame:
    """Merge the life spans (key, born, died) of each key into disjoint ones.

    Spans without end need only their earliest start, and closed spans inside
    them are dropped; both are partial aggregates, so that a key with very many
    records shrinks before it is sorted. ``died`` is exclusive; null is open.
    A span without a start or with no length never holds a moment.
    """
    spans = (
        parents.filter(F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") > F.col("born"))))
        .groupBy("key", "born")
        .agg(F.max(F.col("died").isNull()).alias("open"), F.max("died").alias("died"))
        .withColumn("died", F.when(~F.col("open"), F.col("died")))
    )
    first_open = spans.filter("open").groupBy("key").agg(F.min("born").alias("open_from"))
    closed = (
        spans.filter(~F.col("open"))
        .join(first_open, "key", "left")
        .filter(F.col("open_from").isNull() | (F.col("born") < F.col("open_from")))
        .select("key", "born", "died")
    )
    before = Window.partitionBy("key").orderBy("born").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("born").rowsBetween(Window.unboundedPreceding, 0)
    islands = (
        closed.withColumn("reach", F.max("died").over(before))
        .withColumn("island", F.sum(F.when(F.col("born") <= F.col("reach"), 0).otherwise(1)).over(upto))
        .groupBy("key", "island")
        .agg(F.min("born").alias("born"), F.max("died").alias("died"))
        .select("key", "born", "died")
    )
    return islands.unionByName(first_open.select("key", F.col("open_from").alias("born"), F.lit(None).cast(parents.schema["died"].dataType).alias("died")))


def orphans(references: DataFrame, parents: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``references`` with no parent alive at their ``at``.

    ``references``: any columns, with ``key`` (string) and ``at`` (timestamp).
    ``parents``: ``key``, ``born``, ``died``. A null ``key`` is no reference and
    never comes out; a null ``at`` meets no life span, so it does come out.
    Repeated references come out as often as they go in. With no parents every
    reference is an orphan.
    """
    references = references.filter(F.col("key").isNotNull())
    parents = parents.select("key", "born", "died").filter("key is not null")
    words = _word_count(parents.select(F.approx_count_distinct("key")).first()[0])
    bloom = bloom_words(parents, "key", words)
    bloom = F.broadcast(bloom) if words <= max_words else bloom
    mask = _mask(F.col("key"))
    tested = (
        references.withColumn("_word", _word(F.xxhash64("key"), words))
        .join(bloom.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")), "_word", "left")
        .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False)))
        .drop("_word", "_bits")
    )
    definite = tested.filter(~F.col("_maybe")).drop("_maybe")
    maybe = tested.filter("_maybe").drop("_maybe")
    spans = life_spans(parents).select(F.col("key").alias("_key"), "born", "died")
    alive = (F.col("key") == F.col("_key")) & (F.col("at") >= F.col("born")) & (F.col("died").isNull() | (F.col("at") < F.col("died")))
    return definite.unionByName(maybe.join(spans, alive, "left_anti"))


def file_parents(files: DataFrame) -> DataFrame:
    """Life spans of files by repository and normalised path."""
    return files.select(_key("F", norm_path(F.col("path"))).alias("key"), F.col("scanned_at").alias("born"), F.col("removed_at").alias("died"))


def symbol_parents(symbols: DataFrame) -> DataFrame:
    """Life spans of symbols by repository and name, or ``Parent.name``."""
    name = F.when(F.col("parent_symbol").isNull(), F.col("name")).otherwise(F.concat_ws(".", "parent_symbol", "name"))
    return symbols.filter(F.col("name").isNotNull()).select(_key("S", name).alias("key"), F.col("scanned_at").alias("born"), F.col("removed_at").alias("died"))


def _key(kind: str, value: Column) -> Column:
    """Kind, repository and value as one string; null if the value is null. A null repository equals a null repository."""
    return F.when(value.isNotNull(), F.concat(F.lit(kind), F.coalesce(F.concat(F.lit("="), "repo"), F.lit("-")), F.lit("\u0001"), value))


def corpus_references(imports: DataFrame, calls: DataFrame, rules: DataFrame) -> DataFrame:
    """All references of the three tables: ref_table, ref_id, ref_pos, repo, key, at."""
    made = F.lit(0).cast("int").alias("ref_pos")
    of_imports = imports.select(F.lit("imports").alias("ref_table"), F.col("import_id").alias("ref_id"), made, "repo", _key("F", norm_path(F.col("resolved_path"))).alias("key"), F.col("scanned_at").alias("at"))
    inside = F.when(~F.col("callee").startswith("external:"), F.col("callee"))
    of_calls = calls.select(F.lit("calls").alias("ref_table"), F.col("call_id").alias("ref_id"), made, "repo", _key("S", inside).alias("key"), F.col("scanned_at").alias("at"))
    entries = rules.select("rule_no", "repo", "mined_at", F.posexplode("evidence").alias("p", "e"))
    of_rules = entries.select(
        F.lit("rules").alias("ref_table"), F.col("rule_no").alias("ref_id"), (F.col("p") + 1).cast("int").alias("ref_pos"), "repo", _key("F", norm_path(F.col("e.file"))).alias("key"), F.col("mined_at").alias("at")
    )
    return of_imports.unionByName(of_calls).unionByName(of_rules).filter("key is not null").distinct()


def orphan_references(imports: DataFrame, calls: DataFrame, rules: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference with no target alive at its own time (ref_table, ref_id, ref_pos, at)."""
    parents = file_parents(files).unionByName(symbol_parents(symbols)).distinct()
    refs = corpus_references(imports, calls, rules)
    return orphans(refs, parents).select("ref_table", "ref_id", "ref_pos", "at")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans by table and month."""
    return found.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
