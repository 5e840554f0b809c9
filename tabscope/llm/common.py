"""Shared helpers of the text operators: ids, lineage cuts, hot-key joins.

Conventions of every operator in this package:

* a null ``doc_id`` sorts after every other id (and all null ids are one
  document); a null text is treated as the empty text unless stated otherwise;
* operators read the columns they name and nothing else, so further columns,
  whatever their names, neither matter nor reach the result; filters carry whole
  rows as one struct (``packed``) and return all columns as they came;
* rows that repeat an id with the same text give the same result row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

NULL_ID = 2 ** 63 - 1

#: Rows of a narrow table (a few numbers each) that one task takes at least.
NARROW_ROWS = 1 << 15

#: Code points that separate words in the contracts: space, tab to carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def id_key(name: str = "doc_id") -> Column:
    """The id as a total order: null becomes the largest long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(c: Column) -> Column:
    return F.when(c != F.lit(NULL_ID), c)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of at most ``rows`` rows in as many partitions as it needs.

    Small tables would else be dealt out, checkpointed and shuffled again as
    hundreds of nearly empty files. The number of partitions follows the rows.
    """
    return df.coalesce(1 + rows // NARROW_ROWS)


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, share: int = 1024, small: int = 1 << 12) -> DataFrame:
    """Inner join of many ``left`` rows to one ``right`` row per key, safe for hot keys.

    ``right.weight`` counts the left rows of the key; ``right`` is materialised
    and slim. Keys above ``1 / share`` of all counted rows number at most
    ``share``, so that part of ``right`` may be broadcast whatever the table
    sizes, and the hot rows stay where they are; all other keys take an
    ordinary shuffle join. ``left`` is then read twice. If there is no hot key
    one shuffle join does, and up to ``small`` rows, counted here, one broadcast.
    """
    total, rows, top = right.agg(F.sum(weight), F.count("*"), F.max(weight)).first()
    if rows <= small:
        return left.join(F.broadcast(right), keys)
    if top * share <= total:
        return left.join(right, keys)
    hot = F.col(weight) * F.lit(share) > F.lit(total)
    heavy, light = right.filter(hot), right.filter(~hot)
    slim = F.broadcast(heavy.select(*keys))
    return (left.join(F.broadcast(heavy), keys)
            .unionByName(left.join(slim, keys, "left_anti").join(light, keys)))


def _probes(x: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(x, 64 - bits), F.shiftrightunsigned(x, 40 - bits).bitwiseAND(F.lit((1 << bits) - 1)),
            F.shiftrightunsigned(F.xxhash64(x), 64 - bits)]


def bit_set(hashes: DataFrame, col: str, bits: int) -> Column:
    """A literal array of 2^(bits-6) longs with the three bits of every hash set."""
    b = hashes.select(F.explode(F.array(*_probes(F.col(col), bits))).alias("b"))
    rows = b.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    words = [0] * (1 << (bits - 6))
    for r in rows.collect():  # at most 2^(bits-6) rows
        words[r["w"]] = r["v"]
    return F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")


def has_bits(bitset: Column, x: Column, bits: int) -> Column:
    def one(b: Column) -> Column:
        return F.getbit(F.get(bitset, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
    a, b, c = _probes(x, bits)
    return one(a) & one(b) & one(c)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs meets a name of the operator's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias(name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and no other letter."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
