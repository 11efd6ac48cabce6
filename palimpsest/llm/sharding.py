"""Byte-balanced, sorted shards by histogram sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.workspace import stored

#: Bits of the key that one round of probes resolves, and how far a shard may be from its equal share of the bytes.
DIGIT, TOLERANCE = 12, 0.002

#: How far a piece of a shard may be from its equal share of the shard.
ROUGH = 0.5

#: A key is two unsigned 64-bit numbers: a hash of the text, so that equal texts are neighbours, and one of the id.
KEY = ("_k1", "_k2")
TOP = 1 << 64


def _signed(x: int) -> int:
    """Unsigned 64-bit to the signed number with the same order that the columns hold."""
    return x - (1 << 63)


def _long(x: int) -> str:
    """The signed number of an unsigned one, in SQL."""
    return f"cast('{_signed(x)}' AS bigint)"


def _histogram(table: DataFrame, ranges: list[tuple[int, int, int | None]]) -> dict[tuple[int, int], int]:
    """Exact bytes in each of the 2**DIGIT probe intervals of every range, counted over all rows in one pass.

    A range is (lowest, width, text): of the first key's values, or of the second's for the one first key ``text``.
    """
    tags = []
    for k, (low, width, text) in enumerate(ranges):
        key = F.col("_k1") if text is None else F.col("_k2")
        step = max(1, width >> DIGIT)
        inside = key.between(_signed(low), _signed(low + width - 1))
        inside = inside if text is None else inside & (F.col("_k1") == _signed(text))
        # ranges are aligned to their width, so the exclusive or is the distance from the lowest value
        probe = F.shiftrightunsigned(key.bitwiseXOR(F.lit(_signed(low))), step.bit_length() - 1)
        tags.append(F.when(inside, F.struct(F.lit(k).alias("range"), probe.alias("probe"))))
    counted = table.select(F.explode(F.array_compact(F.array(*tags))).alias("at"), "size").groupBy("at").agg(F.sum("size").alias("bytes"))
    return {(r["at"]["range"], r["at"]["probe"]): r["bytes"] for r in counted.collect()}


def find_splitters(table: DataFrame, shards: int, tolerance: float = TOLERANCE, pieces: int = 1) -> list[tuple[int, int]]:
    """``shards * pieces - 1`` keys with near-equal bytes of ``size`` between them; those inside a shard only roughly so.

    Every round counts the exact bytes below evenly spaced probes inside the
    interval that still holds each splitter's target, and narrows it to the
    probes around the target, until the nearer probe is within tolerance. The
    driver gets at most 4,096 sums for each splitter. An interval that has
    shrunk to one text goes on in the ids, so a group of equal texts is cut
    only where tolerance asks for it.
    """
    total = table.agg(F.sum("size")).first()[0] or 0
    allowed = [total / shards * (ROUGH / pieces if j % pieces else tolerance) / 2 for j in range(shards * pieces)]
    # for each splitter: lowest value, width and text of its interval, and the bytes below it
    open_at = {j: (0, TOP, None, 0) for j in range(1, shards * pieces)}
    found: dict[int, tuple[int, int]] = {}
    while open_at and total:
        ranges = sorted({x[:3] for x in open_at.values()}, key=lambda x: (x[0], x[1], x[2] or 0))
        sums = _histogram(table, ranges)
        for j, (low, width, text, below) in list(open_at.items()):
            k, step, target = ranges.index((low, width, text)), max(1, width >> DIGIT), total * j / (shards * pieces)
            for probe in range(width // step):
                inside = sums.get((k, probe), 0)
                if below + inside >= target:
                    break
                below += inside
            begin = low + probe * step
            near, bytes_off = min((begin, target - below), (begin + step, below + inside - target), key=lambda x: x[1])
            if bytes_off <= allowed[j] or (text is not None and step == 1):
                if text is None:
                    found[j] = (near, 0)
                else:
                    found[j] = (text, near) if near < TOP else (text + 1, 0)
                del open_at[j]
            elif step == 1:
                open_at[j] = (0, TOP, begin, below)
            else:
                open_at[j] = (begin, step, text, below)
    return [found.get(j, (TOP, 0)) for j in range(1, shards * pieces)]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table that is sorted: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and the key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        id_col,
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_k1"),
        F.xxhash64(F.col(id_col).cast("string")).alias("_k2"),
    )


def histogram_shards(
    spark: SparkSession, docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """Sort all rows by (hash of the text, hash of the id) into ``shards`` shards of near-equal bytes.

    Returns the id, ``size``, ``text_crc32``, ``shard`` and the row's gapless
    ``slot`` in its shard. Texts are read once, for a narrow table of hashes and
    sizes that the rounds count over; the text stays out of it. The splitters also cut every shard into pieces, one for each task,
    and the one exchange sends every row to its piece's partition.

    Null texts count as empty. Equal texts stay together in one shard unless the
    tolerance needs a cut, which then falls between ids; rows equal in id and
    text can't be told apart and stay together. An empty table gives no rows,
    and other columns are ignored. Reruns agree.
    """
    table = stored(spark, keyed(docs, id_col, text_col), "keyed")
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    splitters = [x for x in find_splitters(table, shards, tolerance, pieces) if x[0] < TOP]
    held = ", ".join(f"named_struct('a', {_long(a)}, 'b', {_long(min(b, TOP - 1))})" for a, b in splitters)
    piece = F.expr(f"size(filter(array({held}), s -> s.a < _k1 OR (s.a = _k1 AND s.b <= _k2)))" if splitters else "0")
    dealt = table.withColumn("_piece", piece).repartitionById(shards * pieces, "_piece").sortWithinPartitions("_piece", *KEY, id_col)
    fixed = stored(spark, dealt.withColumn("_row", F.monotonically_increasing_id()), "sharded")
    # a row for each piece, of which there are as many as tasks
    counted = {r["_piece"]: (r["n"], r["first"]) for r in fixed.groupBy("_piece").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()}
    offsets, slot = [], 0
    for k in range(shards * pieces):
        slot = 0 if k % pieces == 0 else slot
        n, first = counted.get(k, (0, 0))
        offsets.append((k, k // pieces, slot - first))
        slot += n
    placed = fixed.join(F.broadcast(spark.createDataFrame(offsets, "_piece int, shard int, _shift long")), "_piece")
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("_row") + F.col("_shift")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
