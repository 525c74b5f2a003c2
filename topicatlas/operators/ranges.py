"""Address ranges: unique, with their ends, and as an index of cells with few starts each.

The space of addresses is cut in four steps, at 16, 20, 24 and 28 bits: a cell with
more than ``STARTS_PER_CELL`` range starts is cut into sixteen.  What was cut is told by a
directory of at most a row per block of 65,536 addresses, so an address finds its cell
by one broadcast join of bounded size, and the lookup is an equi-join on the cell.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicatlas.functions.ip import IPV4_MAX
from topicatlas.operators.lineage import cut_lineage
from topicatlas.operators.skew import row_bytes

# IPv4 has 65,536 blocks of 65,536 addresses: tables of one row per block are
# bounded whatever the data, and so are the distinct addresses of a block.
BLOCK_BITS = 16
BLOCKS = 1 << (32 - BLOCK_BITS)

#: A cell of 28 bits has 16 addresses, so no cell has more starts, nor pieces but one.
STARTS_PER_CELL = 16


def dedup_locations(locations: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per ``ip_from``: the one greatest in ``order`` (by default all columns)."""
    others = [name for name in locations.columns if name != "ip_from"]
    ranking = F.struct(*(order or others), *others)
    best = locations.groupBy("ip_from").agg(F.max_by(F.struct(*others), ranking).alias("_row"))
    return best.select("ip_from", *[F.col("_row")[name].alias(name) for name in others])


def _ipv4(locations: DataFrame) -> DataFrame:
    return locations.filter(F.col("ip_from").between(0, IPV4_MAX))


def _within_ipv4(address: Column) -> Column:
    # Larger numbers belong to the last range; least() would also turn null into the end.
    return F.when(address > IPV4_MAX, F.lit(IPV4_MAX)).otherwise(address)


def _block(column: str) -> Column:
    return F.shiftright(column, BLOCK_BITS).cast("int")


def with_range_end(locations: DataFrame) -> DataFrame:
    """Adds ``range_end``, the address before the next start, without a global sort.

    Starts are ordered inside their block only; the next start of a block's last
    range is the first start of the next block in use, from a table of at most
    65,536 rows.
    """
    blocks = _ipv4(locations).withColumn("_block", _block("ip_from"))
    heads = blocks.groupBy("_block").agg(F.min("ip_from").alias("_head"))
    following = heads.select(
        F.col("_block"), F.lead("_head").over(W.orderBy("_block")).alias("_next_head")
    )
    inside = F.lead("ip_from").over(W.partitionBy("_block").orderBy("ip_from"))
    ended = blocks.withColumn("_next", inside).join(F.broadcast(following), "_block")
    end = F.coalesce("_next", "_next_head", F.lit(IPV4_MAX + 1)) - 1
    return ended.withColumn("range_end", end).drop("_block", "_next", "_next_head")


def prepare_ranges(locations: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Unique ranges with their ``range_end``.

    The operators take any location table, but a prepared one saves them this work,
    and :func:`index_ranges` the rest.
    """
    return with_range_end(dedup_locations(locations, order))


def is_prepared(locations: DataFrame) -> bool:
    return "range_end" in locations.columns


@dataclass(frozen=True)
class RangeIndex:
    """Prepared ranges cut at the borders of cells, as written tables, and their statistics.

    ``cells`` has ``cell``, the first address of the cell, ``class_ip``, ``range_end`` and
    all columns of the locations; ``directory`` says which cells are cut.  With the
    statistics at hand a lookup is planned without looking at the data.
    """

    cells: DataFrame
    directory: DataFrame
    #: Ranges, their pieces, the most pieces of a cell, and bytes of text by column.
    n_ranges: int
    n_pieces: int
    fullest: int
    text_bytes: dict[str, int]

    @property
    def ranges(self) -> DataFrame:
        """The prepared ranges: the pieces in the cells their ranges begin in."""
        others = [name for name in self.cells.columns if name not in ("cell", "class_ip")]
        begun = self.cells.filter("_first").drop("_first")
        return begun.select(F.col("class_ip").alias("ip_from"), *[n for n in others if n != "_first"])

    def _bytes(self, rows: int, columns: Sequence[str]) -> int:
        return row_bytes(rows, len(columns)) + sum(self.text_bytes.get(c, 0) for c in columns)

    def piece_bytes(self, columns: Sequence[str]) -> int:
        """Memory of all pieces with these columns as a broadcast."""
        return self._bytes(self.n_pieces, columns)

    def range_bytes(self, columns: Sequence[str]) -> int:
        """The same of the ranges; their texts are part of those of the pieces."""
        return self._bytes(self.n_ranges, columns)


def _directory(starts: DataFrame) -> DataFrame:
    """``block, cut20`` and ``cut24_0..3``: which cells of 20 and 24 bits of a cut block are cut.

    A bit for each of the 16 cells of 20 bits, and in four words one for each of the 256
    of 24 bits.  Blocks that are not cut have no row.
    """
    at24 = starts.groupBy(F.shiftright("ip_from", 8).alias("p24")).agg(F.count("*").alias("n"))
    crowded = F.col("n") > STARTS_PER_CELL
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))
    at20 = at24.groupBy(F.shiftright("p24", 4).alias("p20")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.bit_or(F.when(crowded, bit(F.col("p24") % 16))), F.lit(0).cast("bigint")).alias("cut"),
    )
    child = (F.col("p20") % 16).cast("int")
    words = [
        F.coalesce(
            F.bit_or(F.when(F.floor(child / 4) == word, F.call_function("shiftleft", F.col("cut"), (child % 4) * 16))),
            F.lit(0).cast("bigint"),
        ).alias(f"cut24_{word}")
        for word in range(4)
    ]
    blocks = at20.groupBy(F.shiftright("p20", 4).cast("int").alias("block")).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.bit_or(F.when(crowded, bit(child))), F.lit(0).cast("bigint")).alias("cut20"),
        *words,
    )
    return blocks.filter(crowded).drop("n")


def _is_cut20(p20: Column) -> Column:
    return F.col("cut20").isNotNull() & (F.getbit("cut20", (p20 % 16).cast("int")) == 1)


def _is_cut24(p24: Column) -> Column:
    place = (p24 % 256).cast("int")
    word = F.lit(0).cast("tinyint")
    for k in range(4):
        word = F.when(F.floor(place / 64) == k, F.getbit(f"cut24_{k}", place % 64)).otherwise(word)
    return word == 1


def with_cell(df: DataFrame, address: str, directory: DataFrame) -> DataFrame:
    """Adds ``cell``, the first address of the cell that holds ``address``; null for null."""
    blocks = directory.withColumnRenamed("block", "_block")
    # At most 65,536 rows of six numbers.
    found = df.withColumn("_at", _block(address)).join(
        F.broadcast(blocks), F.col("_at") == F.col("_block"), "left"
    )
    number = F.col(address)
    p20, p24 = F.shiftright(number, 12), F.shiftright(number, 8)
    bits = (
        F.when(F.col("_block").isNull(), 16).when(~_is_cut20(p20), 12).when(~_is_cut24(p24), 8).otherwise(4)
    )
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
    return found.withColumn("cell", number - F.pmod(number, size)).drop("_at", *blocks.columns)


def cell_pieces(ranges: DataFrame, directory: DataFrame) -> DataFrame:
    """``cell, class_ip, range_end, _first`` and all columns: a row per range and cell it touches.

    ``_first`` marks the cell a range begins in.
    """
    none = F.array(F.lit(None).cast("bigint"))
    rows = ranges.withColumnRenamed("ip_from", "class_ip").withColumn(
        "_in", F.explode(F.sequence(_block("class_ip"), _block("range_end")))
    )
    rows = rows.join(F.broadcast(directory.withColumnRenamed("block", "_block")), F.col("_in") == F.col("_block"), "left")
    cell, low, high = F.shiftleft(F.col("_in").cast("bigint"), BLOCK_BITS), F.col("class_ip"), F.col("range_end")
    low, high = F.greatest(low, cell), F.least(high, cell + ((1 << BLOCK_BITS) - 1))
    rows = rows.withColumns({"cell": cell, "_low": low, "_high": high})
    for bits, is_cut in (
        (12, F.col("_block").isNotNull()),
        (8, F.col("_p").isNotNull() & _is_cut20(F.col("_p"))),
        (4, F.col("_p").isNotNull() & _is_cut24(F.col("_p"))),
    ):
        parts = F.sequence(F.shiftright("_low", bits), F.shiftright("_high", bits))
        rows = rows.withColumn("_p", F.explode(F.when(is_cut, parts).otherwise(none)))
        within = F.shiftleft("_p", bits)
        rows = rows.withColumns(
            {
                "cell": F.coalesce(within, "cell"),
                "_low": F.greatest("_low", within),
                "_high": F.least("_high", within + ((1 << bits) - 1)),
            }
        )
    others = [name for name in ranges.columns if name not in ("ip_from", "range_end")]
    first = (F.col("_low") == F.col("class_ip")).alias("_first")
    return rows.select("cell", "class_ip", "range_end", first, *others)


def _statistics(cells: DataFrame) -> DataFrame:
    """One row; counts are combined by cell before they meet."""
    texts = [f.name for f in cells.schema.fields if f.dataType.simpleString() == "string"]
    sizes = [F.sum(F.octet_length(name)).alias(f"text_{name}") for name in texts]
    by_cell = cells.groupBy("cell").agg(F.count("*").alias("pieces"), F.sum(F.col("_first").cast("int")).alias("ranges"), *sizes)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    names = [F.lit(name) for name in texts]
    return by_cell.agg(
        total("ranges").alias("n_ranges"),
        total("pieces").alias("n_pieces"),
        F.coalesce(F.max("pieces"), F.lit(0)).alias("fullest"),
        F.map_from_arrays(
            F.array(*names).cast("array<string>"),
            F.array(*[total(f"text_{name}") for name in texts]).cast("array<bigint>"),
        ).alias("text_bytes"),
    )


def index_ranges(locations: DataFrame, order: Sequence[str] | None = None) -> RangeIndex:
    """The index of a location table, prepared or not, in the shared folder."""
    prepared = locations
    if not is_prepared(locations):
        # The source is read once, also where it counts what it leaves out.
        prepared = with_range_end(cut_lineage(dedup_locations(locations, order), "unique-ranges"))
    prepared = cut_lineage(prepared, "ranges")
    directory = cut_lineage(_directory(prepared.select("ip_from")), "directory")
    cells = cut_lineage(cell_pieces(prepared, directory), "cells")
    return _index(cells, directory, _statistics(cells).first())


def _index(cells: DataFrame, directory: DataFrame, statistics) -> RangeIndex:
    known = statistics.asDict()
    return RangeIndex(cells, directory, known["n_ranges"], known["n_pieces"], known["fullest"], dict(known["text_bytes"]))


def write_range_index(index: RangeIndex, path: str, mode: str = "errorifexists") -> None:
    """Stores an index, its statistics beside it, for later runs."""
    spark = index.cells.sparkSession
    index.cells.write.mode(mode).parquet(f"{path}/cells")
    index.directory.write.mode(mode).parquet(f"{path}/directory")
    known = [(index.n_ranges, index.n_pieces, index.fullest, index.text_bytes)]
    schema = "n_ranges long, n_pieces long, fullest long, text_bytes map<string,long>"
    spark.createDataFrame(known, schema).write.mode(mode).parquet(f"{path}/statistics")


def read_range_index(spark: SparkSession, path: str) -> RangeIndex:
    """A stored index; only its one row of statistics is read here."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("cells", "directory", "statistics")}
    return _index(tables["cells"], tables["directory"], tables["statistics"].first())
