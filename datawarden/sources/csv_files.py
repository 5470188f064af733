"""CSV intake: a folder of files becomes one dataset per file, or a reject with a reason.

The folder is read as plain lines, split by split, twice. Whether a line starts inside quotes depends
on all lines before it, but only through one bit: every line maps the state it starts in (outside
or inside) to the state it ends in, and these maps compose. The first pass keeps two bits for each
line that holds a quote, composes them within a split and over the few splits of a file, and so
learns the state in which each split starts. The second pass carries the state along each split.
No text is shuffled but that of records of several lines, no file is read whole by one task, and
cells are written once; everything else reads those.

The driver holds file paths (as Spark's own file index does), never file content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.config import DATASET_NAME_CHARS, PREVIEW_ROWS
from datawarden.functions import scalars as s
from datawarden.operators.profile import spread, two_level_counts
from datawarden.session import new_run_dir

# Reject codes and the only messages a catalogue ever shows.
MESSAGES = {
    "unsupported_file_type": "Only .csv files can be read; save other formats as CSV.",
    "file_too_large": "File exceeds the size cap.",
    "empty_file": "File is empty or has no data rows.",
    "invalid_file": "File has an unterminated quote.",
    "record_too_long": "File has a quoted field that spans too many lines.",
    "invalid_name": "Name must have 1 to 255 characters.",
    "ragged": "File is not rectangular: a row's field count does not match the header.",
    "failed": "Ingestion failed: the file could not be profiled.",
}


def safe_message(code: str) -> str:
    """Authored text for a code, the generic text for any other failure, null for none."""
    known = s.looked_up(code, MESSAGES)
    return f"CASE WHEN {code} IS NOT NULL THEN coalesce({known}, {s.text(MESSAGES['failed'])}) END"


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv",)) -> DataFrame:
    """Id, path, name, size and type of every file below a folder; contents are not read.

    Scans skip empty files, so the names come from the file index of the scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = scan.selectExpr("_metadata.file_path AS file_id", "path", "length")
    # The index spells local files file:///x, the scan's metadata file:/x.
    ids = [re.sub("^file:/+", "file:/", f) for f in scan.inputFiles()]
    names = [(f, unquote(f.rsplit("/", 1)[-1])) for f in ids]
    listed = spark.createDataFrame(names, "file_id string, file_name string")
    is_csv = " OR ".join(f"endswith(lower(file_name), '{x}')" for x in suffixes)
    return listed.join(sizes, "file_id", "left").selectExpr(
        "file_id",
        "path",
        "file_name",
        "coalesce(length, 0L) AS size_bytes",
        f"CASE WHEN {is_csv} THEN 'CSV' WHEN endswith(lower(file_name), '.xlsx') THEN 'XLSX' END "
        "AS file_type",
    )


def _glob(suffixes: tuple[str, ...]) -> str:
    """The suffixes in any case, as a file name glob."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes]
    return "*{" + ",".join(each) + "}"


def fields_of(record: str, delimiter: str = ",") -> str:
    """The cells of a record's text, as an array; names or cells may repeat or be blank.

    NUL characters are removed; one then stands for a doubled quote, so that no pattern needs a
    repeated group. A field is quoted if it begins with an odd run of quotes and ends with one.
    Quotes in unquoted fields, and text behind a closing quote, are kept as they are.
    """
    d = re.escape(delimiter)
    marked = f"""replace(replace({record}, char(0), ''), '""', char(0))"""
    raw = (
        f"regexp_extract_all(concat({s.text(delimiter)}, {marked}), "
        f"r'{d}(\\x00*\"[^\"]*\"[^{d}]*|[^{d}]*)', 1)"
    )
    quoted = r"^(\x00*)\"([^\"]*)\"$"
    cell = (
        "CASE WHEN rlike(x, r'^\\x00+$') THEN repeat('\"', length(x) - 1) "
        f"WHEN rlike(x, r'{quoted}') THEN replace(regexp_replace(x, r'{quoted}', '$1$2'), char(0), '\"') "
        "ELSE replace(x, char(0), '\"\"') END"
    )
    return f"transform({raw}, x -> {cell})"


def _open_after(line: str, delimiter: str) -> str:
    """Whether a line that starts outside quotes ends inside. Quotes inside unquoted fields are text."""
    d = re.escape(delimiter)
    rest = f"""regexp_replace({line}, r'(^|{d})"[^"]*"', '$1')"""
    return f"""rlike({rest}, r'(^|{d})"')"""


#: A record of more lines rejects its file: its lines meet in one task.
MAX_RECORD_LINES = 1_000_000


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut at the same places by all reads inside, though the cluster may grow between."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def mapped_lines(
    spark: SparkSession, path: str, delimiter: str = ",", suffixes: tuple[str, ...] = (".csv",)
) -> DataFrame:
    """Every line of the files with its map of quote states, in the order of the files.

    `from_out` and `from_in` are the states (true: inside) after a line that starts outside or
    inside; a line without quotes keeps the state.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(suffixes))
        .text(path)
        .selectExpr(
            "_metadata.file_path AS file_id",
            "_metadata.file_block_start AS block",
            "monotonically_increasing_id() AS row",
            r"regexp_replace(value, r'^\x{FEFF}', '') AS line",
            # a doubled quote is text inside quotes, and opens and closes outside
            """replace(value, '""', '') AS plain""",
        )
    )
    closed = """regexp_replace(plain, r'^[^"]*"', 'x')"""
    return lines.selectExpr(
        "file_id", "block", "row", "line",
        f"""contains(plain, '"') AND {_open_after("regexp_replace(plain, r'^\\x{FEFF}', '')", delimiter)} AS from_out""",
        f"""NOT contains(plain, '"') OR {_open_after(closed, delimiter)} AS from_in""",
    )


def split_maps(lines: DataFrame) -> DataFrame:
    """(file_id, block, from_out, from_in): the maps of whole splits.

    Lines without quotes collapse to one row a split before they are shuffled, so what moves is two
    bits for each line that holds one.
    """
    quoted = "from_out OR NOT from_in"
    kept = lines.selectExpr(
        "file_id", "block", f"CASE WHEN {quoted} THEN row END AS row", "from_out", "from_in"
    ).groupBy("file_id", "block", "row").agg(F.max("from_out").alias("from_out"), F.max("from_in").alias("from_in"))
    order = "OVER (PARTITION BY file_id, block ORDER BY row NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = kept.selectExpr("*", f"count_if(from_out AND NOT from_in) {order} AS upto")
    # flips after the last line that sets the state, whatever it was before
    setter = "CASE WHEN from_out = from_in THEN struct(row, from_out AS v, upto AS n) END"
    whole = counted.groupBy("file_id", "block").agg(
        F.expr("max(upto) AS flips"), F.expr(f"max({setter}) AS setter")
    )
    return whole.selectExpr(
        "file_id", "block",
        "CASE WHEN setter IS NULL THEN flips % 2 = 1 ELSE setter.v <> ((flips - setter.n) % 2 = 1) END AS from_out",
        "CASE WHEN setter IS NULL THEN flips % 2 = 0 ELSE setter.v <> ((flips - setter.n) % 2 = 1) END AS from_in",
    )


def split_states(maps: DataFrame) -> DataFrame:
    """Per file and split the state it starts in, and the state in which the file ends."""
    # One row for each split of a file.
    over = "OVER (PARTITION BY file_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    counted = maps.selectExpr(
        "*", f"count_if(from_out AND NOT from_in) {over.format('CURRENT ROW')} AS upto"
    )
    sets = "CASE WHEN from_out = from_in THEN struct(from_out AS v, upto AS n) END"
    chained = counted.selectExpr(
        "*", f"last({sets}, true) {over.format('CURRENT ROW')} AS setter"
    ).selectExpr(
        "file_id", "block",
        "CASE WHEN setter IS NULL THEN upto % 2 = 1 ELSE setter.v <> ((upto - setter.n) % 2 = 1) END "
        "AS ends",
    )
    return chained.selectExpr(
        "file_id", "block",
        "coalesce(lag(ends) OVER (PARTITION BY file_id ORDER BY block), false) AS starts",
        "last(ends) OVER (PARTITION BY file_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND UNBOUNDED FOLLOWING) AS open_end",
    )


def _carried():
    """A scan along the splits of a task: per line the state it starts in and the line that heads
    its record (-1: one of an earlier split). It gets bits and numbers, never text."""

    def scan(batches):
        import numpy as np
        import pandas as pd

        split = state = head = None  # of the line before
        for keys, rows, from_out, from_in, starts in batches:
            k, row = keys.to_numpy(), rows.to_numpy()
            out, into, begin = (x.to_numpy(dtype=bool) for x in (from_out, from_in, starts))
            n = len(k)
            if n == 0:
                yield pd.DataFrame({"inside": out, "head": row})
                continue
            first = np.ones(n, dtype=bool)
            first[1:] = k[1:] != k[:-1]
            first[0] = split is None or k[0] != split
            # where the state is known: before the first line of a split, behind a line that sets it
            known = np.full(n + 1, -1, dtype=np.int8)
            known[1:][out == into] = out[out == into]
            known[:-1][first] = begin[first]
            if not first[0]:
                known[0] = state
            flips = np.concatenate([[0], np.cumsum(out & ~into)])
            at = np.maximum.accumulate(np.where(known >= 0, np.arange(n + 1), 0))
            now = known[at] ^ ((flips - flips[at]) & 1).astype(np.int8)
            inside = now[:-1].astype(bool)
            heads = np.where(inside, np.int64(-1), row)
            if not first[0] and inside[0]:
                heads[0] = head
            sets = ~inside | first
            sets[0] = True
            heads = heads[np.maximum.accumulate(np.where(sets, np.arange(n), 0))]
            split, state, head = k[-1], now[-1], heads[-1]
            yield pd.DataFrame({"inside": inside, "head": heads})

    return scan


def placed_lines(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with the state they start in (`inside`), whether they leave it open (`goes_on`) and the
    row that heads their record. The splits that start inside quotes, at most one row for each split
    of the input, are broadcast: the lines must not move, as their order is what is scanned."""
    inner = states.filter("starts").select("file_id", "block", "starts")
    joined = lines.join(F.broadcast(inner), ["file_id", "block"], "left")
    scan = F.pandas_udf(_typed(_carried()), "inside boolean, head bigint")
    scanned = joined.select(
        "file_id", "block", "row", "line", "from_out", "from_in",
        scan(
            F.xxhash64("file_id", "block"), F.col("row"), F.col("from_out"), F.col("from_in"),
            F.coalesce("starts", F.lit(False)),
        ).alias("s"),
    )
    return scanned.selectExpr(
        "file_id", "block", "row", "line", "s.inside AS inside", "s.head AS head",
        "CASE WHEN s.inside THEN from_in ELSE from_out END AS goes_on",
    )


def _typed(scan):
    """Type hints for an iterator function, given here so that it carries no reference to a module."""
    import pandas as pd

    scan.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return scan


def long_records(parts: DataFrame, states: DataFrame) -> DataFrame:
    """`parts` (file_id, block, row, head, line) of records of several lines, with `ord`: the place of
    the line that heads the record, also where that lies in an earlier split."""
    heads = parts.groupBy("file_id", "block").agg(F.expr("max(CASE WHEN head >= 0 THEN head END) AS head"))
    before = states.select("file_id", "block").join(heads, ["file_id", "block"], "left").selectExpr(
        "file_id", "block",
        "last(CASE WHEN head IS NOT NULL THEN struct(block, head AS row) END, true) OVER (PARTITION BY file_id "
        "ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier",
    )
    here = parts.filter("head >= 0").selectExpr("file_id", "struct(block, head AS row) AS ord", "block", "row", "line")
    across = parts.filter("head < 0").join(before, ["file_id", "block"]).selectExpr(
        "file_id", "earlier AS ord", "block", "row", "line"
    )
    return here.unionByName(across)


def joined_records(lines: DataFrame) -> DataFrame:
    """(file_id, ord, text): lines of one record joined by line feeds."""
    return lines.selectExpr("file_id", "ord", "struct(block, row, line) AS part").groupBy("file_id", "ord").agg(
        F.expr("array_join(transform(array_sort(collect_list(part)), p -> p.line), char(10)) AS text")
    )


def file_manifest(
    files: DataFrame,
    facts: DataFrame,
    max_bytes: int | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """One row per file with its headers, or the code that rejects it."""
    too_large = "false" if max_bytes is None else f"size_bytes > {int(max_bytes)}"
    given = f"coalesce({s.looked_up('file_id', names)}, {s.looked_up('file_name', names)})" if names else "CAST(NULL AS STRING)"
    code = (
        "CASE WHEN coalesce(file_type, '') <> 'CSV' THEN 'unsupported_file_type' "
        f"WHEN {too_large} THEN 'file_too_large' "
        f"WHEN length(trim(given)) NOT BETWEEN 1 AND {DATASET_NAME_CHARS} THEN 'invalid_name' "
        "WHEN open_end THEN 'invalid_file' "
        "WHEN too_long THEN 'record_too_long' "
        "WHEN coalesce(records, 0L) < 2 THEN 'empty_file' END"
    )
    judged = files.selectExpr("*", f"{given} AS given").join(facts, "file_id", "left")
    return judged.selectExpr("*", f"{code} AS code").selectExpr(
        "file_id",
        "path",
        "file_name",
        "coalesce(trim(given), file_name) AS name",
        "file_type",
        "size_bytes",
        "CASE WHEN code IS NULL THEN header END AS headers",
        "CASE WHEN code IS NULL THEN header_ord END AS header_ord",
        "code",
        f"{safe_message('code')} AS message",
    )


@dataclass
class CsvIntake:
    """The manifest of a folder and the rows of its accepted files, both written.

    `rows` has dataset_id, ord (the order within a file), cells (an array of texts, empty ones null)
    and ragged (another number of cells than the header has). `lines` is about their number.
    """

    manifest: DataFrame
    rows: DataFrame
    lines: int = 0

    def headers(self) -> DataFrame:
        return self.manifest.filter("code IS NULL").selectExpr(
            "file_id AS dataset_id", "posexplode(headers) AS (position, name)"
        )

    def cells(self) -> DataFrame:
        """Long form of all tables, whatever their widths. Rows are dealt evenly first, as splits of
        bytes would hold any number of them."""
        long = spread(self.rows, self.lines, "dataset_id", "ord").selectExpr("dataset_id", "ord", "posexplode(cells) AS (position, value)")
        return long.selectExpr(
            "coalesce(dataset_id, '') AS dataset_id", "ord",
            "coalesce(position, -1) AS position", f"{s.cell('value')} AS value",
        )

    def row_counts(self) -> DataFrame:
        spelled = "array_join(transform(cells, x -> coalesce(concat(length(x), ':', x), '~')), '')"
        return two_level_counts(self.rows.selectExpr("dataset_id", f"{spelled} AS spelled"))

    def preview(self, limit: int = PREVIEW_ROWS) -> DataFrame:
        """First rows per dataset; names are in the header table, by position."""
        ranked = self.rows.selectExpr(
            "dataset_id",
            "row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS row_number",
            f"transform(cells, (x, i) -> struct(i AS position, {s.shorten('x')} AS value)) AS cells",
        )
        return ranked.filter(f"row_number <= {int(limit)}")

    def shape(self) -> DataFrame:
        """Per dataset its rows and how many do not fit the header."""
        return self.rows.groupBy("dataset_id").agg(
            F.expr("count(1) AS row_count"), F.expr("count_if(ragged) AS ragged_rows")
        )


def read_csv_folder(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    max_bytes: int | None = None,
    suffixes: tuple[str, ...] = (".csv",),
    names: dict[str, str] | None = None,
    max_record_lines: int = MAX_RECORD_LINES,
) -> CsvIntake:
    """Manifest and tables of a folder. `names` gives datasets another name than their file's, by file id
    or file name.

    Split states, records and the manifest are written to the shared folder, one after the other.
    """
    work = new_run_dir(spark, "csv-intake")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    with same_splits(spark):
        lines = mapped_lines(spark, path, delimiter, suffixes)
        states = written("states", split_states(split_maps(lines)))
        placed = placed_lines(lines, states)
        several = "inside OR goes_on"
        pieces = written(
            "pieces",
            placed.filter(f"{several} OR trim(line) <> ''").selectExpr(
                "file_id", "block", "row", f"CASE WHEN {several} THEN head END AS head",
                f"CASE WHEN {several} THEN line END AS line",
                f"CASE WHEN NOT ({several}) THEN {fields_of('line', delimiter)} END AS fields",
            ),
        )
    ends = states.groupBy("file_id").agg(F.expr("bool_or(open_end) AS open_end"))
    parts = long_records(pieces.filter("head IS NOT NULL").drop("fields"), states)
    too_long = written(
        "too-long",
        parts.groupBy("file_id", "ord").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {int(max_record_lines)}")
        .select("file_id").distinct(),
    )
    unfit = ends.filter("open_end").select("file_id").unionByName(too_long)
    joined = written(
        "joined",
        joined_records(parts.join(unfit, "file_id", "left_anti")).selectExpr(
            "file_id", "ord", f"{fields_of('text', delimiter)} AS fields"
        ),
    )
    single = pieces.filter("fields IS NOT NULL").selectExpr("file_id", "struct(block, row) AS ord", "fields")
    parsed = single.unionByName(joined)
    counted = parsed.groupBy("file_id").agg(
        F.expr("count(1) AS records"), F.expr("min_by(struct(fields, ord), ord) AS first")
    )
    facts = (
        ends.join(counted, "file_id", "left")
        .join(too_long.withColumn("too_long", F.lit(True)), "file_id", "left")
        .selectExpr(
            "file_id", "open_end", "coalesce(too_long, false) AS too_long", "records", "first.fields AS header",
            "first.ord AS header_ord",
        )
    )
    manifest = written("manifest", file_manifest(list_files(spark, path, suffixes), facts, max_bytes, names))
    accepted = manifest.filter("code IS NULL").selectExpr("file_id", "header_ord", "size(headers) AS width")
    rows = parsed.join(accepted, "file_id").filter("ord <> header_ord").selectExpr(
        "file_id AS dataset_id", "ord",
        "transform(fields, x -> nullif(x, '')) AS cells", "size(fields) <> width AS ragged",
    )
    return CsvIntake(manifest, rows, pieces.count() + joined.count())  # from the files' footers
