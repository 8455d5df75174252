"""Reading contact files, search results and fetched pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterlake import vocab
from rosterlake.session import cut_lineage

RESULT_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
])

_QUOTING = {"quote": '"', "escape": '"'}
_BYTES = "ISO-8859-1"


@dataclass(frozen=True)
class ContactFiles:
    """Contact CSVs of any headers and encodings, as one table of cells.

    ``files`` has one row per file: file, utf8, headers (its header line, cell by
    cell) and fields, for each header the store field it feeds or null. ``cells`` has
    one row per record: file, pos and cells, the texts in the order of the file's own
    headers. Cells have no names, so no header can clash with a column made here. ``pos``
    is (file, offset of the block, row), the order of rows within their file.
    """

    files: DataFrame
    cells: DataFrame

    def mapped(self, fields: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
        """pos and the cells that feed ``fields``; a field that a file lacks is null in its rows.

        ``extra`` adds columns by name, each from an expression over ``headers`` that gives
        the place of the cell. Fails if no file at all has a column of names.
        """
        named = F.array_contains("fields", "college_name")
        if not self.files.isEmpty() and self.files.where(named).isEmpty():
            raise ValueError(f"no name column among {self.files.first()['headers']}")
        wanted = {f: F.array_position("fields", f).cast("int") - 1 for f in fields} | (extra or {})
        places = self.files.select("file", *[p.alias(f"p{i}") for i, p in enumerate(wanted.values())])
        # An absent place is -1; `get` gives null for it, as for cells that a short row lacks.
        rows = self.cells.join(places, "file")
        return rows.select("pos", *[F.get("cells", F.coalesce(F.col(f"p{i}"), F.lit(-1))).alias(f) for i, f in enumerate(wanted)])

    def headers(self) -> tuple[str, ...]:
        """The header that all files share; unlike ones are refused."""
        kinds = [r["headers"] for r in self.files.select("headers").distinct().limit(2).collect()]
        if len(kinds) != 1:
            raise ValueError("the files don't share one header")
        return tuple(kinds[0])


def _plain(header: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")


def header_fields(headers: Column) -> Column:
    """For each header the store field it feeds, or null.

    Headers that equal an alias are placed first, then the rest by their longest
    alias prefix; a field is taken once and an unknown header stays out.
    """
    aliases = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(alias).alias("alias"), F.lit(len(alias)).alias("size"))
        for field, spellings in vocab.HEADER_ALIASES for alias in spellings
    ])
    spelled = F.transform(headers, lambda h, i: F.struct(_plain(h).alias("text"), i.alias("place")))
    none = F.array().cast("array<struct<field:string,place:int>>")

    def choose(taken: Column, header: Column, fits: Column) -> Column:
        best = F.array_max(F.transform(fits, lambda a: F.struct(a["size"].alias("size"), a["field"].alias("field"))))["field"]
        done = F.exists(taken, lambda t: t["place"] == header["place"])
        new = F.array(F.struct(best.alias("field"), header["place"].alias("place")))
        return F.when(done | best.isNull(), taken).otherwise(F.concat(taken, new))

    def free(taken: Column, alias: Column) -> Column:
        return ~F.exists(taken, lambda t: t["field"] == alias["field"])

    exact = F.aggregate(
        spelled, none, lambda taken, h: choose(taken, h, F.filter(aliases, lambda a: (a["alias"] == h["text"]) & free(taken, a)))
    )
    every = F.aggregate(
        spelled, exact, lambda taken, h: choose(taken, h, F.filter(aliases, lambda a: F.startswith(h["text"], a["alias"]) & free(taken, a)))
    )
    return F.transform(headers, lambda _, i: F.get(F.filter(every, lambda t: t["place"] == i), F.lit(0))["field"])


def unmapped_headers(files: DataFrame) -> DataFrame:
    """(file, header) for each header that feeds no field."""
    pairs = F.arrays_zip(F.col("headers").alias("header"), F.col("fields").alias("field"))
    return files.select("file", F.explode(pairs).alias("p")).where("p.field is null").select("file", "p.header")


def phone_place(headers: Column) -> Column:
    """Place of the phone column of a phone roster, by exact spelling, or null."""
    hits = F.filter(
        F.transform(headers, lambda h, i: F.struct(i.alias("place"), _plain(h).isin(*vocab.ROSTER_PHONE_HEADERS).alias("hit"))), lambda x: x["hit"]
    )
    return F.get(hits, F.lit(0))["place"]


def read_contact_files(spark: SparkSession, path: str | Sequence[str], *, multiline: bool = True) -> ContactFiles:
    """Contact CSVs, every cell text, whatever their headers and encodings.

    The first pass looks at bytes: the first line with something on it is a file's header, and a
    file is UTF-8 if all its lines are valid UTF-8, else ISO-8859-1. The second reads all files
    in one scan, as bytes, and decodes the cells by their file; separators and quotes
    are the same bytes in both encodings. No list of files comes to the driver, only
    the largest number of header cells. ``multiline`` allows line breaks inside cells (not in
    a header) at the price of one task per file; turn it off to split large files.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    written = F.trim(F.regexp_replace("value", "[\\r\\x{FEFF}]", "")) != ""
    heads = lines.groupBy("file").agg(
        F.min_by("value", F.when(written, F.col("at"))).alias("head"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    head = F.when(F.col("utf8"), F.col("head")).otherwise(F.decode(F.col("head").cast("binary"), _BYTES))
    heads = cut_lineage(heads.select("file", "utf8", F.regexp_replace(F.coalesce(head, F.lit("")), "^\\x{FEFF}|\\r$", "").alias("head")))
    commas = F.length("head") - F.length(F.replace(F.col("head"), F.lit(",")))
    width = (heads.agg(F.max(commas)).first()[0] or 0) + 1
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    cut = F.from_csv("head", schema, _QUOTING)
    listed = F.array(*[cut[n] for n in names])
    # A header ends with its last cell that says something.
    ends = F.array_max(F.transform(listed, lambda h, i: F.when(F.coalesce(h, F.lit("")) != "", i + 1).otherwise(0)))
    files = heads.select("file", "utf8", F.transform(F.slice(listed, 1, ends), lambda h: F.coalesce(h, F.lit(""))).alias("headers"))
    files = cut_lineage(files.withColumn("fields", header_fields(F.col("headers"))))
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multiline, encoding=_BYTES, **_QUOTING)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.array(*names).alias("raw"),
    )
    as_utf8 = F.transform("raw", lambda c: F.encode(c, _BYTES).cast("string"))
    cells = rows.join(files.select("file", "utf8"), "file").select(
        "file", F.struct("file", "block", "row").alias("pos"), F.when(F.col("utf8"), as_utf8).otherwise(F.col("raw")).alias("cells")
    )
    return ContactFiles(files, cells)


def read_roster(spark: SparkSession, path: str, *, with_phones: bool = False,
                multiline: bool = True) -> DataFrame:
    """Roster files as pos, name, state, stream (and phones) cells."""
    found = read_contact_files(spark, path, multiline=multiline)
    extra = {}
    if with_phones:
        extra["phones"] = phone_place(F.col("headers"))
        if not found.files.isEmpty() and found.files.where(extra["phones"].isNotNull()).isEmpty():
            raise ValueError(f"no phone column among {found.files.first()['headers']}")
    return found.mapped(("college_name", "state", "stream"), extra).withColumnRenamed("college_name", "name")


def read_search_results(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Search results (query, rank, url, title); rank is the result order."""
    return spark.read.schema(RESULT_SCHEMA).format(format).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: url, html, and where present markdown and payload."""
    pages = spark.read.parquet(path)
    wanted = [c for c in ("url", "html", "markdown", "payload") if c in pages.columns]
    return pages.select(*wanted)
