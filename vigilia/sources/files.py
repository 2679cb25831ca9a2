"""Outage files: discovery, processing state, encoding, reading, log upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.relational import first_per_key, stack
from ..session import materialize

BAD = "_corrupt_record"

# Characters 0x80-0x9F as Latin-1 decodes them, and what code page 1252 has there.
_C1 = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
LATIN1_C1 = "".join(a for a, _ in _C1)
CP1252_C1 = "".join(b for _, b in _C1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover(spark: SparkSession, folder: str, pattern: str = S.OUTAGE_FILE_PATTERN, min_anomes: str = "") -> DataFrame:
    """Files of a folder whose name matches, with size, time, month (from the stamp) and region.

    Reads the listing only: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.col("path").alias("arquivo_path"), file_name(F.col("path")).alias("arquivo_nome"),
        F.col("length").alias("arquivo_tamanho_bytes"), F.col("modificationTime").alias("arquivo_modificado_em"),
    )
    named = files.where(F.col("arquivo_nome").rlike(pattern)).withColumns({
        "carimbo": F.regexp_extract("arquivo_nome", pattern, 1),
        "anomes": F.substring(F.regexp_extract("arquivo_nome", pattern, 1), 1, 6),
        "regional": F.upper(F.regexp_extract("arquivo_nome", pattern, 2)),
    })
    return named.where(F.col("anomes") >= min_anomes) if min_anomes else named


FILE_KEY = ["arquivo_path", "arquivo_tamanho_bytes", "arquivo_modificado_em"]


def pending(files: DataFrame, log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files not logged as processed with the same path, size and time."""
    key = key or FILE_KEY
    done = log.where(F.lower(F.trim("status")) == "processado").select(*key).distinct()
    return files.join(done, key, "left_anti")


def file_status(files: DataFrame, log: DataFrame) -> DataFrame:
    """Latest logged status per file, by path, else by name, else ``pendente``."""
    entries = log.select(
        F.lower(F.trim("arquivo_path")).alias("_p"), F.lower(F.trim("arquivo_nome")).alias("_n"),
        F.lower(F.trim("status")).alias("_s"), F.coalesce(F.col("processado_em").cast("string"), F.lit("")).alias("_t"),
    )
    latest = [F.desc("_t"), F.asc_nulls_last("_s")]
    by_path = first_per_key(entries, ["_p"], latest).select("_p", F.nullif("_s", F.lit("")).alias("_sp"))
    by_name = first_per_key(entries, ["_n"], latest).select("_n", F.nullif("_s", F.lit("")).alias("_sn"))
    out = files.withColumns({"_p": F.lower(F.trim("arquivo_path")), "_n": F.lower(F.trim("arquivo_nome"))})
    out = out.join(by_path, "_p", "left").join(by_name, "_n", "left")
    return out.withColumn("status", F.coalesce("_sp", "_sn", F.lit("pendente"))).drop("_p", "_n", "_sp", "_sn")


def status_counts(status: DataFrame) -> DataFrame:
    """Files found, processed, pending and failed per month."""
    count = lambda c: F.sum(c.cast("long"))
    return status.groupBy("anomes").agg(
        F.count("*").alias("arquivos_encontrados"), count(F.col("status") == "processado").alias("arquivos_processados"),
        count(F.col("status") != "processado").alias("arquivos_pendentes"), count(F.col("status") == "erro").alias("arquivos_com_erro"),
    )


def scan_lines(spark: SparkSession, paths: list[str], key: list[str] | None = None) -> DataFrame:
    """The lines of files with their path, byte for character (Latin-1), and what a line says about its file.

    ``cabecalho`` is the line where it names the record key; ``utf8`` and ``indefinido`` say whether its bytes are UTF-8 and, if
    not, whether code page 1252 leaves one of them undefined. Blank lines are left out.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("arquivo_path"))
    names = key or S.RECORD_KEY
    # A line is split only where the names occur in it at all.
    is_header = reduce(lambda a, b: a & b, [F.contains(F.col("value"), F.lit(c)) for c in names])
    for c in names:
        is_header = is_header & F.array_contains(F.split("value", r"\|"), c)
    valid, plain = F.expr("is_valid_utf8(value)"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    # Undefined bytes are looked for only where a line is not UTF-8.
    undefined = plain.rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")
    return lines.select(
        "arquivo_path", plain.alias("linha"), F.when(is_header, plain).alias("cabecalho"), valid.alias("utf8"),
        F.when(~valid, undefined).otherwise(F.lit(False)).alias("indefinido"),
    ).where(F.col("linha").rlike("[^\\x00-\\x20]"))


def stage_lines(spark: SparkSession, paths: list[str], key: list[str] | None = None) -> DataFrame:
    """``scan_lines``, stored: the one time the text itself is read."""
    return materialize(scan_lines(spark, paths, key), "linhas")


def classify(lines: DataFrame) -> DataFrame:
    """Per file of ``scan_lines``: header line and encoding (UTF-8 when every line is, else 1252, else Latin-1).

    The lines are counted by hash, which a minimum of texts would sort in memory; only header lines are compared as texts.
    """
    flags = lines.groupBy("arquivo_path").agg(F.min("utf8").alias("_utf8"), F.max("indefinido").alias("_undefined"))
    headers = lines.where(F.col("cabecalho").isNotNull()).groupBy("arquivo_path").agg(F.min("cabecalho").alias("cabecalho_bruto"))
    encoding = F.when(F.col("_utf8"), F.lit("utf-8")).when(F.col("_undefined"), F.lit("latin-1")).otherwise(F.lit("cp1252"))
    known = flags.join(headers, "arquivo_path", "left").select("arquivo_path", "cabecalho_bruto", encoding.alias("encoding"))
    return known.withColumn("cabecalho", decoded("cabecalho_bruto"))


def decoded(line: str) -> Column:
    """Text of a line that was read byte for character, by the ``encoding`` of its file."""
    text = F.col(line)
    ascii_only = F.octet_length(text) == F.char_length(text)
    utf8 = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when(ascii_only, text).when(F.col("encoding") == "utf-8", utf8).when(
        F.col("encoding") == "cp1252", F.translate(text, LATIN1_C1, CP1252_C1)).otherwise(text)


def read_group(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Files with one header, all text, blanks as null, with their path; a line that does not fit fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).options(sep=S.CSV_SEPARATOR, header=True, mode="FAILFAST", encoding="UTF-8", enforceSchema=False).csv(paths)
    return rows.select(*[F.nullif(F.col(c), F.lit(" ")).alias(c) for c in columns], F.col("_metadata.file_path").alias("arquivo_path"))


def header_names(line: str) -> tuple[str, ...]:
    return tuple(n.strip().lstrip("\ufeff") for n in line.split(S.CSV_SEPARATOR))


def parse_lines(spark: SparkSession, lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of ``scan_lines`` by ``classify``: every line parsed by the header of its file, the columns of all headers by name.

    All text, blanks as null, absent columns null; ``BAD`` has the lines that do not fit their header. Files without a header have no
    rows. What reaches the driver is the distinct header lines, one for each layout and encoding there is; each file, with the number of
    its own, is broadcast, so that no line is exchanged, however many a file has.
    """
    known = ["cabecalho_bruto", "encoding", "cabecalho"]
    kinds_found = sorted(tuple(r) for r in kinds.where("cabecalho IS NOT NULL").select(*known).distinct().toLocalIterator())
    same = lambda kind: reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(known, kind)])
    number = F.coalesce(*[F.when(same(kind), F.lit(i)) for i, kind in enumerate(kinds_found)], F.lit(None).cast("int"))
    files = kinds.select("arquivo_path", "encoding", number.alias("_kind")).where("_kind IS NOT NULL")
    header = F.get(F.array(*[F.lit(kind[0]) for kind in kinds_found]).cast("array<string>"), F.col("_kind"))
    joined = lines.select("arquivo_path", "linha").join(F.broadcast(files), "arquivo_path").where(F.col("linha") != header)
    rows = joined.select("arquivo_path", "_kind", decoded("linha").alias("texto"))
    options = {"sep": S.CSV_SEPARATOR, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    found: dict[str, list[Column]] = {c: [] for c in S.RECORD_KEY}
    for i, layout in enumerate(sorted({kind[2] for kind in kinds_found})):
        names = header_names(layout)
        schema = ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in (*names, BAD))
        of_layout = F.col("_kind").isin([k for k, kind in enumerate(kinds_found) if kind[2] == layout])
        rows = rows.withColumn(f"_p{i}", F.from_csv(F.when(of_layout, F.col("texto")), schema, options))
        for n in (*names, BAD):
            found.setdefault(n, []).append(F.col(f"_p{i}")[n])
    bad = found.pop(BAD, [])
    text = lambda cells: F.coalesce(*cells) if cells else F.lit(None).cast("string")
    return rows.select(*[F.nullif(text(cells), F.lit(" ")).alias(n) for n, cells in found.items()], text(bad).alias(BAD), "arquivo_path")


def read_outage_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw rows of many files, whose text is read once: see ``parse_lines``. A file without a header has no rows here (``headerless``
    lists those), and the others are unaffected."""
    lines = stage_lines(spark, paths)
    return with_file_columns(parse_lines(spark, lines, materialize(classify(lines), "cabecalhos")))


def headerless(kinds: DataFrame) -> DataFrame:
    """Files (of ``classify``) in which no line names the record key; a file without lines is not among them."""
    return kinds.where("cabecalho IS NULL").select("arquivo_path")


def with_file_columns(rows: DataFrame) -> DataFrame:
    """Month, stamp, region and name of the file a row came from."""
    name = file_name(F.col("arquivo_path"))
    return rows.withColumns({
        "arquivo_nome": name, "snapshot_ts": F.regexp_extract(name, S.OUTAGE_FILE_PATTERN, 1),
        "anomes": F.nullif(F.substring(F.regexp_extract(name, S.OUTAGE_FILE_PATTERN, 1), 1, 6), F.lit("")),
        "REGIONAL_ORIGEM": F.nullif(F.upper(F.regexp_extract(name, S.OUTAGE_FILE_PATTERN, 2)), F.lit("")),
    })


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def bad_rows(rows: DataFrame) -> DataFrame:
    """Lines that do not fit their header, with their file."""
    return rows.where(F.col(BAD).isNotNull()).select("arquivo_path", F.col(BAD).alias("linha"))


def read_months(spark: SparkSession, *paths: str) -> DataFrame:
    """Month files stacked by name, with the month their file name states."""
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    return rows.withColumn(
        "ANOMES_PROCESSAMENTO", F.regexp_extract(F.col("_metadata.file_path"), r"agrupamento_oms_([0-9]{6})(?:\.parquet|/)", 1)
    )


def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each file of a folder."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("arquivo_path"), F.col("_metadata.file_block_start").alias("_start"))
    # Rows of a file's first block are numbered in their order within the task that reads it.
    numbered = lines.where("_start = 0").withColumn("_n", F.monotonically_increasing_id())
    return numbered.groupBy("arquivo_path").agg(F.min_by("value", "_n").alias("cabecalho"))


def read_closing(spark: SparkSession, folder: str) -> DataFrame:
    """Closing files, each read by its own header and stacked by name; bad lines fail the read; the file name is kept."""
    groups: dict[tuple, list[str]] = {}
    for row in first_lines(spark, folder).toLocalIterator():
        groups.setdefault(header_names(row.cabecalho), []).append(row.arquivo_path)
    if not groups:
        raise ValueError(f"no closing file in {folder}")
    frames = [read_group(spark, files, list(names)) for names, files in sorted(groups.items())]
    return stack(*frames).withColumn("arquivo_origem", file_name(F.col("arquivo_path"))).drop("arquivo_path")


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict | None = None, partition: dict | None = None,
              rename=str.upper) -> DataFrame:
    """Extract through JDBC, all columns as text under upper-case names (``rename=str.lower`` for the component dimension).

    ``partition``: ``partitionColumn, lowerBound, upperBound, numPartitions`` split the read; then ``query`` goes in as a
    derived table, which the option set requires.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", 10000).options(**(properties or {}))
    if partition:
        reader = reader.option("dbtable", f"({query}) q").options(**{k: str(v) for k, v in partition.items()})
    else:
        reader = reader.option("query", query)
    rows = reader.load()
    return rows.select(*[F.col(c).cast("string").alias(rename(c)) for c in rows.columns])


def month_params(anomes: str) -> dict:
    """Named parameters of a month for ``spark.sql(text, args=...)``."""
    year, month = int(anomes[:4]), int(anomes[4:])
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    return {"anomes": anomes, "ano": year, "mes": month, "inicio": f"{year:04d}-{month:02d}-01", "proximo": after}


def inventory(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """Files of each layer with month, size and time."""
    frames = []
    for layer, folder in layers.items():
        files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(folder)
        frames.append(files.select(
            F.lit(layer).alias("fonte"), file_name(F.col("path")).alias("arquivo"), F.col("path").alias("caminho"),
            F.regexp_extract("path", r"(?:anomes=|_)([0-9]{6})(?:/|_|\.)", 1).alias("anomes"),
            F.col("length").alias("tamanho_bytes"), F.col("modificationTime").alias("modificado_em"),
        ))
    return stack(*frames)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Header names without accents, lower case, blanks as underscores."""
    import unicodedata

    def plain(name: str) -> str:
        text = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
        return text.strip().lower().replace(" ", "_")

    return df.toDF(*[plain(c) for c in df.columns])


def consumer_counts(spark: SparkSession, month: int, source: DataFrame | None = None) -> DataFrame:
    """Consumers per region of a month: other months when it has none, the built-in table without a source."""
    from ..operators.relational import find_column, resolve

    if source is None:
        rows = spark.createDataFrame(S.DEFAULT_CONSUMERS, "regional string, consumidores long, mes int")
    else:
        plain = normalise_headers(source)
        rows = resolve(plain, S.ALIASES["consumers"], required=("regional", "consumidores"))
        if find_column(plain, S.ALIASES["consumers"]["mes"]) is None:
            rows = rows.withColumn("mes", F.lit(month))
    rows = rows.select(
        F.upper(F.trim(F.col("regional").cast("string"))).alias("regional"),
        F.col("consumidores").cast("string").try_cast("double").alias("consumidores"),
        F.col("mes").cast("string").try_cast("double").cast("int").alias("mes"),
    )
    has_month = rows.agg(F.max((F.col("mes") == month).cast("int")).alias("_has"))
    return rows.withColumn("_one", F.lit(1)).join(has_month.withColumn("_one", F.lit(1)), "_one").where(
        (F.coalesce("_has", F.lit(0)) == 0) | (F.col("mes") == month)
    ).drop("_one", "_has")


def compact_log(log: DataFrame) -> DataFrame:
    """Newest row per (path, size, time, status)."""
    return first_per_key(log, [*FILE_KEY, "status"], [F.desc_nulls_last("processado_em"), F.asc_nulls_last("linhas_lidas")])


def without_month(log: DataFrame, anomes: str) -> DataFrame:
    """The log without one month, whose files become pending again."""
    return log.where(F.coalesce(F.col("anomes"), F.lit("")) != anomes)


def _newest_first(log: DataFrame, moments: tuple[str, ...]) -> list[Column]:
    """Order of a log from its newest row, by the first moment a row has; equal moments by the other columns."""
    return [F.desc_nulls_last(F.coalesce(*[F.col(m).cast("string") for m in moments])), *[F.asc_nulls_last(c) for c in sorted(set(log.columns) - set(moments))]]


def latest_log_row(log: DataFrame, anomes: str, moments: tuple[str, ...] = ("processado_em",)) -> DataFrame:
    """The newest log row of a month; ``moments``: end and start, say, where a row may lack the first."""
    return log.where(F.col("anomes") == anomes).orderBy(*_newest_first(log, moments)).limit(1)


def log_tail(log: DataFrame, n: int, moments: tuple[str, ...] = ("processado_em",)) -> DataFrame:
    """The newest ``n`` log rows, newest first."""
    return log.orderBy(*_newest_first(log, moments)).limit(n)


def read_log_rows(spark: SparkSession, path: str, run_ts: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).where(F.col("processado_em") == run_ts)
