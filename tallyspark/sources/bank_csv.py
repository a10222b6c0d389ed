"""Bank statements from CSV files whose form is found out."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parse_amount

ENCODINGS = ("utf-8", "latin-1", "cp1252", "iso-8859-1")
_JAVA = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252"}
SEPARATORS = ",;\t|"
# Header synonyms, and date formats in the order they are tried.
SYNONYMS = {
    "transaction_date": ("fecha", "fecha operacion", "fecha de operacion", "date", "fecha movimiento"),
    "amount": ("importe", "monto", "amount", "cantidad", "cargo"),
    "description": ("concepto", "descripcion", "description", "detalle", "movimiento"),
    "reference": ("referencia", "reference", "ref", "folio"),
}
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy")
SNIFFED_ROWS = 50
#: What the separator is found by.
SNIFFED_LINES, SNIFFED_CHARS = 100, 4096


class UnreadableStatement(ValueError):
    pass


@dataclass(frozen=True)
class Form:
    separator: str
    columns: dict[str, str]
    date_format: str | None


def _records(sample: str, separator: str) -> list[int]:
    """How many fields each of the sample's records has; separators and line breaks in quotes don't count."""
    return [len(r) for r in csv.reader(io.StringIO(sample, newline=""), delimiter=separator, skipinitialspace=True) if r]


def detect_separator(sample: str) -> str:
    """The separator by which a statement's first records have as many fields as its header.

    Of SEPARATORS the one that most records agree on, then the one with most fields; if none cuts the header, any other mark of
    the header by which all records (two at least) have as many fields as it; else a comma.
    """
    best, choice = (0.0, 0), ""
    for separator in SEPARATORS:
        fields = _records(sample, separator)
        if fields and fields[0] > 1:
            score = (fields.count(fields[0]) / len(fields), fields[0])
            best, choice = max((best, choice), (score, separator), key=lambda x: x[0])
    if choice:
        return choice
    header = sample.lstrip().split("\n", 1)[0]
    for mark in dict.fromkeys(c for c in header if not (c.isalnum() or c.isspace() or c in "\"'_.-")):
        fields = _records(sample, mark)
        if len(fields) > 1 and fields[0] > 1 and set(fields) == {fields[0]}:
            return mark
    return ","


def _sample(spark: SparkSession, path: str, encoding: str) -> str:
    """A statement's first whole lines, SNIFFED_CHARS at most (the first line in any case)."""
    lines, size = [], 0
    for (line,) in spark.read.option("encoding", encoding).text(path).limit(SNIFFED_LINES).collect():
        size += len(line) + 1
        if lines and size > SNIFFED_CHARS:
            break
        lines.append(line)
    sample = "\n".join(lines).lstrip("\ufeff")
    # a quoted field that the sample's end cuts would make one record of all that follows its quote
    while sample.count('"') % 2 and "\n" in sample:
        sample = sample.rsplit("\n", 1)[0]
    return sample


def resolve_headers(header: list[str], named: dict[str, str] | None = None) -> dict[str, str]:
    """For each field the file's column: the named one, else the first synonym there is. Only reference may be missing."""
    named = named or {}
    clean = {h.strip().lower(): h for h in reversed(header)}
    out = {}
    for field, synonyms in SYNONYMS.items():
        wanted = (named[field],) if field in named else synonyms
        hit = next((clean[w.strip().lower()] for w in wanted if w.strip().lower() in clean), None)
        if hit is None and (field != "reference" or field in named):
            raise UnreadableStatement(f"no column for {field}; there are: {', '.join(header)}")
        if hit is not None:
            out[field] = hit
    return out


def detect_date_format(rows: DataFrame, column: str, explicit: str | None = None) -> str | None:
    """The first format that all of the first values (at most SNIFFED_ROWS, non-empty) fit, by one aggregation; an explicit one must fit."""
    formats = DATE_FORMATS if explicit is None else (explicit,)
    c = F.trim(F.col(f"`{column}`"))
    # the pattern's own length keeps yyyy from taking two digits
    fits = [F.bool_and(F.coalesce(F.try_to_date(c, f).isNotNull() & (F.length(c) == len(f)), F.lit(False))).alias(f"f{i}") for i, f in enumerate(formats)]
    row = rows.where(F.coalesce(c, F.lit("")) != "").limit(SNIFFED_ROWS).agg(*fits).first()
    hit = next((f for i, f in enumerate(formats) if row[i]), None)
    if hit is None and explicit is not None:
        raise UnreadableStatement(f"dates don't fit {explicit}")
    return hit


def read_statement(spark: SparkSession, path: str, named: dict[str, str] | None = None, date_format: str | None = None, decimal_mark: str = ",", encoding: str = "utf-8", separator: str | None = None) -> DataFrame:
    """transaction_date, amount, description and reference of a statement.

    All columns are read as text. A row whose date or amount can't be read fails the whole file
    (UnreadableStatement with the number of such rows). Rows without any value are passed over; a file
    with headers only gives no rows.
    """
    if encoding.lower() not in ENCODINGS:
        raise UnreadableStatement(f"encoding {encoding} is not one of {', '.join(ENCODINGS)}")
    java = _JAVA[encoding.lower()]
    if separator is None:
        separator = detect_separator(_sample(spark, path, java))
    raw = spark.read.csv(path, header=True, sep=separator, encoding=java, inferSchema=False, mode="FAILFAST", multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not raw.columns:
        raise UnreadableStatement("an empty file")
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
    columns = resolve_headers(raw.columns, named)
    found = detect_date_format(raw, columns["transaction_date"], date_format)
    pick = lambda f: F.trim(F.col(f"`{columns[f]}`")) if f in columns else F.lit(None).cast("string")
    day = F.try_to_date(pick("transaction_date"), found) if found else F.coalesce(*[F.try_to_date(pick("transaction_date"), f) for f in DATE_FORMATS])
    rows = raw.where(F.coalesce(*[pick(f) for f in columns]).isNotNull()).select(day.alias("transaction_date"), parse_amount(pick("amount"), decimal_mark).cast("decimal(12,2)").alias("amount"), F.coalesce(pick("description"), F.lit("")).alias("description"), pick("reference").alias("reference"))
    bad = rows.where("transaction_date is null or amount is null").count()
    if bad:
        raise UnreadableStatement(f"{bad} rows have no readable date or amount")
    return rows


def _finished(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that fit the pattern and hold a whole batch: Spark marks them when a write has been committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark)
    return sorted(x.getPath().getParent().toString() for x in found or ())


def append_statement(rows: DataFrame, company: str, path: str) -> str:
    """Append a read statement to the table of movements, once; gives the batch's name.

    A batch is named by the company and the rows' content, whatever their order, and is a folder of its own. The same
    statement again finds its batch and writes nothing; a batch that a killed writer left without its mark
    doesn't count, and the next attempt writes it anew. Equal rows within one statement are movements of their own.
    """
    table = rows.withColumns({"company_id": F.lit(company), "is_reconciled": F.lit(False)})
    mark = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
    name = table.agg(F.sha2(F.concat_ws("|", F.lit(company), F.count(F.lit(1)).cast("string"), mark(1), mark(2)), 256)).first()[0][:32]
    folder = f"{path}/batch={name}"
    if not _finished(rows.sparkSession, folder):
        table.write.mode("overwrite").parquet(folder)
    return name


def movements(spark: SparkSession, path: str) -> DataFrame:
    """The table that append_statement has written: the rows of all finished batches."""
    folders = _finished(spark, f"{path}/batch=*")
    schema = "transaction_date date, amount decimal(12,2), description string, reference string, company_id string, is_reconciled boolean"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
