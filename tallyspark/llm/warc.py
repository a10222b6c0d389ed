"""WARC archives: a Spark data source that reads and writes them, and the resolution of revisits.

`warc` is a Python data source. Each task writes archives of its own, a gzip member a record, and names
them in its commit message; the driver's commit lists them in one manifest, and only listed archives are
read, so that retried, lost or stopped tasks leave nothing behind that counts. Reading takes an archive
as a partition and one record after another; folders without a manifest (other programs' archives) are
read whole.

deduplicate() rewrites archives: only headers are shuffled, by payload digest; the chosen response of
each digest is joined to the records that repeat it, and to revisits that are already there; then each
archive is read again beside its own short list of changes, so that payloads are never shuffled. All
records of the new archives have fresh ids, digests and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import drop_stored, scratch_dir, stored

#: Compressed bytes after which a task begins another archive, and of a batch of records on its way to Spark.
ROLL_BYTES, BATCH_BYTES = 256_000_000, 8_000_000
READ_BYTES = 1 << 18
SCHEMA = "file string, number long, headers map<string,string>, payload_bytes long, payload_digest string, block binary"
_MAP = pa.map_(pa.string(), pa.string())
ARROW = pa.schema([("file", pa.string()), ("number", pa.int64()), ("headers", _MAP), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: A record's key of the table that it comes from, and of the record that a revisit refers to (extension fields).
KEY, REFERS_KEY = "WARC-Source-Key", "WARC-Refers-To-Source-Key"


def sha1_label(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def sha1_hex(label: str | None) -> str | None:
    """The bare hex digest of `sha1:` and base32 or hex; null for others."""
    value = (label or "").strip().partition(":")[2] if (label or "").lower().startswith("sha1:") else ""
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record; characters that would end a header line are percent-encoded."""
    clean = lambda s: re.sub("[\0-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", s)
    lines = [VERSION, *(f"{k}: {clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bytes:
    """The bytes of an archive in order, unpacked where they are gzip members."""

    def __init__(self, stream):
        self.stream, self.held, self.ended = stream, b"", False
        first = stream.read(READ_BYTES)
        self.packed = first[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)
        self._add(first)

    def _add(self, raw: bytes) -> None:
        if not raw:
            self.ended = True
        if not self.packed:
            self.held += raw
            return
        out = [self.held]
        while raw:
            out.append(self.inflate.decompress(raw))
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.held = b"".join(out)

    def until(self, end: bytes) -> bytes | None:
        """All up to and with end; None where it no longer comes."""
        seen = 0
        while (at := self.held.find(end, max(0, seen - len(end)))) < 0:
            if self.ended:
                return None
            seen = len(self.held)
            self._add(self.stream.read(READ_BYTES))
        out, self.held = self.held[: at + len(end)], self.held[at + len(end) :]
        return out

    def take(self, n: int) -> bytes:
        got, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n and not self.ended:
            self._add(self.stream.read(READ_BYTES))
            got.append(self.held[: n - have])
            self.held = self.held[n - have :]
            have += len(got[-1])
        return b"".join(got)


def records_of(stream):
    """(headers, block) of each record of an archive. A record that is cut off raises EOFError."""
    source = _Bytes(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.pop("Content-Length"))
        block = source.take(size)
        if len(block) < size or source.take(4) != b"\r\n\r\n":
            raise EOFError("a record is cut off")
        yield headers, block
    if source.held.strip():
        raise EOFError("a record is cut off")


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What an HTTP response carries after its own head; else the whole block."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else block


def described(headers: dict[str, str], block: bytes) -> tuple[int, str | None]:
    """Bytes and digest of the full payload; a revisit's are those that its headers name."""
    if headers.get("WARC-Type") == "revisit":
        size = re.search(rb"\r\ncontent-length: *(\d+)", block, re.IGNORECASE)
        return int(size[1]) if size else 0, sha1_hex(headers.get("WARC-Payload-Digest"))
    payload = payload_of(headers, block)
    return len(payload), hashlib.sha1(payload).hexdigest()


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@dataclass
class Archive(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks = options["path"], options.get("blocks", "true").lower() == "true"

    def partitions(self):
        from pyarrow.fs import FileSelector

        store, root = _store(self.path)
        names = {x.base_name for x in store.get_file_info(FileSelector(root)) if x.is_file}
        listed = set()
        for manifest in (n for n in names if n.startswith("_manifest-")):
            with store.open_input_stream(f"{root}/{manifest}") as f:
                listed |= set(json.loads(f.read()))
        return [Archive(n) for n in sorted(listed if any(n.startswith("_manifest-") for n in names) else (n for n in names if n.endswith((".warc", ".warc.gz"))))]

    def read(self, partition):
        if not isinstance(partition, Archive):  # a folder without archives
            return
        rows, size = [], 0
        for row in archive_rows(self.path, partition.file, self.blocks):
            rows.append(row)
            size += len(row[5] or b"") + 500
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def archive_rows(path: str, file: str, blocks: bool = True):
    store, root = _store(path)
    with store.open_input_stream(f"{root}/{file}", compression=None) as f:
        for number, (headers, block) in enumerate(records_of(f)):
            yield file, number, list(headers.items()), *described(headers, block), block if blocks else None


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of headers and block, in their order."""

    def __init__(self, options):
        self.path, self.level = options["path"], int(options.get("level", "6"))

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block"), strict=True):
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    pack = zlib.compressobj(self.level, wbits=31)
                    raw = pack.compress(record_bytes(dict(headers), block.as_py() or b"")) + pack.flush()
                    out.write(raw)
                    size += len(raw)
                    if size >= ROLL_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"{root}/_manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/.new-{name.rpartition('-')[2]}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        store.move(f"{root}/.new-{name.rpartition('-')[2]}", name)

    def abort(self, messages):
        store, root = _store(self.path)
        for x in (x for m in messages if m for x in m.files):
            store.delete_file(f"{root}/{x}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """file, number (of the record in it, from 0), headers, payload_bytes, payload_digest (hex SHA-1) and block of each record; without blocks, null there."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("blocks", str(blocks).lower()).load(path)


def write_warc(records: DataFrame, path: str, level: int = 6) -> None:
    """Append records (headers, block) to the archives of a folder that all machines share; lengths are the blocks' own."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("headers", "block").write.format("warc").option("level", level).mode("append").save(path)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record (headers, block) for each row of pages: an HTTP head and the page in UTF-8 (null: empty).

    The key goes into the field KEY (null: none); a null url becomes a urn. Repeated rows are records of their own.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    row = F.monotonically_increasing_id().cast("string")
    one = F.md5(F.concat_ws("\0", name, F.coalesce(F.col(url).cast("string"), F.lit("")), row).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(one, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    fields = {"WARC-Type": F.lit("response"), "WARC-Record-ID": urn, "WARC-Date": F.lit("2000-01-01T00:00:00Z"), "WARC-Target-URI": F.coalesce(F.col(url).cast("string"), F.concat(F.lit("urn:page:"), name)), "Content-Type": F.lit(HTTP), KEY: F.col(key).cast("string")}
    headers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values())), lambda _, v: v.isNotNull())
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(headers.alias("headers"), F.concat(head.cast("binary"), payload).alias("block"))


def fresh_id(old: str) -> str:
    """The id of a record's successor in rewritten archives."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(b'rewritten ' + old.encode()).digest()[:16], version=5)}>"


def revisits(heads: DataFrame, least: int, order: Column) -> DataFrame:
    """file, number, original (id, uri, date, key): what each record that repeats a payload refers to.

    heads: records without blocks. Of the responses and resources with equal payloads of at least `least`
    bytes, the largest by order (then by id, file and number) stays; the others refer to it, and so do
    revisits of that digest that are there already. The digests that more than a thousandth of the records
    have, a thousand at most, are broadcast; the others meet their records by a shuffle.
    """
    get = lambda name: F.try_element_at("headers", F.lit(name))
    kind = get("WARC-Type")
    rows = stored(heads.select("file", "number", kind.alias("kind"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"), order.alias("rank"), F.struct(get("WARC-Record-ID").alias("id"), get("WARC-Target-URI").alias("uri"), get("WARC-Date").alias("date"), get(KEY).alias("key")).alias("record")), "heads")
    able = F.col("kind").isin("response", "resource") & (F.col("bytes") >= least)
    first = F.max(F.when(able, F.struct("rank", "record.id", "file", "number", "record"))).alias("first")
    groups = rows.where(F.col("digest").isNotNull() & (able | (F.col("kind") == "revisit"))).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1 and first is not null")
    groups = stored(groups.select("digest", "n", F.col("first.file").alias("at_file"), F.col("first.number").alias("at_number"), F.col("first.record").alias("original")), "originals")
    limit = rows.count() // 1000
    hot, rest = F.broadcast(groups.where(F.col("n") > limit)), groups.where(F.col("n") <= limit)
    asking = rows.where(able | (F.col("kind") == "revisit")).select("file", "number", "digest")
    found = asking.join(hot, "digest").unionByName(asking.join(hot, "digest", "left_anti").join(rest, "digest"))
    out = stored(found.where((F.col("file") != F.col("at_file")) | (F.col("number") != F.col("at_number"))).select("file", "number", "original"), "revisits")
    drop_stored(rows)
    drop_stored(groups)
    return out


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 1000, order: Column | None = None, level: int = 6) -> None:
    """Rewrite the archives of source into target with each payload once: records that repeat it become revisits of the chosen one.

    order chooses among equal payloads (a column over headers; the latest WARC-Date if it isn't given). A
    revisit whose digest no record here has keeps what it refers to. Other kinds of records are copied.
    Every record gets a fresh id, digests and length. An empty folder gives an empty one.
    """
    heads = read_warc(spark, source, blocks=False)
    order = F.try_element_at("headers", F.lit("WARC-Date")) if order is None else order
    changed = revisits(heads, least, order)
    files = spark.createDataFrame([(p.file,) for p in WarcReader({"path": source}).partitions()], "file string")
    per_file = changed.groupBy("file").agg(F.collect_list(F.struct("number", "original")).alias("changes"))  # as long as one archive
    work = files.join(per_file, "file", "left")
    work = work.repartition(max(1, files.count()), "file")

    def rewritten(batches):
        for batch in batches:
            for file, changes in zip(batch.column("file").to_pylist(), batch.column("changes").to_pylist(), strict=True):
                yield from _rewritten(source, file, {c["number"]: c["original"] for c in changes or ()})

    write_warc(work.mapInArrow(rewritten, "headers map<string,string>, block binary"), target, level)
    drop_stored(changed)


def _rewritten(source: str, file: str, changes: dict[int, dict]):
    rows, size = [], 0
    kind = pa.schema([("headers", _MAP), ("block", pa.binary())])
    make = lambda: pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in rows], _MAP), pa.array([b for _, b in rows], pa.binary())], schema=kind)
    for _, number, pairs, _, digest, block in archive_rows(source, file):
        headers = dict(pairs)
        if original := changes.get(number):
            if headers.get("Content-Type", "").startswith("application/http"):
                block = b"".join(block.partition(b"\r\n\r\n")[:2])
            else:
                block = b""
            headers |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": fresh_id(original["id"] or ""), "WARC-Refers-To-Target-URI": original["uri"], "WARC-Refers-To-Date": original["date"], REFERS_KEY: original["key"]}
        headers["WARC-Record-ID"] = fresh_id(headers.get("WARC-Record-ID", ""))
        if digest:
            headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
        headers["WARC-Block-Digest"] = sha1_label(block)
        rows.append(({k: v for k, v in headers.items() if v is not None}, block))
        size += len(block) + 500
        if size >= BATCH_BYTES:
            yield make()
            rows, size = [], 0
    if rows:
        yield make()


def archived_pages(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from the archives that were written of pages (page_id, url, html).

    First an archive of all pages, then the archives without repeated payloads; both in the shared folder.
    Of equal payloads the page with the largest id stays a response; among repeated rows of one id one of
    them, null ids last. An empty table gives no rows.
    """
    root = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), f"{root}/all", level=1)
    deduplicate(spark, f"{root}/all", f"{root}/once", least, F.try_element_at("headers", F.lit(KEY)).cast("long"))
    delete_folder(spark, f"{root}/all")
    heads = read_warc(spark, f"{root}/once", blocks=False)
    get = lambda name: F.try_element_at("headers", F.lit(name))
    return heads.select(get(KEY).cast("long").alias("page_id"), "payload_bytes", "payload_digest", get("WARC-Type").alias("record_type"), get(REFERS_KEY).cast("long").alias("refers_to"))


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
