"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is Spark's text writer with the record end as line separator, so each task writes one archive wherever
Spark can write. Reading is Spark's text reader with the magic as line separator, so archives are split over
tasks at any byte. A magic may also stand inside a payload. So each task only emits candidates: the offset of
a magic with a whole header behind it, and the offset of the successor that its Content-Length gives. A chain
within a split is contracted to where it leaves the split; pointer jumping from the file start over these
exits, doubling the jump each round, finds the candidates that are reached in each split, and a walk within the
split finds the rest. What isn't reached is payload.

A split keeps digests of at most `OPEN` candidates that overlap at a time; what is reached beyond them is read again, as are records over several splits.

Defined results: null payloads are empty; null urls have no Target-URI header; ids of any type are percent-encoded and come back in their type, null ids as null;
rows with the smallest id of their payload are all responses if that id is repeated; an empty table gives no archive and
no rows; other columns aren't read. Line ends in a url are percent-encoded, as is a magic. Headers are read to their blank line, however
long they are; an archive whose chain reaches what isn't a record before the end of the file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.runtime import cut, shared_path

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The WARC standard's name for revisits by equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page"
#: Candidates of a split that are digested at the same time. Real records don't overlap, so more are false ones, as in payloads full of headers.
OPEN = 8
#: Bytes of an archive that pieces and the records that need them meet in.
BAND = 1 << 22


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 40 hex digits are 8 groups of 20 bits, each of which gives 4 letters."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses).

    Only payloads that occur twice meet the rows again; their table is written first, so that Spark broadcasts it if it is as small as the session allows, and shuffles otherwise."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("payload", "UTF-8")))
    again = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest_again"), "first_id")
    again.write.parquet(path := shared_path(spark, "repeated-payloads"))
    again = spark.read.parquet(path)
    rows = rows.join(again, (F.col("payload_digest") == F.col("digest_again")) & (F.col("payload_bytes") >= min_bytes), "left")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("digest_again", "first_id")


def record(target: Column, payload: Column) -> Column:
    """The bytes of a record without the two line ends that close it, as text."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.concat(F.lit(":"), F.url_encode(c.cast("string"))), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    safe = F.replace(F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(MAGIC), F.lit("WARC/1%2E"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(payload),
    )


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Archives in the folder `path`, one per task."""
    plan_records(pages, **options).select(record(F.col("url"), F.col("payload")).alias("value")).write.option("lineSep", END).text(path)


# Reading ---------------------------------------------------------------------------------------------------------

_FIELDS = {"file": "string", "block": "bigint", "rel": "bigint", "size": "bigint", "candidate": "boolean", "length": "bigint", "exit": "bigint", "type": "string", "record_id": "string", "uri": "string", "refers_to": "string", "stated_digest": "string", "stated_bytes": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "whole": "boolean"}


class _Open:
    """A candidate whose record isn't complete yet."""

    def __init__(self, row: dict, want: int, keep: bool):
        self.row, self.want, self.sha, self.head, self.http, self.n, self.keep, self.body = row, want, hashlib.sha1(), bytearray(), row["http"], 0, keep, []

    def feed(self, data: bytes) -> bool:
        """Whether the block is complete."""
        data = data[: self.want]
        self.want -= len(data)
        if self.http:
            seen = max(0, len(self.head) - 3)
            self.head += data
            at = self.head.find(END.encode(), seen)
            if at < 0 and self.want:
                return False
            data, self.head, self.http = bytes(self.head[at + 4 :] if at >= 0 else self.head), bytearray(), False
        self.sha.update(data)
        self.n += len(data)
        if self.keep:
            self.body.append(data)
        return not self.want

    def close(self) -> None:
        self.row |= {"payload_bytes": self.n, "payload_digest": base64.b32encode(self.sha.digest()).decode(), "whole": True}
        if self.keep:
            self.row["payload"] = b"".join(self.body)


def _header(text: bytes) -> tuple[int, dict[str, str]] | None:
    """Length up to the block, and the fields, of what follows the magic; None if it isn't the header of a record."""
    if not re.match(rb"\d\r\n", text) or (end := text.find(END.encode())) < 0:
        return None
    fields = {}
    for part in text[:end].split(b"\r\n")[1:]:
        name, colon, value = part.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return (end + 4, fields) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Split:
    """The candidates of one split, in order of their offsets from its first piece."""

    def __init__(self, file: str, block: int, keep: bool):
        self.file, self.block, self.keep = file, block, keep
        self.rows: list[dict] = []
        self.open: list[_Open] = []
        self.pending: tuple[dict, bytearray] | None = None  # a header whose blank line is in a later piece
        self.at = 0

    def add(self, piece: bytes) -> None:
        row = dict.fromkeys(_FIELDS) | {"file": self.file, "block": self.block, "rel": self.at - len(MAGIC), "size": len(piece) + len(MAGIC), "candidate": False, "whole": False, "http": False, "payload": None}
        full = MAGIC.encode() + piece
        self.open = [o for o in self.open if not (o.feed(full) and (o.close() or True))]
        if self.pending:
            before, text = self.pending
            seen = max(0, len(text) - 3)
            text += full
            if text.find(END.encode(), seen) >= 0:
                self._start(before, bytes(text))
                self.pending = None
        if (self.at or self.block) and not self._start(row, piece) and re.match(rb"\d\r\n", piece) and b"\r\n\r\n" not in piece and not self.pending:
            self.pending = (row, bytearray(piece))
        self.at += row["size"]
        self.rows.append(row)

    def _start(self, row: dict, text: bytes) -> bool:
        found = _header(text)
        if not found:
            return False
        n, x = found
        unquote = lambda s: s.removeprefix("<").removesuffix(">") if s else s
        block = int(x["content-length"])
        row |= {"candidate": True, "length": len(MAGIC) + n + block + len(END), "type": x["warc-type"], "record_id": unquote(x.get("warc-record-id")), "uri": x.get("warc-target-uri"), "refers_to": unquote(x.get("warc-refers-to"))}
        row |= {"stated_digest": (x.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "stated_bytes": int(v) if (v := x.get("x-payload-length", "")).isdigit() else None, "http": "application/http" in x.get("content-type", "")}
        if len(self.open) >= OPEN:
            return True
        o = _Open(row, block, self.keep)
        if o.feed(text[n : n + block]) or not block:
            o.close()
        else:
            self.open.append(o)
        return True

    def done(self) -> list[dict]:
        """All rows; `exit` is where the chain of each candidate leaves the split."""
        exits: dict[int, int] = {}
        for row in reversed(self.rows):
            if row["candidate"]:
                to = row["rel"] + row["length"]
                row["exit"] = exits[row["rel"]] = exits.get(to, to)
        return self.rows


def scan(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per piece between magics, with its candidate if it is one. Offsets are from the first piece of its split."""
    fields = _FIELDS | ({"payload": "binary"} if payload else {})
    out = K.schema(**fields)
    text = spark.read.option("lineSep", MAGIC).text(path)
    pieces = K.bounded_batches(text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds[k]) for f, k in fields.items()], list(fields))
        split: _Split | None = None
        for batch in batches:
            for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if split is None or (split.file, split.block) != (file, block):
                    if split:
                        yield give(split.done())
                    split = _Split(file, block, payload)
                split.add(value.as_py())
        if split:
            yield give(split.done())

    return pieces.mapInArrow(run, out)


def reached(chain: DataFrame) -> DataFrame:
    """(file, at) of the split entries that are reached from offset 0, by pointer jumping over the exits of splits.

    `chain`: file, offset, exit (absolute). Few rows: the candidates that some chain enters a split by."""
    heads = chain.select("file", F.col("exit").alias("offset")).union(chain.select("file", F.lit(0).cast("long"))).distinct()
    jump = cut(chain.join(heads, ["file", "offset"], "left_semi").select("file", "offset", F.col("exit").alias("to")))
    found = cut(jump.where("offset = 0").select("file", F.col("offset").alias("at")))
    n = found.count()
    while True:
        step = found.join(jump, (found["file"] == jump["file"]) & (found["at"] == jump["offset"])).select(found["file"], F.col("to").alias("at"))
        found = cut(found.union(step).distinct())
        if (now := found.count()) == n:
            return found
        n = now
        second = jump.select(F.col("file").alias("file2"), F.col("offset").alias("middle"), F.col("to").alias("to2"))
        jump = cut(jump.join(second, (F.col("file") == F.col("file2")) & (F.col("to") == F.col("middle"))).select("file", "offset", F.col("to2").alias("to")))


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record: file, offset, length, type, record_id, uri, refers_to, stated_digest, stated_bytes, payload_bytes, payload_digest, and payload if asked for.

    payload_* are computed from the bytes in the archive, stated_* are its headers."""
    rows = cut(scan(spark, path, payload))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file", "block").agg(F.sum("size").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    rows = rows.join(bases.drop("bytes"), ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel"))
    candidates = cut(rows.where("candidate").withColumn("exit", F.col("base") + F.col("exit")))
    entries = reached(candidates.select("file", "offset", "exit"))
    marked = candidates.join(entries.withColumnRenamed("at", "offset").withColumn("entry", F.lit(True)), ["file", "offset"], "left")

    def walk(group):
        group = group.sort_by("offset")
        live: set[int] = set()
        keep = []
        for at, n, entry in zip(group["offset"].to_pylist(), group["length"].to_pylist(), group["entry"].to_pylist(), strict=True):
            keep.append(bool(entry) or at in live)
            if keep[-1]:
                live.add(at + n)
        return group.filter(pa.array(keep)).select(["file", "offset", "length"])

    alive = cut(marked.select("file", "block", "offset", "length", "entry").groupBy("file", "block").applyInArrow(walk, "file string, offset bigint, length bigint"))
    records = candidates.join(alive.drop("length"), ["file", "offset"])
    # A file must begin with a record, and each be followed by a record or the end.
    after = alive.select("file", (F.col("offset") + F.col("length")).alias("at")).union(bases.select("file", F.lit(0).cast("long")).distinct())
    ends = bases.groupBy("file").agg((F.max(F.col("base") + F.col("bytes")) - len(MAGIC)).alias("file_end"))
    lost = after.join(alive.select("file", F.col("offset").alias("at")), ["file", "at"], "left_anti").join(ends, "file").where("at < file_end").select("file", "at").head(1)
    if lost:
        raise ValueError(f"no record at offset {lost[0]['at']} of {lost[0]['file']}")
    records = _complete(records, path, payload)
    return records.drop("block", "rel", "size", "candidate", "exit", "base", "whole")


def _complete(records: DataFrame, path: str, payload: bool) -> DataFrame:
    """Records that run into the next split, or weren't digested, are read again from their pieces. Both meet by bands of the archive."""
    records = cut(records)
    parts = records.where("not whole")
    if parts.isEmpty():
        return records
    spark = records.sparkSession
    text = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    text = text.join(parts.select("file").distinct(), "file", "left_semi").withColumn("n_bytes", F.octet_length("value") + len(MAGIC))
    in_block = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = text.groupBy("file", "block").agg(F.sum("n_bytes").alias("b")).withColumn("base", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    text = text.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n_bytes").over(in_block), F.lit(0)) - len(MAGIC))
    band = lambda c: F.floor(c / BAND).cast("long")
    wanted = parts.select("file", "offset", "length", F.explode(F.sequence(band(F.col("offset")), band(F.col("offset") + F.col("length") - 1))).alias("band"))
    pieces = text.withColumn("band", band(F.col("at"))).join(wanted, ["file", "band"]).where("at >= offset and at < offset + length").select("file", "offset", "length", "at", "value")

    def gather(group):
        group = group.sort_by("at")
        data = b"".join(MAGIC.encode() + v for v in group["value"].to_pylist())
        split = _Split("", 1, True)
        row = dict.fromkeys(_FIELDS) | {"http": False, "payload": None, "rel": 0}
        split._start(row, data[len(MAGIC) :])
        return pa.table({"file": group["file"][:1], "offset": group["offset"][:1], "b2": pa.array([row["payload_bytes"]], pa.int64()), "d2": pa.array([row["payload_digest"]]), "p2": pa.array([row["payload"]], pa.binary())})

    fixed = pieces.groupBy("file", "offset").applyInArrow(gather, "file string, offset bigint, b2 bigint, d2 string, p2 binary")
    out = records.join(fixed, ["file", "offset"], "left").withColumn("payload_bytes", F.coalesce("b2", "payload_bytes")).withColumn("payload_digest", F.coalesce("d2", "payload_digest"))
    if payload:
        out = out.withColumn("payload", F.coalesce("p2", "payload"))
    return out.drop("b2", "d2", "p2")


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write, read back, and describe each page: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, id_col=id_col, **options)
    rows = read_warc(spark, path)
    id_of = lambda c: F.when(F.col(c) != URN, F.url_decode(F.substr(F.col(c), F.lit(len(URN) + 2)))).cast(pages.schema[id_col].dataType)
    revisit = F.col("type") == "revisit"
    return rows.select(
        id_of("record_id").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        id_of("refers_to").alias("refers_to"),
        F.col("uri").alias("url"),
    )
