"""WARC archives of pages, and one ordered capture history merged from their indexes."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, shuffle_width, stored
from martwright.session import scratch_path

# Payloads below this are responses even when equal.
MIN_BYTES = 0
# Records are written in blocks of about this many bytes, and files of so many blocks: a file is
# read as one value, so it stays far below the two gigabytes that one may have.
BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 64
_END = "\r\n\r\n"
_FIRST_CAPTURE = 1_577_836_800  # 2020-01-01, in seconds
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_URL = re.compile(r"^(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?(.*)$", re.I | re.S)


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query; scheme, ``www.`` and fragment go."""
    text = (url or "").strip()
    match = _URL.match(text)
    if not match:
        return text.lower()
    scheme, host, port, rest = match.groups()
    host = host.lower().removeprefix("www.")
    usual = (scheme or "").lower() + (port or "") in ("http80", "https443")
    place = f":{port}" if port and not usual else ""
    return ",".join(reversed(host.split("."))) + place + ")" + (rest.split("#")[0] or "/").lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_KEYS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("url_key", pa.string()),
        ("captured", pa.int64()),
        ("digest", pa.string()),
        ("check", pa.int64()),
        ("size", pa.int64()),
    ]
)
_KEYS_DDL = "page_id long, url string, url_key string, captured long, digest string, check long, size long"


def _describe(with_html: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        ids, urls = rows.column("page_id").to_pylist(), rows.column("url").to_pylist()
        for page_id, url, html in zip(ids, urls, rows.column("html")):
            data = html.as_py()
            check = np.frombuffer(hashlib.sha256(data).digest()[:8], "<i8")[0]
            captured = _FIRST_CAPTURE + (page_id or 0) % 1_000_000_000
            out.append((page_id, url, url_key(url), captured, payload_digest(data), check, len(data)))
        if not out:
            continue
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _KEYS)]
        names = list(_KEYS.names)
        if with_html:
            columns.append(rows.column("html").cast(pa.string()))
            names.append("html")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def describe(pages: DataFrame, with_html: bool = False) -> DataFrame:
    """Key columns of each capture; a second digest and the size verify equal payloads."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    )
    return arrow_map(rows, partial(_describe, with_html), _KEYS_DDL + ", html string" * with_html)


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict, response: bool) -> str:
    """One WARC record without its closing line ends."""
    stamp = np.datetime64(row["captured"], "s")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {stamp}Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"WARC-Payload-Length: {row['size']}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    block = ""
    if response:
        block = _HTTP.format(row["size"]) + row["html"]
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        first = "" if row["first_id"] is None else row["first_id"]
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block.encode())}")
    return "\r\n".join(lines) + "\r\n\r\n" + block


def _records(min_bytes: int, block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of captures sorted by URL key, time and page; of equal rows one is the response.

    Each value holds records up to ``block_bytes``, or a single longer one.
    """
    before = None
    for rows in batches:
        out: list[str] = []
        names, size = rows.schema.names, 0
        for i in range(rows.num_rows):
            row = {n: rows.column(n)[i].as_py() for n in names}
            same = (row["page_id"], row["url"], row["digest"])
            first = (row["page_id"], row["url"]) == (row["first_id"], row["first_url"]) and same != before
            before = same
            found = record(row, first or row["size"] < min_bytes)
            # A character has four bytes at most.
            if out and size + 4 * len(found) > block_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([_END.join(out)], pa.string())], names=["value"])
                out, size = [], 0
            out.append(found)
            size += 4 * len(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(out)], pa.string())], names=["value"])


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = MIN_BYTES,
    block_bytes: int = BLOCK_BYTES,
    per_file: int = BLOCKS_PER_FILE,
) -> None:
    """Write every page as a WARC record, into gzip files of at most ``per_file`` blocks.

    A block holds records of ``block_bytes`` in all, or one longer record; so a file is bounded in
    bytes whatever the pages' size.

    The smallest page of each payload is found on digests alone; that combines before the
    shuffle, so a payload with a third of all rows is one row per task. The pages are then
    joined to it by page, which spreads them evenly, and each partition is sorted into a
    run by URL key, time and page.
    """
    keys = stored(describe(pages), "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no"), "url"))
    firsts = stored(
        keys.groupBy("digest", "check", "size").agg(first.alias("f")).select(
            "digest", "check", "size", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")
        ),
        "firsts",
    )
    decided = (
        keys.select("page_id", "url", "digest", "check", "size")
        .join(firsts, ["digest", "check", "size"])
        .select(F.xxhash64("page_id", "url", "digest").alias("at"), "*")
        .dropDuplicates(["at", "page_id", "url", "digest", "check", "size"])
    )
    full = describe(pages, True).withColumn("at", F.xxhash64("page_id", "url", "digest")).alias("p")
    decided = decided.alias("q")
    on = F.col("p.at") == F.col("q.at")
    for name in ("page_id", "url", "digest", "check", "size"):
        on = on & F.col(f"p.{name}").eqNullSafe(F.col(f"q.{name}"))
    rows = full.join(decided, on).select(
        *(f"p.{n}" for n in _KEYS.names), "p.html", "q.first_id", "q.first_url"
    )
    rows = rows.sortWithinPartitions("url_key", "captured", "page_id", "url", "digest")
    out = arrow_map(rows, partial(_records, min_bytes, block_bytes), "value string")
    out.write.option("maxRecordsPerFile", per_file).text(path, compression="gzip", lineSep=_END)


class _Source:
    """Forward reading of a gzip block without holding its whole content."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        while chunk:
            self.held += self.inflate.decompress(chunk)
            chunk = self.inflate.unused_data
            if chunk:  # the next member
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while True:
            found = self.held.find(mark, start)
            if found >= 0:
                out = bytes(self.held[:found])
                del self.held[: found + len(mark)]
                return out
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self._more():
            pass
        if len(self.held) < size:
            raise ValueError("archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a gzip archive, by their stated lengths."""
    source = _Source(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = source.take(int(headers["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record does not end where it should")
        payload = block.split(b"\r\n\r\n", 1)[1] if headers["WARC-Type"] == "response" else b""
        yield headers, payload


_INDEX = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.int64()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("run", pa.string()),
        ("place", pa.int64()),
    ]
)
_INDEX_DDL = (
    "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, run string, place long"
)


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for run, content in zip(rows.column("path").to_pylist(), rows.column("content")):
            out = []
            for place, (head, payload) in enumerate(read_records(content.as_py())):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                response = head["WARC-Type"] == "response"
                if response and (digest != payload_digest(payload) or len(payload) != int(head["WARC-Payload-Length"])):
                    raise ValueError(f"damaged record {place} of {run}")
                out.append(
                    (
                        url_key(head.get("WARC-Target-URI")),
                        int(np.datetime64(head["WARC-Date"].removesuffix("Z"), "s").astype(np.int64)),
                        _page(head["WARC-Record-ID"]),
                        int(head["WARC-Payload-Length"]),
                        digest,
                        head["WARC-Type"],
                        None if response else _page(head["WARC-Refers-To"]),
                        run,
                        place,
                    )
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _INDEX)], schema=_INDEX)


def read_archives(spark, path: str) -> DataFrame:
    """One index row per record of the archives in a folder; responses are verified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return arrow_map(files.select("path", "content"), _index_rows, _INDEX_DDL)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner moves on.

    Taking the next item replays only the matches on the winner's path.
    """

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        self.items = [next(run, None) for run in runs]
        self.size = len(runs)
        self.losers = [-1] * max(1, self.size)
        for run in range(self.size):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.items[a] is None or self.items[b] is None:
            return self.items[b] is None and (self.items[a] is not None or a < b)
        ka, kb = self.key(self.items[a]), self.key(self.items[b])
        return ka < kb or (ka == kb and a < b)

    def _play(self, run: int) -> None:
        node = (run + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                # First at this match: wait here for the opponent.
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        while self.size:
            winner = self.losers[0]
            item = self.items[winner]
            if item is None:
                return
            yield item
            self.items[winner] = next(self.runs[winner], None)
            self._play(winner)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one key range; rows come run by run, each in its own order.

    The range, dealt evenly by sampled bounds, is held as columns; the merge moves row numbers.
    """
    table = pa.Table.from_batches(list(batches), schema=_INDEX)
    if not table.num_rows:
        return
    run = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]
    # Keys as numbers: the place of the URL key among all, the time, the page (NULL first).
    url = pc.rank(table.column("url_key").combine_chunks(), tiebreaker="dense").to_numpy()
    captured, page = table.column("captured").to_numpy(), table.column("page_id").combine_chunks()
    known, number = page.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(page, 0).to_numpy()

    def key(i: int) -> tuple:
        return url[i], captured[i], known[i], number[i]

    tree = iter(LoserTree([iter(range(a, b)) for a, b in zip(cuts, cuts[1:])], key))
    while len(at := np.fromiter(islice(tree, 1 << 16), np.int64)):
        yield from table.take(pa.array(at)).combine_chunks().to_batches()


def capture_history(index: DataFrame) -> DataFrame:
    """All captures ordered by URL key, time and page, over all partitions.

    Key ranges are dealt to tasks; a URL with very many captures is split by time and page.
    In each range the sorted pieces of all runs are merged by a loser tree.
    """
    width = shuffle_width(index.sparkSession)
    dealt = index.repartitionByRange(width, "url_key", "captured", F.col("page_id").asc_nulls_first())
    return arrow_map(dealt.sortWithinPartitions("run", "place"), _merge, _INDEX_DDL)


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as WARC archives, read them back, and return their ordered history.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured,
    run, place``. Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest page_id is the response and the others revisit it; smaller ones are all
    responses. NULL html is an empty payload. A NULL url sorts first. Rows without page_id come
    after others of their payload. Of rows equal in page and url, one is the response; with one page_id
    under several urls, the first url. The table has no capture times, so the page's number stands
    for seconds after a first capture. An empty table gives no rows.
    """
    path = path or scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_bytes)
    index = stored(read_archives(pages.sparkSession, path), "index")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return capture_history(index).select(*names, "url_key", "captured", "run", "place")
